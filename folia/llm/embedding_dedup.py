"""Near-duplicate vectors by cosine: NN-descent over a neighbour graph.

Equal vectors are one node. Nodes carry a sketch (the unit vector in eight-bit steps; wider vectors
are first projected to SKETCH dimensions by a fixed random matrix). The graph starts from
TABLES orders of the nodes by the signs of random projections: a node's first neighbours are the
best of those near it in an order. Each round then joins, at every node, its neighbours and about
REVERSE of the nodes that list it with each other (pairs with a new edge only) and keeps the best of
a list; a list that is saturated, all of it over the threshold, is doubled, up to WIDEST. Rounds
end when at most SETTLED of the edges near the threshold are new.

Edges near the threshold are then tested on the vectors, in double precision, and give components.
What a bounded list can't hold is counted inside the component: its members are dealt to
shells by their angle to the component's first vector; shells whose angles decide all their pairs
need no comparison, the others meet in blocks, and a task hands on counts, never pairs. Finally the
links are audited: AUDIT nodes, those of the smallest hashes of their ids, are compared with all
vectors, in blocks, and where fewer than RECALL of their links were found, a further graph from
other projections is joined to this one, ATTEMPTS times at most.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components link with nothing; rows that repeat a vec_id are one vector, the smallest
that can be used; null ids give one row, linked with nothing and not kept; a vector's copies under
other ids are links; of the columns only vec_id and embedding are read, whatever others are called;
the length of vectors is not bounded; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import looked_up, partitions_for, release, scratch, stored, table
from .ann import _matrix, usable
from .near_dup import components

THRESHOLD = 0.95
SKETCH = 64
TABLES, KEPT, NEAR = 8, 3, 6
LIST, WIDEST, REVERSE = 8, 32, 8
ROUNDS, ATTEMPTS = 6, 3
SETTLED = 0.01
AUDIT, RECALL = 512, 0.99
MARGIN = 0.03
SHELLS, BLOCK = 64, 2_048
SLACK = 1e-6
_GROUPS = 2_048


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def vectors_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """vec_id, node (the smallest id of an equal vector; null: takes no part); node, copies, v (unit); the width."""
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    widths = raw.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 1

    def units(batches):
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("v"))) + 0.0  # no negative zeros
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "v"])

    good = usable(raw, width).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(units, "vec_id long, v array<double>")
    good = stored(good.withColumn("digest", F.unhex(F.sha2(F.to_json("v").cast("binary"), 256))), "cosine-vectors")
    classes = good.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(classes.join(good.select(F.col("vec_id").alias("node"), "v"), "node").select("node", "copies", "v"), "cosine-nodes")
    members = looked_up(good.select("vec_id", "digest"), "digest", classes.select("digest", "node"), by="vec_id").select("vec_id", "node")
    everyone = stored(raw.select("vec_id").distinct().join(members.hint("shuffle_hash"), "vec_id", "left"), "cosine-members")
    return everyone, nodes, width


def sketches(nodes: DataFrame, width: int) -> DataFrame:
    """node, sketch: eight-bit steps of the unit vector, at most SKETCH of them."""

    def steps(batches):
        to = np.random.default_rng(5).standard_normal((width, SKETCH)) if width > SKETCH else None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                x = x if to is None else unit(x @ to)
                q = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in q], pa.binary())], names=["node", "sketch"])

    return stored(nodes.mapInArrow(steps, "node long, sketch binary"), "cosine-sketches")


def _unpacked(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def started(sketched: DataFrame, width: int, seed: int) -> DataFrame:
    """u, v, s: for each node and table the KEPT likest of the NEAR nodes on either side of it in the table's order."""
    wide = min(width, SKETCH)

    def keyed(batches):
        planes = np.random.default_rng([seed, wide]).standard_normal((TABLES, wide, 32)).astype(np.float32)
        bit = 1 << np.arange(31, -1, -1, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = _unpacked(b.column("sketch"))
                keys = [((x @ p > 0) * bit).sum(axis=1) for p in planes]
                at = pa.array(np.tile(np.arange(b.num_rows), TABLES))
                names = pa.array(np.repeat(np.arange(TABLES, dtype=np.int32), b.num_rows))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(keys)), b.column("node").take(at), b.column("sketch").take(at)], names=["t", "key", "node", "sketch"])

    def beside(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column("t").to_numpy(), b.column("node").to_numpy(), _unpacked(b.column("sketch"))]
            if held is not None:
                now = [np.concatenate((o, n)) for o, n in zip(held[0], now)]
            yield _beside(*now, 0 if held is None else held[1])
            keep = max(0, len(now[0]) - NEAR)
            held = [x[keep:] for x in now], len(now[0]) - keep

    dealt = sketched.mapInArrow(keyed, "t int, key long, node long, sketch binary").withColumn("spread", F.xxhash64("node"))
    order = ["t", "key", "spread"]
    dealt = dealt.repartitionByRange(partitions_for(sketched.sparkSession), *order).sortWithinPartitions(*order)
    near = dealt.select("t", "node", "sketch").mapInArrow(beside, "u long, v long, s float")
    return merged(near.withColumn("old", F.lit(False)), None, "cosine-start")


def _beside(t: np.ndarray, node: np.ndarray, x: np.ndarray, done: int) -> pa.RecordBatch:
    """The likest of NEAR rows on either side; the first `done` rows only serve as partners of later ones."""
    n = len(t)
    s = np.full((n, 2 * NEAR), -2, np.float32)
    who = np.zeros((n, 2 * NEAR), np.int64)
    for k in range(1, min(NEAR, n - 1) + 1):
        both = np.where(t[k:] == t[:-k], np.einsum("ij,ij->i", x[k:], x[:-k]), -2)
        both[: max(0, done - k)] = -2  # met in the batch before
        s[k:, k - 1], who[k:, k - 1] = both, node[:-k]
        s[:-k, NEAR + k - 1], who[:-k, NEAR + k - 1] = both, node[k:]
    best = np.argsort(-s, axis=1, kind="stable")[:, :KEPT]
    r, s, who = np.repeat(np.arange(n), KEPT), np.take_along_axis(s, best, 1).ravel(), np.take_along_axis(who, best, 1).ravel()
    ok = s > -2
    return pa.RecordBatch.from_arrays([pa.array(node[r[ok]]), pa.array(who[ok]), pa.array(s[ok])], names=["u", "v", "s"])


def merged(found: DataFrame, limits: DataFrame | None, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """u, v, s, fresh, room: of the edges found (u, v, s, old) the best of each list.

    room is the length a list may have; where all of it is over the threshold it is doubled.
    """
    dealt = found.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.max("old").alias("old"))
    if limits is not None:
        dealt = dealt.join(limits, "u", "left")
    else:
        dealt = dealt.withColumn("room", F.lit(LIST))
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    placed = dealt.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.coalesce("room", F.lit(LIST)))
    room = F.coalesce(F.max("room").over(Window.partitionBy("u")), F.lit(LIST))
    full = (F.count(F.lit(1)).over(Window.partitionBy("u")) >= room) & (F.min("s").over(Window.partitionBy("u")) >= threshold)
    wider = F.when(full, F.least(room * 2, F.lit(WIDEST))).otherwise(room)
    return stored(placed.select("u", "v", "s", (~F.col("old")).alias("fresh"), wider.cast("int").alias("room")), name)


def joined(graph: DataFrame, sketched: DataFrame, turn: int) -> DataFrame:
    """One round: the neighbours of each node, listed or listing, meet each other; u, v, s that a list may take."""
    listed = graph.groupBy("v").agg(F.count(F.lit(1)).alias("times"))
    chance = F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.lit(1_000_003)) < F.lit(1_000_003.0 * REVERSE) / F.col("times")
    back = graph.join(listed, "v").where(chance).select(F.col("v").alias("w"), F.col("u").alias("a"), "fresh")
    ends = graph.select(F.col("u").alias("w"), F.col("v").alias("a"), "fresh").union(back)
    # the least that a's list still takes
    bars = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("room").alias("room"), F.min("s").alias("s"))
    bars = bars.select(F.col("u").alias("a"), F.when(F.col("n") >= F.col("room"), F.col("s")).otherwise(-2.0).cast("float").alias("bar"))
    known = sketched.withColumnRenamed("node", "a").join(bars, "a", "left")
    met = ends.join(known, "a").select("w", "a", "fresh", "sketch", F.coalesce("bar", F.lit(-2.0)).cast("float").alias("bar"))

    def meet(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("w", "a", "fresh", "bar")] + [_unpacked(b.column("sketch"))]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            start = np.flatnonzero(np.concatenate(([True], now[0][1:] != now[0][:-1])))
            yield from _meetings(start, *[x[: start[-1]] for x in now[1:]])
            rest = [x[start[-1] :] for x in now]
        if rest is not None:
            yield from _meetings(np.array([0, len(rest[0])]), *rest[1:])

    dealt = met.repartition("w").sortWithinPartitions("w", "a")
    return dealt.mapInArrow(meet, "u long, v long, s float")


def _meetings(edge: np.ndarray, a: np.ndarray, fresh: np.ndarray, bar: np.ndarray, x: np.ndarray):
    """Edges of the groups between the edges; groups of like size are multiplied together."""
    start, size = edge[:-1], np.diff(edge)
    for wide in (8, 16, 32, 64, 128, 1 << 62):
        some = np.flatnonzero((size > 1) & (size <= wide) & (size > (wide // 2 if wide < 1 << 62 else 128) * (wide > 8)))
        step = max(1, _GROUPS * 64 // min(wide, 1 << 12) ** 2)
        for k in range(0, len(some), step):
            g = some[k : k + step]
            most = int(size[g].max())
            at = start[g][:, None] + np.arange(most)
            there = np.arange(most) < size[g][:, None]
            at = np.where(there, at, 0)
            y = x[at]
            s = y @ y.transpose(0, 2, 1)
            new = (fresh[at][:, :, None] | fresh[at][:, None, :]) & there[:, :, None] & there[:, None, :]
            new &= (a[at][:, :, None] != a[at][:, None, :]) & (s > bar[at][:, :, None])
            r, i, j = np.nonzero(new)
            if len(r):
                u, v, s = a[at[r, i]], a[at[r, j]], s[r, i, j]
                # of a pair met at several nodes one row is enough
                first = np.unique(np.stack((u, v)), axis=1, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(v[first]), pa.array(s[first])], names=["u", "v", "s"])


def descend(sketched: DataFrame, width: int, seed: int, before: DataFrame | None, threshold: float) -> DataFrame:
    """The neighbour graph (u, v, s, fresh, room) from one set of projections, joined with one from before."""
    spark = sketched.sparkSession
    graph = started(sketched, width, seed)
    if before is not None:
        edges = graph.select("u", "v", "s", F.lit(False).alias("old")).union(before.select("u", "v", "s", F.lit(True)))
        graph = merged(edges, before.select("u", "room").distinct(), "cosine-graph", threshold)
    for turn in range(ROUNDS):
        found = joined(graph, sketched, seed * ROUNDS + turn).withColumn("old", F.lit(False))
        known = graph.select("u", "v", "s", F.lit(True).alias("old"))
        graph = merged(found.union(known), graph.select("u", "room").distinct(), "cosine-graph", threshold)
        release(spark)
        near = graph.where(F.col("s") >= threshold - MARGIN).agg(F.count(F.lit(1)).alias("all"), F.count_if("fresh").alias("fresh")).first()
        if near["fresh"] <= SETTLED * near["all"]:
            break
    return graph


def tested(graph: DataFrame, nodes: DataFrame, threshold: float, margin: float) -> DataFrame:
    """a, b: edges whose vectors have the cosine, in double precision."""
    pairs = graph.where(F.col("s") >= threshold - margin).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    def test(batches):
        for b in batches:
            if b.num_rows:
                good = np.einsum("ij,ij->i", _matrix(b.column("va")), _matrix(b.column("vb"))) >= threshold
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good))

    ends = pairs.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
    return stored(ends.select("a", "b", "va", "vb").mapInArrow(test, "a long, b long"), "cosine-links")


def placed(homes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, copies, shell, angle (to the root's vector), v of the members of components."""

    def angles(batches):
        for b in batches:
            if b.num_rows:
                dot = np.einsum("ij,ij->i", _matrix(b.column("v")), _matrix(b.column("first")))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.arccos(np.clip(dot, -1, 1)))], names=["node", "angle"])

    firsts = homes.where("node = root").join(nodes.select("node", F.col("v").alias("first")), "node").select("root", "first")
    # a component's first vector meets its members in salted parts
    own = homes.join(nodes, "node").select("node", "root", "copies", "v")
    found = looked_up(own.select("node", "root", "v"), "root", firsts, by="node").select("node", "v", "first").mapInArrow(angles, "node long, angle double")
    return stored(own.join(found, "node"), "cosine-placed", batch=4_096)


def counted_links(members: DataFrame, threshold: float) -> DataFrame:
    """node, n: vectors of its component with the cosine, itself included."""
    theta = math.acos(threshold)
    members = members.withColumn("shell", F.floor(F.col("angle") / (theta / SHELLS)).cast("int"))
    shells = stored(members.groupBy("root", "shell").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("held"), F.min("angle").alias("low"), F.max("angle").alias("high")), "cosine-shells")
    one, two = shells.alias("one"), shells.alias("two")
    meets = one.join(two, F.col("one.root") == F.col("two.root")).where(F.greatest("one.low", "two.low") - F.least("one.high", "two.high") <= theta + SLACK)
    whole = F.col("one.high") + F.col("two.high") <= theta - SLACK
    meets = meets.select("one.root", "one.shell", F.col("two.shell").alias("other"), "two.held", whole.alias("whole"), F.ceil(F.col("one.rows") / BLOCK).alias("parts"), F.ceil(F.col("two.rows") / BLOCK).alias("others"))
    meets = stored(meets, "cosine-meets")
    sure = meets.where("whole").groupBy("root", "shell").agg(F.sum("held").alias("n"))
    place = F.concat_ws("/", "root", "shell")
    light = members.select("node", place.alias("place"))
    certain = looked_up(light, "place", sure.select(place.alias("place"), "n"), by="node").select("node", "n")
    unsure = meets.where("not whole")
    if not unsure.limit(1).count():
        return certain
    spread = F.xxhash64("node")
    asks = members.join(unsure, ["root", "shell"]).withColumn("part", F.pmod(spread, "parts")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    asks = asks.select("root", "shell", "part", "other", "with", F.lit(True).alias("asks"), "node", "copies", "v")
    held = members.join(unsure.select("root", F.col("shell").alias("asking"), F.col("other").alias("shell"), "parts", "others"), ["root", "shell"])
    held = held.withColumn("with", F.pmod(spread, "others")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    held = held.select("root", F.col("asking").alias("shell"), "part", F.col("shell").alias("other"), "with", F.lit(False).alias("asks"), "node", "copies", "v")
    block = ["root", "shell", "part", "other", "with"]
    dealt = held.union(asks).withColumn("block", F.xxhash64(*block)).select("block", *block, "asks", "node", "copies", "v")
    dealt = dealt.repartition("block").sortWithinPartitions(*block, "asks")

    def compare(batches):
        own, parts, x, copies = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in block] + [b.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)])
            edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for z, e in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                if own is None or (keys[:-1, z] != own).any():
                    own, parts, x = keys[:-1, z], [], None
                some = b.slice(z, e - z)
                if not keys[-1, z]:
                    parts.append((_matrix(some.column("v")), some.column("copies").to_numpy()))
                    continue
                if x is None and parts:
                    x, copies = (np.concatenate(p) for p in zip(*parts))
                if x is not None:
                    n = ((_matrix(some.column("v")) @ x.T >= threshold) * copies).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([some.column("node"), pa.array(n.astype(np.int64))], names=["node", "n"])

    compared = stored(dealt.mapInArrow(compare, "node long, n long"), "cosine-counts", batch=2_048)
    return certain.union(compared).groupBy("node").agg(F.sum("n").alias("n"))


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, rows: int = AUDIT) -> float:
    """The share found of the links of `rows` nodes, which are compared with all vectors."""
    spark = nodes.sparkSession
    asked = nodes.orderBy(F.xxhash64("node"), "node").limit(rows).toArrow()
    if not asked.num_rows:
        return 1.0
    held = spark.sparkContext.broadcast((asked.column("node").to_numpy(), _matrix(asked.column("v").combine_chunks())))

    def compare(batches):
        ids, x = held.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                total += ((x @ _matrix(b.column("v")).T >= threshold) * b.column("copies").to_numpy()).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "true"])

    true = nodes.select("copies", "v").mapInArrow(compare, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    met = true.join(nodes.select("node", "copies"), "node").join(counts, "node", "left")
    # a node's own copies are no links of the graph
    said = met.agg(F.sum(F.col("true") - F.col("copies")).alias("true"), F.sum(F.coalesce("n", "copies") - F.col("copies")).alias("found")).first()
    held.unpersist()
    return said["found"] / said["true"] if said["true"] else 1.0


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    with scratch(embeddings.sparkSession) as result:
        return result(_near_vectors(embeddings, threshold), "near-vectors")


def _near_vectors(embeddings: DataFrame, threshold: float) -> DataFrame:
    everyone, nodes, width = vectors_of(embeddings)
    sketched, graph = sketches(nodes, width), None
    margin = MARGIN if width <= SKETCH else 4 * MARGIN
    for attempt in range(ATTEMPTS):
        graph = descend(sketched, width, attempt, graph, threshold)
        homes = components(tested(graph, nodes, threshold, margin))
        counts = stored(counted_links(placed(homes, nodes), threshold), "cosine-counts")
        if audit(nodes, counts, threshold) >= RECALL:
            break
    known = nodes.select("node", "copies").join(homes, "node", "left").join(counts, "node", "left")
    known = known.select("node", F.coalesce("root", "node").alias("component_id"), (F.coalesce("n", "copies") - 1).cast("long").alias("n_links"))
    linked = looked_up(everyone.where("node is not null"), "node", known, by="vec_id").select("vec_id", "n_links", "component_id")
    alone = everyone.where("node is null").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_nn_descent_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
