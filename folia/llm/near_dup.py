"""Near-duplicate documents by minwise hashing with tensored banding.

A document is its set of k-word shingles. Two small collections of half keys are made, ROWS[0] or
ROWS[1] minhashes each; a table's key is a pair of one half key from either, so la + lb half keys
serve la * lb tables. Collection sizes follow the threshold so that a pair at the threshold
misses all of a collection with probability MISS at most. Equal sets are one node from the start.

A half key met once can't be part of a shared table key, so only shared half keys are combined.
Inside a table key, rows in a pseudo-random order of the table are first compared with the one
before and the one FARTHER before: a linear number of candidates that settles most of a large
group. Keys of more rows that still hold several components are then compared whole, by their
first half key and in blocks of BLOCK shingles: every row outside the commonest component with every
row of another one, so no pair of such a key stays untested unless its ends are joined already; the
full sets decide in the same task, which hands on only links that join components. Candidates whose
minhashes agree far less than the threshold are left; those of neighbours are confirmed on the full sets:
first the FIRST likeliest of each document, then those that would join components still apart,
GROWTH times as many a document in every round, until none is left. Components follow from
confirmed links by repeated minima in the shared folder, never on the driver.

Defined results: null, empty or word-free text has no shingles and links with nothing; rows that
repeat a doc_id are one node; a null doc_id has a null component; of equal likeness the smaller
doc_id is confirmed first, which changes no component; an empty table gives no rows. Texts are read
whole whatever their length (a set is gathered a document at a time); of the columns only doc_id and
text are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._hash import mix, shingles
from ._util import looked_up, release, scratch, stored, table, text_only

ROWS = (3, 2)
MISS = 4e-5
FIRST, GROWTH = 4, 16
FARTHER = 2
ONE_TASK = 1_000_000
A_LONG = 15
BLOCK = 1_000_000
_CHUNK = 2_048


def collections(threshold: float) -> tuple[int, int]:
    return tuple(math.ceil(math.log(MISS) / math.log(1 - threshold**r)) for r in ROWS)


def minhashes(s: np.ndarray, n: int) -> np.ndarray:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    add, times = seeds[:n], seeds[n:] | np.uint64(1)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), _CHUNK):
        np.minimum(out, ((s[i : i + _CHUNK, None] ^ add) * times).min(axis=0), out=out)
    return out


def half_keys(m: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """The half keys of both collections, one after the other."""
    keys, at = [], 0
    for side, (n, r) in enumerate(zip(sizes, ROWS)):
        part = m[at : at + n * r].reshape(n, r)
        h = np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(side + 1)
        for k in range(r):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, k])
        keys.append(h)
        at += n * r
    return np.concatenate(keys)


def four_bits(m: np.ndarray) -> list[int]:
    """The lowest four bits of each minhash, A_LONG to a long."""
    low = (m & np.uint64(15)).tolist()
    return [sum(v << 4 * i for i, v in enumerate(low[at : at + A_LONG])) for at in range(0, len(low), A_LONG)]


def likeness(x, y, n_hashes: int):
    """Estimated similarity from four-bit minhashes: equal ones, less those equal by chance."""
    apart = F.lit(0)
    for k in range(-(-n_hashes // A_LONG)):
        d = x[k].bitwiseXOR(y[k])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        apart = apart + F.bit_count(d.bitwiseAND(F.lit(0x0111111111111111)))
    return 1 - apart / (15 / 16 * n_hashes)


def describe(docs: DataFrame, k: int, sizes: tuple[int, int]) -> DataFrame:
    """Per document: set size, digest of the set, half keys, four bits of each minhash."""
    n_hashes = sizes[0] * ROWS[0] + sizes[1] * ROWS[1]

    def sets(batches):
        for b in batches:
            n, digest, halves, bits = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                if len(s):
                    m = minhashes(s, n_hashes)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    halves.append(half_keys(m, sizes).view(np.int64).tolist())
                    bits.append(four_bits(m))
                else:
                    digest.append(None), halves.append(None), bits.append(None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(halves, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "halves", "bits"])

    return stored(text_only(docs).mapInArrow(sets, "doc_id long, n long, digest binary, halves array<long>, bits array<long>"), "near-sets")


def table_rows(nodes: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """table, x, rep, n, bits: a row for each pair of half keys, x the first, that a node shares with others."""
    keys = nodes.select("rep", F.posexplode("halves").alias("at", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("key")
    held = keys.join(shared, "key").groupBy("rep").agg(F.collect_list(F.when(F.col("at") < sizes[0], F.col("key"))).alias("a"), F.collect_list(F.when(F.col("at") >= sizes[0], F.col("key"))).alias("b"))
    crossed = held.where("size(a) > 0 and size(b) > 0").join(nodes.select("rep", "n", "bits"), "rep").select("rep", "n", "bits", "b", F.explode("a").alias("x"))
    return stored(crossed.select("rep", "n", "bits", "x", F.explode(F.transform("b", lambda y: F.xxhash64("x", y))).alias("table")), "near-tables")


def bounds(sizes: tuple[int, int], threshold: float) -> tuple[int, float]:
    """The number of minhashes and the least estimate of a candidate."""
    n_hashes = sizes[0] * ROWS[0] + sizes[1] * ROWS[1]
    # an estimate from n minhashes: one pair in thirty thousand at the threshold falls four deviations below it
    return n_hashes, threshold - 4 * math.sqrt((threshold * (1 - threshold) + (1 - threshold) / 15) / n_hashes)


def candidates(rows: DataFrame, sizes: tuple[int, int], threshold: float, before: tuple[int, ...], root: DataFrame | None = None) -> DataFrame:
    """Pairs a < b that stand `before` places apart in a table and are alike enough;
    with roots, only pairs of different ones."""
    n_hashes, least = bounds(sizes, threshold)
    rows = rows.withColumn("root", F.lit(0).cast("long")) if root is None else rows.join(root.toDF("rep", "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    order = Window.partitionBy("table").orderBy(F.xxhash64("rep", "table"), "rep")
    me = F.struct("rep", "n", "bits", "root")
    others = F.array(*[F.lag(me, k).over(order) for k in before])
    wide = rows.withColumn("others", others)

    def good(o):
        sized = F.least(o["n"], F.col("n")) >= F.lit(threshold) * F.greatest(o["n"], F.col("n")) - 1e-6
        apart = o["root"] != F.col("root") if root is not None else F.lit(True)
        return o.isNotNull() & (o["rep"] != F.col("rep")) & sized & apart & (likeness(o["bits"], F.col("bits"), n_hashes) >= least)

    kept = wide.withColumn("others", F.filter("others", good)).where("size(others) > 0").select("rep", "bits", F.explode("others").alias("o"))
    alike = likeness(F.col("o.bits"), F.col("bits"), n_hashes)
    pairs = kept.select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b"), alike.alias("alike"))
    return stored(pairs.groupBy("a", "b").agg(F.first("alike").alias("alike")), "near-pairs", few=True)


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The shingle sets of the named documents."""

    def sets(batches):
        done: set[int] = set()  # rows of one id meet in one task
        for b in batches:
            at = [i for i, d in enumerate(b.column("doc_id").to_pylist()) if not (d in done or done.add(d))]
            some = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([shingles(t.as_py(), k).tobytes() for t in some.column("text")], pa.binary())], names=["id", "grams"])

    texts = text_only(docs).join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text")
    return stored(texts.mapInArrow(sets, "id long, grams binary"), "near-full", batch=1_000)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets."""

    def check(batches):
        for b in batches:
            good, last, x = [], None, None
            for a, sa, sb in zip(b.column("a").to_pylist(), b.column("sa"), b.column("sb")):
                if a != last:
                    last, x = a, np.frombuffer(sa.as_py(), np.uint64)
                y = np.frombuffer(sb.as_py(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                i = int((both[1:] == both[:-1]).sum())
                good.append(100 * i >= percent * (len(both) - i))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = pairs.select("a", "b").join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    return stored(met.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "near-links", batch=256, few=True)


def open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the table keys that neighbours don't settle: more rows than 1 + FARTHER and several
    roots. One row for a node and half key x; lo and hi name the two blocks of x that meet, outside
    says that the row's root isn't the commonest of x."""
    rooted = rows.join(roots.toDF("rep", "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    keys = rooted.groupBy("table").agg(F.count(F.lit(1)).alias("all"), F.min("root").alias("least"), F.max("root").alias("most")).where((F.col("all") > 1 + FARTHER) & (F.col("least") < F.col("most"))).select("table")
    at = stored(rooted.join(keys, "table").groupBy("x", "rep").agg(*[F.first(c).alias(c) for c in ("n", "bits", "root")]), "near-open", few=True)
    top = at.groupBy("x", "root").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("size")).groupBy("x").agg(F.sum("size").alias("all"), F.max(F.struct("held", "root", "size")).alias("top"))
    whole, blocks = F.col("all") <= 2 * BLOCK, lambda n: F.ceil(n / F.lit(BLOCK))
    top = top.select("x", F.col("top.root").alias("top"), F.when(whole, 1).otherwise(F.greatest(F.lit(1), blocks(F.col("all") - F.col("top.size")))).alias("outer"), F.when(whole, 0).otherwise(blocks(F.col("top.size"))).alias("inner"))
    outside, spread = F.col("root") != F.col("top"), F.xxhash64("rep")
    block = F.when(outside | (F.col("inner") == 0), F.pmod(spread, "outer")).otherwise(F.col("outer") + F.pmod(spread, F.greatest("inner", F.lit(1))))
    # rows of the commonest root never meet each other
    last = F.when(outside, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1)
    met = at.join(top, "x").select("x", "rep", "n", "bits", "root", outside.cast("long").alias("outside"), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    return stored(met.select("x", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "n", "root", "block", "outside", "bits"), "near-blocks", few=True)


def crowded_links(rows: DataFrame, sets: DataFrame, sizes: tuple[int, int], percent: int) -> DataFrame:
    """Links that join different roots among open rows: every pair of a pair of blocks that is alike
    enough is tested on the full sets, unless its ends are joined already."""
    plain = [c for c in rows.columns if c != "bits"]
    n_hashes, least = bounds(sizes, percent / 100)

    def meet(g):
        root, n, bits = g["root"].copy(), g["n"], g["bits"]
        xs, ys = np.flatnonzero((g["block"] == g["lo"]) & (g["outside"] == 1)), np.flatnonzero(g["block"] == g["hi"])
        if not len(xs) or not len(ys):
            return
        length = np.array([len(s) // 8 for s in g["grams"]], np.int64)
        start = np.cumsum(length) - length
        ids = flag = None
        for x in xs:
            y = ys[(root[ys] != root[x]) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x]))]
            if not len(y):
                continue
            d = bits[y] ^ bits[x]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            apart = np.bitwise_count(d & np.uint64(0x0111111111111111)).sum(axis=1, dtype=np.int64)
            y = y[1 - apart / (15 / 16 * n_hashes) >= least]
            if not len(y):
                continue
            if ids is None:
                ids = np.unique(np.frombuffer(b"".join(g["grams"]), np.uint64), return_inverse=True)[1]
                flag = np.zeros(int(ids.max()) + 1, np.uint8)
            own = ids[start[x] : start[x] + length[x]]
            flag[own] = 1
            each, ends = length[y], np.cumsum(length[y])
            held = flag[ids[np.arange(ends[-1]) + np.repeat(start[y] - (ends - each), each)]]
            flag[own] = 0
            both = np.add.reduceat(held, ends - each, dtype=np.int64)
            y = y[100 * both >= percent * (each + length[x] - both)]
            roots, first = np.unique(root[y], return_index=True)
            for r, f in zip(roots, first):  # one link for each root met
                yield int(g["rep"][x]), int(g["rep"][y[f]])
            root[np.isin(root, roots)] = root[x]

    def links(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            now = {c: b.column(c).to_numpy() for c in plain}
            now["bits"] = b.column("bits").flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)
            now["grams"] = np.array([*b.column("grams").to_pylist(), None], object)[:-1]
            if rest is not None:
                now = {c: np.concatenate((rest[c], v)) for c, v in now.items()}
            new = np.zeros(len(now["rep"]) - 1, bool)
            for c in ("x", "lo", "hi"):
                new |= now[c][1:] != now[c][:-1]
            start = 0
            for end in (np.flatnonzero(new) + 1).tolist():
                yield from _links(meet({c: v[start:end] for c, v in now.items()}))
                start = end
            rest = {c: v[start:] for c, v in now.items()}
        if rest is not None:
            yield from _links(meet(rest))

    dealt = rows.join(sets.toDF("rep", "grams"), "rep").repartition("x", "lo", "hi").sortWithinPartitions("x", "lo", "hi")
    return stored(dealt.select(*plain, "bits", "grams").mapInArrow(links, "a long, b long"), "near-links", batch=256, few=True)


def _links(found):
    """A batch of the pairs found, the smaller end first, if there are any."""
    if pairs := [(min(p), max(p)) for p in found]:
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root (the smallest node it reaches) for every node of the links.

    At most `one_task` links (pairs of longs, a few MB) go through one union-find; more of them
    through repeated minima and pointer jumps over the whole cluster.
    """
    if links.count() <= one_task:
        return stored(links.select("a", "b").coalesce(1).mapInArrow(_union_find, "node long, root long"), "near-roots")
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "near-edges")
    roots = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "near-roots")
    while True:
        near = both.join(roots.toDF("b", "r"), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        lower = roots.join(near, "node").select("node", F.least("root", "r").alias("next"), "root")
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = stored(lower.join(jump, "next", "left").select("node", F.least(F.col("next"), F.coalesce("far", "next")).alias("root"), F.col("root").alias("was")), "near-roots")
        roots = step.select("node", "root")
        if not step.where("root <> was").limit(1).count():
            return roots


def _union_find(batches):
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(up.setdefault(a, a)), find(up.setdefault(b, b))
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def linked(pairs: DataFrame, links: DataFrame | None, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirms pairs, likeliest first, as long as they would join components; all links and the roots."""
    full = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), k)
    likeliest = Window.partitionBy("b").orderBy(F.desc("alike"), "a")
    left, take = stored(pairs.withColumn("turn", F.row_number().over(likeliest)), "near-left", few=True), FIRST
    roots = components(links) if links is not None else None
    while True:
        more = confirm(left.where(F.col("turn") <= take), full, percent)
        if links is None or more.limit(1).count():
            links = more if links is None else stored(links.union(more), "near-links", few=True)
            roots = components(links)
        rest = left.where(F.col("turn") > take).select("a", "b", "alike")
        joined = rest.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
        apart = joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "alike")
        left, take = stored(apart.withColumn("turn", F.row_number().over(likeliest)), "near-left", few=True), take * GROWTH
        if not left.limit(1).count():
            return links, roots


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the first of its component) for every document."""
    with scratch(docs.sparkSession) as result:
        return result(_near_duplicates(docs, percent, k), "near-duplicates", few=True)


def _near_duplicates(docs: DataFrame, percent: int, k: int) -> DataFrame:
    sizes = collections(percent / 100)
    sets = describe(docs, k, sizes)
    named = sets.where("n > 0 and doc_id is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.first("bits").alias("bits"))
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = stored(looked_up(named.select("doc_id", "digest"), "digest", firsts, by="doc_id").select("doc_id", "rep").distinct(), "near-members", few=True)
    nodes = stored(classes.select("rep", "n", "halves", "bits"), "near-nodes", few=True)
    tables = table_rows(nodes, sizes)
    links, roots = linked(candidates(tables, sizes, percent / 100, (1,)), None, docs, k, percent)
    release(docs.sparkSession)
    farther = candidates(tables, sizes, percent / 100, (FARTHER,), roots)
    if farther.limit(1).count():
        links, roots = linked(farther, links, docs, k, percent)
    crowded = open_rows(tables, roots)
    if crowded.limit(1).count():
        release(docs.sparkSession)
        more = crowded_links(crowded, full_sets(docs, crowded.select(F.col("rep").alias("doc_id")).distinct(), k), sizes, percent)
        if more.limit(1).count():
            roots = components(stored(links.union(more), "near-links", few=True))
    home = members.join(roots.toDF("rep", "root"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(home, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op6_tensored_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stand first in their group of near duplicates, with their own columns.

    Of rows that share doc_id and text, null ids included, one stays, whatever their other columns hold.
    """
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col("gone_id"), "left_anti").dropDuplicates(["doc_id", "text"])
