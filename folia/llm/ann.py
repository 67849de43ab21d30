"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector has its own codebook of CENTROIDS centroids, fitted by k-means on a bounded
sample (SAMPLE vectors, the smallest hashes of their ids); every vector is indexed under its pair
of centroids. A query walks the pairs by summed nearness of its halves with a heap, until the
pairs met hold the share SHARE of the index (FEW * k entries at least, so that k of them come, and
`least`, a parameter that is 0 unless given), and the entries found are ranked again by exact inner
products in double precision. The share is large because it is set for a recall of 0.9 on vectors
without clusters, where pairs say little; clustered data need less.

Pairs are dealt to blocks of about BLOCK entries, a large pair (one vector repeated) to several,
and a query goes to the blocks that hold pairs it met, with their bitmap. Entries move once. A task
holds the entries of one block and lets its queries stream past, so neither the number of queries
nor a repeated vector widens what is held. The tables of pairs have CENTROIDS ** 2 rows at most,
which bounds what is broadcast.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, as query or candidate; a row is never its own neighbour, nor
is a row with its id; ties go to the smaller vec_id; with fewer candidates than k all that its pairs
hold come; a repeated vec_id is a candidate (and a query) for each of its rows, which share one ranking;
of the columns only vec_id and embedding are read, so others may have any name; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import partitions_for, stored, table

SAMPLE = 8_192
CENTROIDS = 64
SHARE = 0.55
FEW = 4
BLOCK = 4_096
ROUNDS = 12


def usable(vectors: DataFrame, width: int) -> DataFrame:
    v = F.col("v")
    ok = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(ok, F.lit(False)))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's iterations from distinct rows; an emptied centroid moves to the row farthest from its own."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))]
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            far = np.argsort(-(d[np.arange(len(x)), own]))[: (n == 0).sum()]
            c[n == 0] = x[far]
    return c


def codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * x @ book.T).argmin(1)


def walk(a: np.ndarray, b: np.ndarray, size: list[int], enough: int) -> list[int]:
    """Pairs by descending a[i] + b[j] (nearness of the query's halves to the centroids) until they hold enough.

    A row of the grid enters the heap when the row before it starts, a pair when its left neighbour leaves.
    """
    oa, ob = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b, wide = (-a[oa]).tolist(), (-b[ob]).tolist(), len(b)
    heap, out, held, pop, push = [(a[0] + b[0], 0, 0)], [], 0, heapq.heappop, heapq.heappush
    while heap and held < enough:
        _, i, j = pop(heap)
        pair = oa[i] * wide + ob[j]
        if size[pair]:
            out.append(pair)
            held += size[pair]
        if j + 1 < wide:
            push(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            push(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, every: int = 20, k: int = 20, share: float = SHARE, least: int = 0) -> DataFrame:
    """Queries: rows whose vec_id is divisible by `every`. query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    widths = raw.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], out)
    width = widths[0]["w"]
    good = usable(raw, width)
    half = (width + 1) // 2
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], out)
    x = _matrix(sample.column("v").combine_chunks())
    books = spark.sparkContext.broadcast((kmeans(x[:, :half], CENTROIDS), kmeans(x[:, half:], CENTROIDS) if width > half else np.zeros((1, 0))))

    def index(batches):
        one, two = books.value
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"))
                pair = codes(m[:, :half], one).astype(np.int64) * len(two) + (codes(m[:, half:], two) if m.shape[1] > half else 0)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(pair.astype(np.int32))], names=["vec_id", "v", "pair"])

    entries = stored(good.mapInArrow(index, "vec_id long, v array<double>, pair int"), "multi-index")
    sizes = np.zeros(len(books.value[0]) * len(books.value[1]), np.int64)
    for r in entries.groupBy("pair").count().collect():  # at most CENTROIDS ** 2 rows
        sizes[r["pair"]] = r["count"]
    enough = max(least, FEW * k, int(np.ceil(share * sizes.sum())))
    # neighbouring small pairs share a block, a large pair has blocks of its own
    many = np.maximum(1, -(-sizes // BLOCK))
    first, at, held = np.zeros(len(sizes), np.int64), 0, 0
    for p, n in enumerate(sizes):
        if held and held + n > BLOCK:
            at, held = at + 1, 0
        first[p] = at
        if many[p] > 1:
            at, held = at + int(many[p]), 0
        else:
            held += int(n)
    n_blocks = at + 1
    tables = spark.sparkContext.broadcast((sizes, first, many))

    def deal(batches):
        _, first, many = tables.value
        for b in batches:
            pair = b.column("pair").to_numpy()
            block = first[pair] + np.arange(len(pair)) % many[pair]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), b.column("vec_id"), b.column("v"), b.column("pair")], names=["block", "id", "v", "pair"])

    def probe(batches):
        (one, two), (sizes, first, many) = books.value, tables.value
        size = sizes.tolist()
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"))
            rows, blocks, bits = [], [], []
            for k, (p, q) in enumerate(zip(m[:, :half] @ one.T, m[:, half:] @ two.T)):
                met = np.array(walk(p, q, size, enough))
                bitmap = np.zeros(len(sizes), bool)
                bitmap[met] = True
                own = {int(f) + i for f, n in zip(first[met], many[met]) for i in range(n)}
                rows += [k] * len(own)
                blocks += sorted(own)
                bits += [np.packbits(bitmap).tobytes()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), b.column("vec_id").take(pa.array(rows)), b.column("v").take(pa.array(rows)), pa.array(bits, pa.binary())], names=["block", "id", "v", "bits"])

    asks = entries.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select("vec_id", "v")
    asked = asks.mapInArrow(probe, "block int, id long, v array<double>, bits binary").withColumn("pair", F.lit(None).cast("int"))
    dealt = entries.mapInArrow(deal, "block int, id long, v array<double>, pair int").withColumn("bits", F.lit(None).cast("binary"))
    # entries of a block first, then its queries
    met = dealt.unionByName(asked).withColumn("asks", F.col("bits").isNotNull()).repartition(max(partitions_for(spark), n_blocks), "block").sortWithinPartitions("block", "asks")

    def rank(batches):
        held, parts, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            own, ask = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((own[1:] != own[:-1]) | (ask[1:] != ask[:-1])) + 1
            for z, e in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                if own[z] != block:
                    held, parts, block = None, [], own[z]
                some = b.slice(z, e - z)
                if not ask[z]:
                    parts.append((some.column("id").to_numpy(), some.column("pair").to_numpy(), _matrix(some.column("v"))))
                    continue
                if held is None and parts:
                    held = [np.concatenate(p) for p in zip(*parts)]
                    order = np.argsort(held[0], kind="stable")
                    held = [h[order] for h in held]
                for i in range(0, some.num_rows if held else 0, 256):
                    yield _nearest(some.slice(i, 256), *held, k)

    near = met.select("block", "id", "v", "pair", "bits", "asks").mapInArrow(rank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(asks: pa.RecordBatch, ids: np.ndarray, pair: np.ndarray, m: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of a block's entries (by ascending id) among the pairs that each query met."""
    who, q = asks.column("id").to_numpy(), _matrix(asks.column("v"))
    met = np.unpackbits(np.frombuffer(b"".join(asks.column("bits").to_pylist()), np.uint8).reshape(len(q), -1), axis=1).astype(bool)
    s = q @ m.T
    s[~met[:, pair] | (who[:, None] == ids[None, :])] = -np.inf
    # what ties with the k-th stays in until scores are taken by one fixed summation
    kth = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else np.full((len(q), 1), -np.inf)
    r, c = np.nonzero((s >= kth - 1e-9) & np.isfinite(s))
    score = np.einsum("ij,ij->i", q[r], m[c])
    best = np.lexsort((ids[c], -score, r))
    r, c, score = r[best], c[best], score[best]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return pa.RecordBatch.from_arrays([pa.array(who[r[keep]]), pa.array(ids[c[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])


def op9_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
