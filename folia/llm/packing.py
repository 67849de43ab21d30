"""Sequence packing by minimum bin slack.

A document is its token ids and an end id. It is cut into full windows and a remainder, and all
pieces are dealt to windows of `capacity` tokens. What the plan needs of the corpus is the number
of pieces of each length, at most `capacity` numbers whatever the input. Each step takes the
longest remaining length, finds by a bitset subset-sum over the remaining multiset the fill
closest to the capacity, backtracks how many pieces of each length it uses, and repeats that
fill as often as the counts allow. A plan has a few thousand fills at most.

Pieces find their place by their rank within their length: a rank inside (scan partition,
length) plus the count of that length in earlier partitions, so a length that a third of all
rows share is never ranked in one task.

Defined results: null text is an empty document (its end id alone); repeated rows are packed as
documents of their own; a text is encoded whole whatever its length and its ids are cut into pieces; pieces
of one length go by doc_id, start and checksum; an empty table has no pieces; of the columns only doc_id and
text are read, so others may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pieces import encoder, vocabulary
from ._util import stored, table, text_only

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset with the longest remaining length whose sum is closest to the capacity from below."""
    seed = max(counts)
    target = capacity - seed
    mask = (1 << (target + 1)) - 1
    bits, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > target:
            continue
        free = counts[length] - (length == seed)
        before, used = bits, 0
        while used < min(free, target // length):
            more = (bits | bits << length) & mask
            if more == bits:
                break
            bits, used = more, used + 1
            if bits >> target & 1:
                break
        steps.append((length, before, used))
        if bits >> target & 1:
            break
    left = bits.bit_length() - 1
    uses = {seed: 1}
    for length, before, used in reversed(steps):
        n = 0
        while not before >> left & 1:
            left, n = left - length, n + 1
        if n:
            uses[length] = uses.get(length, 0) + n
    return uses


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fills with how often each is made; together they use every piece once."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        uses = fill(left, capacity)
        times = min(left[k] // n for k, n in uses.items())
        out.append((uses, times))
        for k, n in uses.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(fills: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, pieces a sequence and first offset of each run of ranks."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for uses, times in fills:
        offset = 0
        for length, n in uses.items():
            runs.setdefault(length, []).append((rank.get(length, 0), sequence, n, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def cut(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document, with the scan partition that made them."""

    def pieces(batches):
        enc, part = encoder(vocabulary_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.encode([t.as_py()])[0] + end
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    for r, v in zip(rows, (d, at, len(piece) // 4, zlib.crc32(piece), total)):
                        r.append(v)
            cols = [pa.array(r, pa.int64()) for r in rows] + [pa.array([part] * len(rows[0]), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"])

    return text_only(docs).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = stored(cut(docs, vocabulary_path, end_id, capacity), "pieces")
    each = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    before = each.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("part", "length", "base")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "start", "ids_crc32"))).join(before, ["part", "length"])

    def place(batches):
        at = where.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("base").to_numpy() + b.column("rank").to_numpy() - 1
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                first, seq, n, off = at[int(k)]
                run = np.searchsorted(first, rank[own], "right") - 1
                within = rank[own] - first[run]
                sequence[own] = seq[run] + within // n[run]
                offset[own] = off[run] + within % n[run] * k
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    cols = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "base", "rank")
    return cols.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
