"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of the benchmark items (an item with
fewer words, but not none, is one window). Patterns of one length form one matcher: a shift
table over blocks of the last two words tells how far the search may jump, a bucket of patterns
per block confirms by direct comparison. Most blocks of a text occur in no pattern, so about
one block in nine is looked at.

The benchmark is read in shards of at most SHARD_WORDS words, so what a task holds is bounded
whatever the benchmark's size, the driver included, which holds one shard at a time; the documents
are searched once per shard, and the hits of each are stored before the next is read.

Defined results: null or word-free text has no words and no hits; items that are null, empty or
word-free have no windows; repeated item ids count once; repeated documents give a row each;
an empty benchmark leaves every document clean; texts are searched whole whatever their length; of
equal windows every item counts; of the columns only doc_id and text (item_id and text) are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import stored, table, text_only

SHARD_WORDS = 500_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
HITS = "doc_id long, n_words long, hits array<int>, items array<string>"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


class WuManber:
    """Matcher for word patterns of one length m."""

    def __init__(self, m: int, patterns: dict[tuple[str, ...], set[str]]):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict[tuple[str, ...] | str, int] = {}
        self.bucket: dict[tuple[str, ...] | str, list[tuple[tuple[str, ...], set[str]]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = self._key(p, end)
                self.shift[key] = min(self.shift.get(key, self.most), m - end)
            self.bucket.setdefault(self._key(p, m), []).append((p, items))

    def _key(self, p, end: int):
        return (p[end - 2], p[end - 1]) if self.block == 2 else p[end - 1]

    def find(self, w: list[str]) -> Iterator[tuple[int, set[str]]]:
        """Starts of occurrences and the items that hold the window there."""
        m, n, most, get, two = self.m, len(w), self.most, self.shift.get, self.block == 2
        end = m
        while end <= n:
            key = (w[end - 2], w[end - 1]) if two else w[end - 1]
            jump = get(key, most)
            if jump:
                end += jump
                continue
            here = tuple(w[end - m : end])
            for p, items in self.bucket[key]:
                if p == here:
                    yield end - m, items
            end += 1


def matchers(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    by: dict[int, dict[tuple[str, ...], set[str]]] = {}
    for item, text in items:
        w = words(text)
        if w:
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                by.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
    return [WuManber(m, p) for m, p in sorted(by.items())]


def spans(w: list[str], found: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [start, end) word spans of all occurrences, and the items met."""
    hits, items = [], set()
    for k in found:
        for at, who in k.find(w):
            hits.append((at, at + k.m))
            items |= who
    merged: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


def _shards(benchmark: DataFrame, shard_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in bounded shards; each shard is what one search broadcasts."""
    part, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        part.append((r.i, r.t))
        size += len(r.t) // 2 + 1
        if size >= shard_words:
            yield part
            part, size = [], 0
    if part:
        yield part


_held: dict[str, list[WuManber]] = {}


def _ready(key: str, shared: Broadcast, window: int) -> list[WuManber]:
    """A shard's matchers, built once in a Python worker and kept until it works on another shard."""
    if key not in _held:
        _held.clear()
        _held[key] = matchers(shared.value, window)
    return _held[key]


def occurrences(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """Per document: words, merged spans as a flat list, items met."""
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def search(batches):
        found = _ready(key, shared, window)
        for b in batches:
            out = []
            for t in b.column("text"):
                w = words(t.as_py())
                m, met = spans(w, found)
                out.append((len(w), [x for s in m for x in s], sorted(met)))
            cols = [b.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "hits", "items"])

    return docs.mapInArrow(search, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (flat word offsets)."""
    shards = _shards(benchmark, shard_words)
    first, second = next(shards, []), next(shards, None)
    if second is None:
        found = occurrences(text_only(docs), first, window)
    else:
        # a key of its own for every row, as doc_id may repeat
        keyed = stored(text_only(docs).select(F.monotonically_increasing_id().alias("k"), F.col("doc_id").alias("id"), "text"), "decontaminate")
        asked = keyed.select(F.col("k").alias("doc_id"), "text")
        base = stored(occurrences(asked, first, window), "decontaminate-hits")
        each = base.where("size(hits) > 0")
        for part in itertools.chain([second], shards):
            each = each.unionByName(stored(occurrences(asked, part, window).where("size(hits) > 0"), "decontaminate-hits"))
        merged = each.groupBy("doc_id").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        named = keyed.select(F.col("k").alias("doc_id"), "id").join(base.select("doc_id", "n_words"), "doc_id").join(merged, "doc_id", "left")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
        found = named.select(F.col("id").alias("doc_id"), "n_words", none("hits", "array<int>"), none("items", "array<string>"))

    def digest(batches):
        for b in batches:
            n_hit, sha, n_items, flat = [], [], [], []
            for h, i in zip(b.column("hits").to_pylist(), b.column("items").to_pylist()):
                runs: list[list[int]] = []
                for a, z in sorted(zip(h[::2], h[1::2])):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(z, runs[-1][1])
                    else:
                        runs.append([a, z])
                n_hit.append(sum(z - a for a, z in runs))
                flat.append([x for r in runs for x in r])
                n_items.append(len(i))
                sha.append(hashlib.sha256(",".join(sorted(i)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(flat, pa.list_(pa.int32()))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with their own columns.

    One scan for each shard: what one shard leaves is stored before the next, so a task holds one shard's matchers.
    """
    for k, items in enumerate(_shards(benchmark, shard_words)):
        docs = _without(stored(docs, "decontaminate-left") if k else docs, items, window)
    return docs


def _without(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def search(batches):
        found = _ready(key, shared, window)
        for b in batches:
            texts = b.column(b.schema.names.index("text"))
            clean = []
            for t in texts:
                w = words(t.as_py())
                clean.append(not any(next(k.find(w), None) for k in found))
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(search, docs.schema)


def op10_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
