"""Spelling variants: a distance-one Levenshtein automaton against trie shards.

Words are counted over all texts. The sorted words are cut into shards of SHARD characters at most
(one word more where it alone is longer), each a trie whose single branches stay text; tasks build
the shards and write them. The driver broadcasts them one at a time. A word's automaton then runs
depth-first through the shard: along the word itself with its one edit unspent, and from every node
of that path along each edge that spends it. Edits are taken in one canonical place (the last
character of a run is deleted, a character is inserted behind its equals), so each neighbour is met
once. Shards are ranges of the sorted words, so a word leaves most of them at their first edges.
Per shard a word has its number of neighbours and its best one; counts and best forms are reduced
over the shards. Roots follow by doubling: each round a root's root takes its place.

Defined results: null text has no words, a null doc_id counts as empty in the checksum; runs of any
length are read whole; rows that repeat count each; of neighbours with the largest count the
smallest in code-point order is the form; columns beside doc_id and text are not read, whatever
their names; an empty table, or one without words, gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ._util import scratch, stored, table

# Fixed values of the contract.
RUN = re.compile("[a-zÀ-ÿ]+")
EVERY, LETTERS, OCCURRENCES, TIMES = 97, 5, 3, 2

SHARD = 2_000_000
FLUSH = 200_000
ROWS = 20_000  # words a task intersects with a shard


def counted(docs: DataFrame, least: int = LETTERS) -> DataFrame:
    """word, n over all texts, for words of at least `least` characters after the contract's deletions."""

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = f"{'' if doc_id is None else doc_id}:"
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32((own + run).encode())
                    if h % EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least:
                        held[run] += n
                if len(held) > FLUSH:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    texts = docs.where("text is not null").select("doc_id", "text")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Sorted words, a byte a character (Latin-1), as nodes numbered by level: the edges of node x lead to
    nodes first[x] to first[x + 1] - 1, labels holds a node's edge, word the word that ends there. A node
    without edges has one word, the rest of which is compared as text."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.text, self.counts = b"".join(words), array("q", counts)
        self.start = array("q", [0])
        for w in words:
            self.start.append(self.start[-1] + len(w))
        labels, self.first, self.word = bytearray(1), array("q"), array("q")
        level, depth, nodes = [(0, len(words))], 0, 1
        while level:
            below = []
            for lo, hi in level:
                self.first.append(nodes)
                if hi - lo == 1:
                    self.word.append(lo)
                    continue
                ends = len(words[lo]) == depth
                self.word.append(lo if ends else -1)
                lo += ends
                while lo < hi:
                    c, at = words[lo][depth], lo + 1
                    while at < hi and words[at][depth] == c:
                        at += 1
                    labels.append(c)
                    below.append((lo, at))
                    nodes += 1
                    lo = at
            level, depth = below, depth + 1
        self.first.append(nodes)
        self.labels = bytes(labels)

    def _exact(self, node: int, depth: int, w: bytes, i: int) -> int:
        """The word that continues as w[i:] below a node, or -1; no edit is left."""
        while True:
            lo, hi = self.first[node], self.first[node + 1]
            if lo == hi:
                k = self.word[node]
                return k if self.text[self.start[k] + depth : self.start[k + 1]] == w[i:] else -1
            if i == len(w):
                return self.word[node]
            node = self.labels.find(w[i], lo, hi)
            if node < 0:
                return -1
            i, depth = i + 1, depth + 1

    def neighbours(self, w: bytes) -> list[int]:
        """The words at distance one of w, each once."""
        found, node, i, n = [], 0, 0, len(w)
        first, labels = self.first, self.labels
        while True:
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                k = self.word[node]
                if _one_apart(self.text[self.start[k] + i : self.start[k + 1]], w[i:]):
                    found.append(k)
                break
            own = w[i] if i < n else -1
            if i < n and (i + 1 == n or w[i + 1] != own):
                found.append(self._exact(node, i, w, i + 1))
            for c in range(lo, hi):
                if labels[c] != own:
                    found.append(self._exact(c, i + 1, w, i))
                    if i < n:
                        found.append(self._exact(c, i + 1, w, i + 1))
            if i == n:
                break
            node = labels.find(own, lo, hi)
            if node < 0:
                break
            i += 1
        return [k for k in found if k >= 0]

    def best(self, w: bytes) -> tuple[int, int, bytes] | None:
        """The number of neighbours, the largest count among them, and the first word that has it."""
        near = self.neighbours(w)
        if not near:
            return None
        k = min(near, key=lambda k: (-self.counts[k], k))
        return len(near), self.counts[k], self.text[self.start[k] : self.start[k + 1]]


def _one_apart(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # the length of the common start
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def shards(words: DataFrame, size: int = SHARD) -> DataFrame:
    """words, counts: the parts of the sorted words, each of about `size` characters at most."""

    def cut(batches):
        words, counts, held = [], [], 0
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                if words and held + len(w) > size:
                    yield batch(words, counts)
                    words, counts, held = [], [], 0
                words.append(w)
                counts.append(n)
                held += len(w)
        if words:
            yield batch(words, counts)

    def batch(words, counts):
        return pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], names=["words", "counts"])

    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = -(-chars // size) or 1
    dealt = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    return stored(dealt.mapInArrow(cut, "words array<string>, counts array<long>"), "spelling-shards", batch=1)


def _full(parts: Iterator[Row], size: int) -> Iterator[list[tuple[str, int]]]:
    """Sorted words and counts of as many shards as hold `size` characters, so that small ones cost no job each."""
    held, chars = [], 0
    for part in parts:
        held += zip(part["words"], part["counts"])
        chars += sum(map(len, part["words"]))
        if chars >= size:
            yield sorted(held)
            held, chars = [], 0
    if held:
        yield sorted(held)


def neighbours(words: DataFrame, size: int = SHARD) -> DataFrame:
    """word, n_near, form_n, form (the neighbour of largest count, the smallest of them) of words that have neighbours."""
    spark, parts = words.sparkSession, []
    spread = stored(words.select("word").repartition(-(-words.count() // ROWS) or 1), "spelling-words")
    for held in _full(shards(words, size).toLocalIterator(), size):
        # bounded by twice the size; one is held at a time
        trie = spark.sparkContext.broadcast(Trie([w.encode("latin-1") for w, _ in held], [n for _, n in held]))

        def intersect(batches, trie=trie):
            for b in batches:
                asked = b.column("word").to_pylist()
                found = [(w, *best) for w in asked if (best := trie.value.best(w.encode("latin-1")))]
                columns = [[r[k] for r in found] for k in range(3)] + [[r[3].decode("latin-1") for r in found]]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n_near", "n", "near"])

        parts.append(stored(spread.mapInArrow(intersect, "word string, n_near long, n long, near string"), "spelling-near"))
        trie.unpersist()
    if not parts:
        return spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    met = parts[0]
    for more in parts[1:]:
        met = met.unionByName(more)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("form")))
    reduced = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return reduced.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form, from (word, form): forms followed to the last, twice as far each round.

    A word that is a form itself is near few words, so a root gathers few at each step.
    """
    now = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("shuffle_hash"), "root", "left")
        step = stored(far.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the texts."""
    with scratch(docs.sparkSession) as result:
        words = stored(counted(docs).where(F.col("n") >= OCCURRENCES), "spelling-counts")
        joined = words.join(neighbours(words, size).hint("shuffle_hash"), "word", "left")
        good = F.col("form_n") >= TIMES * F.col("n")
        formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
        formed = stored(formed, "spelling-forms")
        joined = formed.join(roots(formed).hint("shuffle_hash"), "word", "left")
        return result(joined.withColumn("root", F.coalesce("root", "word")), "spelling")


def op11_trie_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
