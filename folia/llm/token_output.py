"""Token ids in a binary table, compressed by a Re-Pair grammar per shard.

Documents go to range partitions by doc_id, so shards are in ascending doc_id order. A shard
holds about SHARD_TOKENS ids. Frequent id pairs are replaced by nonterminals, many pairs a round
when they can't meet in one place, until no pair is met LEAST times (a rule that is met less often
costs more than it saves). Pairs never cross documents, so
with each document's first symbol and the rules' expansion lengths any document, or any id of
it, is decoded alone.

Shard layout, little-endian: b"RPR1", then unsigned 32-bit n_docs, n_rules, base, width; then
doc_id int64[n_docs], first symbol of each document uint32[n_docs + 1], rules' left uint32[n_rules],
right uint32[n_rules], expansion lengths uint32[n_rules], symbols (width bytes each). Symbol s is
the id s below base, else rule s - base. The table has a row a shard: part, block, n_tokens, shard.

Defined results: null text is empty (its end id alone); repeated rows are written as documents
of their own; texts are encoded whole whatever their length, and of them only ids stay in a task; of
pairs met equally often the one with the smaller symbols is replaced first, which changes no id that is read
back; of the columns only doc_id and text are read, so others may have any name; an empty table
gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pieces import encoder, slices, vocabulary
from ._util import partitions_for, stored, table, text_only

SHARD_TOKENS = 2_000_000
LEAST = 24
A_ROUND = 4096
SLOTS = 18


class _Chain:
    """Symbols in a row of which some are gone: how far it is to the next one and back, and where a frequent pair may begin."""

    def __init__(self, seq: np.ndarray, last: np.ndarray):
        self.seq, self.last, self.open = seq.copy(), last.copy(), ~last
        self.step, self.back, self.gone = np.ones(len(seq), np.int32), np.ones(len(seq) + 1, np.int32), np.zeros(len(seq), bool)
        self.back[0] = 0

    def replace(self, place: np.ndarray, new: np.ndarray) -> None:
        """The pairs that begin at `place` become new symbols."""
        second = place + self.step[place]
        after = second + self.step[second]
        self.seq[place], self.last[place], self.gone[second] = new, self.last[second], True
        self.step[place] = self.back[after] = after - place
        before = place - self.back[place]
        self.open[second] = False
        for k in (place, before):
            self.open[k] = ~self.last[k]


def _round(chain: _Chain, rules: list, base: int, least: int, most: int) -> bool:
    """Replace the frequent pairs of one round; False when there are none.

    No pair is met more often than before unless it holds a new symbol, so after a round only the
    places of what was frequent and those beside new symbols stay open.
    """
    kind, bits = (np.uint32, 16) if base + len(rules) <= 1 << 16 else (np.uint64, 32)  # symbols are below 2 ** bits
    at = np.flatnonzero(chain.open)
    if not len(at):
        return False
    pair = chain.seq[at].astype(kind) << kind(bits) | chain.seq[at + chain.step[at]].astype(kind)
    keys = np.sort(pair)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.append(edge, len(keys)))
    often = np.flatnonzero(n >= least)
    if not len(often):
        return False
    frequent = keys[edge[often]]
    lefts, rights, chosen = set(), set(), []
    for k in frequent[np.argsort(-n[often], kind="stable")][:most].tolist():
        a, b = k >> bits, k & ((1 << bits) - 1)
        if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(k)
    picked = np.array(sorted(chosen), kind)

    def slot(pairs: np.ndarray) -> np.ndarray:
        return pairs * kind(0x9E3779B1) >> kind(2 * bits - SLOTS)

    # a place's slot tells whether its pair is frequent (1) or which rule it may get; the few that share a slot are searched
    table = np.zeros(1 << SLOTS, np.int16)
    table[slot(frequent)] = 1
    table[slot(picked)] = np.arange(len(picked)) + 2
    mark = table[slot(pair)]
    chain.open[at] = mark > 0
    near = np.flatnonzero(mark > 1)
    place, met, where = at[near], pair[near], mark[near] - 2
    other = np.flatnonzero(picked[where] != met)
    where[other] = np.minimum(np.searchsorted(picked, met[other]), len(picked) - 1)
    if len(none := other[picked[where[other]] != met[other]]):
        place, where = np.delete(place, none), np.delete(where, none)
    start = np.concatenate(([True], place[1:] != place[:-1] + chain.step[place[:-1]]))
    if not start.all():  # only a pair of equal ids can overlap itself: take every other one of a run
        first = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
        even = (np.arange(len(place)) - first) % 2 == 0
        place, where = place[even], where[even]
    chain.replace(place, base + len(rules) + where.astype(np.uint32))
    rules.extend((k >> bits, k & ((1 << bits) - 1)) for k in picked.tolist())
    return True


def compress(seq: np.ndarray, last: np.ndarray, base: int, least: int = LEAST):
    """Symbols, ends of documents among them (the last symbol is one), and rules; in the end no pair is met `least` times."""
    rules: list[tuple[int, int]] = []
    chain = _Chain(seq, last)
    while _round(chain, rules, base, least, A_ROUND):
        pass
    kept = np.flatnonzero(~chain.gone)
    return chain.seq[kept], chain.last[kept], rules


def lengths_of(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    out: list[int] = []
    for a, b in zip(left.tolist(), right.tolist()):
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.int64)


def write_shard(doc_ids: list, ids: list[np.ndarray], base: int) -> bytes:
    seq = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum([len(x) for x in ids]) - 1] = True
    seq, last, rules = compress(seq, last, base)
    left = np.array([a for a, _ in rules], np.uint32)
    right = np.array([b for _, b in rules], np.uint32)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    first = np.concatenate(([0], np.flatnonzero(last) + 1)).astype("<u4")
    head = struct.pack("<4s4I", b"RPR1", len(doc_ids), len(rules), base, width)
    parts = [np.array([d if d is not None else -(1 << 63) for d in doc_ids], "<i8"), first, left.astype("<u4"), right.astype("<u4"), lengths_of(left, right, base).astype("<u4"), seq.astype(f"<u{width}")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Random access to the documents of a written shard."""

    def __init__(self, blob: bytes):
        magic, n_docs, n_rules, self.base, width = struct.unpack_from("<4s4I", blob)
        if magic != b"RPR1":
            raise ValueError("not a shard")
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.first = take("<i8", n_docs), take("<u4", n_docs + 1)
        self.left, self.right, self.lengths = take("<u4", n_rules), take("<u4", n_rules), take("<u4", n_rules).astype(np.int64)
        self.symbols = np.frombuffer(blob, f"<u{width}", -1, at)
        # the ids of every symbol in a row: of ids themselves, then of rules
        self.size = np.concatenate((np.ones(self.base, np.int64), self.lengths))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.arange(self.size.sum(), dtype="<u4")
        at, size = self.start.tolist(), self.size.tolist()
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist()), self.base):
            p = at[i]
            for s in (a, b):
                self.flat[p : p + size[s]] = self.flat[at[s] : at[s] + size[s]]
                p += size[s]

    def _expand(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, and how many each symbol stands for."""
        n = self.size[s]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.start[s] - end + n, n) + np.arange(n.sum())], n

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, without decoding the others."""
        return self._expand(self.symbols[self.first[k] : self.first[k + 1]])[0]

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in order, and where each begins and the last ends."""
        ids, n = self._expand(self.symbols)
        return ids, np.concatenate(([0], np.cumsum(n)))[self.first]


def write_ids(docs: DataFrame, vocabulary_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The written table of shards: part, block, n_tokens, shard."""
    ordered = text_only(docs).repartitionByRange(partitions_for(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def shards(batches):
        enc, part, block = encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        base = enc.tokenizer.get_vocab_size()
        who: list = []
        ids: list[np.ndarray] = []
        held = 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.array([write_shard(who, ids, base)], pa.binary())], names=["part", "block", "n_tokens", "shard"])

        for b in batches:
            for some in slices(b, "text"):
                flat, at = enc.flat(some.column("text"))
                flat, at = np.insert(flat, at[1:], end_id), (at + np.arange(len(at))).tolist()
                for d, first, end in zip(some.column("doc_id").to_pylist(), at, at[1:]):
                    if who and held + end - first > shard_tokens:
                        yield row()
                        who, ids, held, block = [], [], 0, block + 1
                    who.append(d)
                    ids.append(flat[first:end])
                    held += end - first
        if who:
            yield row()

    return stored(ordered.mapInArrow(shards, "part int, block int, n_tokens long, shard binary"), "token-ids")


def read_ids(shards: DataFrame) -> DataFrame:
    """Per document, decoded from the shards: doc_id, start, n_tokens, ids_crc32."""
    sizes = shards.select("part", "block", "n_tokens")
    # ids before a partition: a running sum over one row a partition; inside it over its shards
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("ahead", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "ahead")
    starts = sizes.join(parts, "part").select("part", "block", (F.col("ahead") + F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("base"))

    def decode(batches):
        for b in batches:
            for part, block, blob in zip(b.column("part").to_pylist(), b.column("block").to_pylist(), b.column("shard")):
                s = Shard(blob.as_py())
                x, at = s.all_ids()
                body, n = memoryview(x.tobytes()), np.diff(at)
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                ids = pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == -(1 << 63))
                same = [pa.array([v] * len(n), pa.int32()) for v in (part, block)]
                yield pa.RecordBatch.from_arrays([*same, ids, pa.array(at[:-1]), pa.array(n), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"])

    each = shards.select("part", "block", "shard").mapInArrow(decode, "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return each.join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op3_re_pair_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))
