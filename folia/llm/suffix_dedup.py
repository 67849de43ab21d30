"""Removal of every byte inside a `span`-byte string that starts at two places or more.

Every start of a `span`-byte window belongs to the run of starts whose leftmost smallest 32-gram,
among the first WINDOW of the window, is the same one. What that picks depends on the window's
own bytes alone, so equal windows anywhere have the same 32-gram at the same distance, and share
the core: the bytes from it that every window of a run holds. Runs whose core occurs once hold no
repeat. Runs whose whole block (all bytes of the run's windows) occurs again repeat throughout;
cores and blocks are hashed by two independent families. What is left are runs at the rims of
repeats. Those, and one run of each repeated block with their core, go to the suffix sort:

  the windows' bytes are laid out with prefix polynomial hashes; suffixes that share core and
  distance are merge-sorted, where a comparison finds the common extension by binary search on
  prefix hashes, so it takes log(span) steps; neighbours that agree over the whole span repeat,
  after their bytes are compared directly.

Work is dealt out by core; a task sorts whole cores together until they pass BATCH bytes, and compares
the bytes of PAIRS neighbours at once. A core that more than HOT runs share is not gathered: its runs are cut
into steps of STEP windows, which are settled by the hashes of their own cores and blocks in the
same way; windows of what is still open are counted by hash. All counts are sums that are taken
before rows are shuffled, and a document's equal runs are one row from the start.

Defined results: null text is empty; texts shorter than the span lose nothing; repeated rows
repeat each other, and all of them lose the bytes; texts are judged whole whatever their length, a run of
windows at a time; equal windows decide alike, so there are no ties; of the columns only doc_id and text are
read, so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _hash
from ._hash import between, mix, prefix
from ._util import partitions_for, release, stored, table, text_only

GRAM, WINDOW = 32, 192
SPAN = 400
HOT = 2_000
STEP = 8
BATCH = 500_000
PAIRS = 2_000


def runs(data: np.ndarray, span: int = SPAN, window: int = WINDOW):
    """First and last start of each run, its 32-gram, and the hashes of core and block; None for short data."""
    n = len(data)
    if n < span:
        return None
    pre = prefix(data)
    at = np.arange(n - GRAM + 1)
    key = (mix(between(pre, at, at + GRAM)) >> np.uint64(32)) << np.uint64(32) | at.astype(np.uint64)
    m, have = key, 1
    while have < window:
        step = min(have, window - have)
        m, have = np.minimum(m[:-step], m[step:]), have + step
    q = (m[: n - span + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    hi = np.append(lo[1:], len(q)) - 1
    gram = q[lo]
    other = _hash.prefix_two(data)
    core = mix(between(pre, gram, gram + span - window + 1))
    block = mix(_hash.between_two(other, lo, hi + span) + (hi - lo).astype(np.uint64))
    return lo, hi, gram, core, block


def _lce(pre: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Longest common extension of suffixes, up to the span, by binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), span, np.int64)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = between(pre, a, a + mid) == between(pre, b, b + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def _before(data: np.ndarray, pre: np.ndarray, full: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, span: int, ties: np.ndarray) -> np.ndarray:
    """Whether suffix a sorts before suffix b (positions in `at`); ties say what equality means."""
    out = ties.copy()
    k = np.flatnonzero(full[a] != full[b])
    if len(k):
        x, y = at[a[k]], at[b[k]]
        n = np.minimum(_lce(pre, x, y, span), span - 1)
        out[k] = data[x + n] < data[y + n]
    return out


def suffix_sort(data: np.ndarray, at: np.ndarray, group: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes inside their groups (ascending ids, contiguous), and whether each repeats in its group."""
    n = len(at)
    pre = prefix(data)
    full = between(pre, at, at + span)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, n))
    first, count = np.repeat(start, size), np.repeat(size, size)
    order, width, most = np.arange(n), 1, int(size.max()) if n else 0
    place = np.arange(n) - first
    while width < most:
        live = np.flatnonzero(count > width)  # groups that still hold more than one sorted run
        f, c, p = first[live], count[live], place[live]
        run = p // width
        sib = run ^ 1
        low, high = np.minimum(sib * width, c), np.minimum((sib + 1) * width, c)
        base, right = low.copy(), run & 1 == 1
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            # elements of a left run go before equal ones of the right run
            goes = _before(data, pre, full, order[f[k] + mid], order[live[k]], at, span, right[k])
            low[k], high[k] = np.where(goes, mid + 1, low[k]), np.where(goes, high[k], mid)
        new = order.copy()
        new[f + (run // 2) * 2 * width + p % width + (low - base)] = order[live]
        order, width = new, 2 * width
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero((group[a] == group[b]) & (full[a] == full[b]))
    twice = np.zeros(n, bool)
    for i in range(0, len(pair), PAIRS):  # the bytes themselves decide
        x, y = a[pair[i : i + PAIRS]], b[pair[i : i + PAIRS]]
        steps = np.arange(span)
        same = (data[at[x][:, None] + steps] == data[at[y][:, None] + steps]).all(axis=1)
        twice[x[same]] = twice[y[same]] = True
    return order, twice


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key for each row: the id where ids are distinct, else a hash of id and text."""
    rows = text_only(docs)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).collect()[0]
    return rows.withColumn("key", F.col("doc_id") if n["n"] == n["d"] else F.xxhash64("doc_id", "text"))


def _mark(rows: DataFrame, span: int) -> DataFrame:
    """A row for each distinct (core, block) of a document, with its runs packed into longs."""

    def mark(batches):
        for b in batches:
            keys, cores, blocks, packed, n = [], [], [], [], []
            for k, t in zip(b.column("key").to_pylist(), b.column("text")):
                found = runs(np.frombuffer(t.as_py().encode(), np.uint8), span)
                if found is None:
                    continue
                lo, hi, gram, core, block = found
                order = np.lexsort((lo, block, core))
                core, block = core[order], block[order]
                new = np.flatnonzero(np.concatenate(([True], (core[1:] != core[:-1]) | (block[1:] != block[:-1]))))
                packed.append((lo << 16 | (hi - lo) << 8 | (gram - lo))[order])
                n.append(np.diff(np.append(new, len(core))))
                keys.append(np.full(len(new), k, np.int64)), cores.append(core[new].view(np.int64)), blocks.append(block[new].view(np.int64))
            if keys:
                ends = np.concatenate(([0], np.cumsum(np.concatenate(n)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(packed)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), lists, pa.array(np.concatenate(cores)), pa.array(np.concatenate(blocks))], names=["key", "runs", "core", "block"])

    return stored(rows.select("key", "text").mapInArrow(mark, "key long, runs array<long>, core long, block long"), "repeat-runs", batch=1_000)


def steps_of(pre: np.ndarray, two: np.ndarray, lo: int, hi: int, gram: int, span: int) -> list[dict]:
    """A run's windows in steps of STEP distances to its 32-gram: hashes of the step's core and block, and of each window."""
    out = []
    for j in range((gram - hi) // STEP, (gram - lo) // STEP + 1):
        a, z = max(lo, gram - STEP * j - STEP + 1), min(hi, gram - STEP * j)
        at = np.arange(a, z + 1)
        core = mix(between(pre, np.array([gram - STEP * j]), np.array([gram - STEP * j - STEP + 1 + span])) + np.uint64(j))
        block = mix(_hash.between_two(two, np.array([a]), np.array([z + span])) + np.uint64(z - a))
        out.append({"at": a, "core": int(core.view(np.int64)[0]), "block": int(block.view(np.int64)[0]), "windows": mix(between(pre, at, at + span)).view(np.int64).tolist()})
    return out


def _contexts(rows: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of the wanted runs; of hot runs the hashes of their steps and windows instead."""

    def cut(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for k, t, many in zip(b.column("key").to_pylist(), b.column("text"), b.column("runs").to_pylist()):
                data = np.frombuffer(t.as_py().encode(), np.uint8)
                pre, two = (prefix(data), _hash.prefix_two(data)) if any(r["hot"] for r in many) else (None, None)
                for r in many:
                    lo, wide = r["run"] >> 16, r["run"] >> 8 & 255
                    hashes = steps_of(pre, two, lo, lo + wide, lo + (r["run"] & 255), span) if r["hot"] else None
                    body = None if r["hot"] else data[lo : lo + wide + span].tobytes()
                    for o, v in zip(out, (k, r["run"], r["core"], r["ask"], body, hashes)):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.struct([("at", pa.int64()), ("core", pa.int64()), ("block", pa.int64()), ("windows", pa.list_(pa.int64()))])))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["key", "run", "core", "ask", "body", "steps"])

    by = wanted.groupBy("key").agg(F.collect_list(F.struct("run", "core", "ask", "hot")).alias("runs"))
    return stored(rows.select("key", "text").join(by.hint("shuffle_hash"), "key").mapInArrow(cut, "key long, run long, core long, ask boolean, body binary, steps array<struct<at:long,core:long,block:long,windows:array<long>>>"), "repeat-contexts", batch=1_000)


def _sorted_repeats(contexts: DataFrame, span: int) -> DataFrame:
    """Starts of repeating windows of the asked runs, by suffix sort of whole cores."""

    def resolve(held: list[tuple]):
        bodies = [h[4] for h in held]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum([len(x) for x in bodies])
        begin = ends - [len(x) for x in bodies]
        wide = np.array([(h[1] >> 8 & 255) + 1 for h in held])
        who = np.repeat(np.arange(len(held)), wide)
        step = np.arange(len(who)) - np.repeat(np.cumsum(wide) - wide, wide)
        gram = np.array([h[1] & 255 for h in held])
        core = np.cumsum([0] + [x[2] != y[2] for x, y in zip(held, held[1:])])
        group = core[who] * 1024 + (gram[who] - step) + 512
        order = np.argsort(group, kind="stable")
        who, step, group = who[order], step[order], group[order]
        _, twice = suffix_sort(data, begin[who] + step, group, span)
        ask = np.array([h[3] for h in held])
        good = twice & ask[who]
        lo = np.array([h[1] >> 16 for h in held])
        keys = np.array([h[0] for h in held], np.int64)
        start = lo[who[good]] + step[good]
        return pa.RecordBatch.from_arrays([pa.array(keys[who[good]]), pa.array(start), pa.array(start)], names=["key", "a", "b"])

    def sort(batches):
        held, size, last = [], 0, None
        for b in batches:
            for h in zip(*[b.column(c).to_pylist() for c in ("key", "run", "core", "ask", "body")]):
                if size > BATCH and h[2] != last:
                    yield resolve(held)
                    held, size = [], 0
                held.append(h)
                size += len(h[4])
                last = h[2]
        if held:
            yield resolve(held)

    bodies = contexts.where("body is not null").select("key", "run", "core", "ask", "body")
    return bodies.repartition(partitions_for(contexts.sparkSession), "core").sortWithinPartitions("core").mapInArrow(sort, "key long, a long, b long")


def _counted_repeats(contexts: DataFrame) -> DataFrame:
    """Ranges of repeating windows of hot cores: steps, then windows, by counts of hashes."""
    each = contexts.where("steps is not null").select("key", "ask", F.explode("steps").alias("s")).select("key", "ask", "s.*")
    met = each.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    some = stored(each.join(met, "core"), "repeat-steps", few=True)
    sums = some.groupBy("core", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("one"))
    judged = some.join(sums, ["core", "block"])
    whole = judged.where("ask and n > 1").select("key", F.col("at").alias("a"), (F.col("at") + F.size("windows") - 1).alias("b"))
    # of a repeated block one row stands for all, beside the open ones
    left = judged.where((F.col("n") == 1) | ((F.col("one.key") == F.col("key")) & (F.col("one.at") == F.col("at"))))
    left = left.select("key", "core", "at", (F.col("ask") & (F.col("n") == 1)).alias("ask"), F.posexplode("windows").alias("step", "window"))
    twice = left.groupBy("core", "window").agg(F.count(F.lit(1)).alias("n2")).where("n2 > 1").select("core", "window")
    start = F.col("at") + F.col("step")
    return whole.unionByName(left.where("ask").join(twice, ["core", "window"]).select("key", start.alias("a"), start.alias("b")))


def repeats(rows: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """key, a, b: ranges of starts whose windows occur elsewhere too."""
    marks = _mark(rows, span)
    n_runs = F.sum(F.size("runs")).alias("n")
    cores = marks.groupBy("core").agg(n_runs).where("n > 1").select("core")
    some = stored(marks.join(cores, "core").select("key", "runs", "core", "block"), "repeat-some", few=True)
    release(rows.sparkSession)
    blocks = some.groupBy("core", "block").agg(n_runs, F.min(F.struct("key", F.col("runs")[0].alias("run"))).alias("one"))
    open_ = blocks.where("n = 1").groupBy("core").agg(F.count(F.lit(1)).alias("n_open"))
    sides = blocks.join(open_, "core")
    parts = sides.groupBy("core").agg(F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1")
    wanted = sides.join(parts, "core").select(F.col("one.key").alias("key"), F.col("one.run").alias("run"), "core", (F.col("n") == 1).alias("ask"), (F.col("n_parts") > hot).alias("hot"))
    contexts = _contexts(rows, wanted, span)
    lo = F.shiftright("run", 16)
    settled = some.join(blocks.where("n > 1").select("core", "block"), ["core", "block"]).select("key", F.explode("runs").alias("run")).select("key", lo.alias("a"), (lo + F.shiftright("run", 8).bitwiseAND(F.lit(255))).alias("b"))
    out = stored(settled.unionByName(_sorted_repeats(contexts, span)).unionByName(_counted_repeats(contexts)), "repeat-starts", batch=1_000, few=True)
    release(rows.sparkSession)
    return out


def remove_repeats(docs: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (flat byte ranges) of every document."""
    rows = _keyed(docs)
    by = repeats(rows, span, hot).groupBy("key").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def cut(batches):
        for b in batches:
            size, gone, spans, sha, flat = [], [], [], [], []
            for t, a, z in zip(b.column("text"), b.column("a"), b.column("b")):
                data = t.as_py().encode()
                runs_: list[list[int]] = []
                if a.is_valid:
                    x, y = a.values.to_numpy(), z.values.to_numpy()
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], np.maximum.accumulate(y[order]) + span
                    edge = np.flatnonzero(np.concatenate(([True], x[1:] > y[:-1])))
                    runs_ = [[int(p), int(q)] for p, q in zip(x[edge], y[np.append(edge[1:], len(x)) - 1])]
                h, at = hashlib.sha256(), 0
                for p, q in runs_:
                    h.update(data[at:p])
                    at = q
                h.update(data[at:])
                size.append(len(data)), gone.append(sum(q - p for p, q in runs_)), spans.append(len(runs_)), sha.append(h.hexdigest()), flat.append([v for r in runs_ for v in r])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, pa.int64()) for v in (size, gone, spans)], pa.array(sha, pa.string()), pa.array(flat, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    met = rows.join(by.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "a", "b")
    return met.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")


def op5_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")
