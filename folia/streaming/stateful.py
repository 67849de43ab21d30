"""Streams whose state ends: guarded model text, stale documents, document states by generation.

Each keeps one state row a key and gives it up: at the end of the text, when a document times out or
is closed for longer than the watermark allows late rows. The batch forms do the same fold over
rows in order, a key's rows streaming past in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import query
from ..session import load
from .guard import Guard
from .streams import as_stream, to_end

# -- guarded text ----------------------------------------------------------------------------


def guarded(chunks: DataFrame, after: str = "10 minutes") -> DataFrame:
    """text_id, chunk_no, text that may be shown after each chunk. chunks: text_id string, chunk_no int, text,
    last boolean, ts timestamp.

    The state is what the guard holds (an unfinished line or an open JSON region); it goes with the last
    chunk, or, where none comes for `after` of event time, is let out as a chunk numbered -1.
    """
    wait = int(pd.Timedelta(after).total_seconds() * 1000)

    def fold(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = Guard(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"text_id": [key[0]], "chunk_no": [-1], "text": [guard.end()]})
            return
        own = pd.concat(list(rows)).sort_values("chunk_no", kind="stable")
        out, ended = [], False
        for r in own.itertuples(index=False):
            text = guard.push(r.text or "")
            if r.last:
                text, ended = text + guard.end(), True
            out.append((key[0], r.chunk_no, text))
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((guard.state(),))
            state.setTimeoutTimestamp(max(int(own["ts"].max().value // 1_000_000), state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=["text_id", "chunk_no", "text"])

    out = "text_id string, chunk_no int, text string"
    rows = chunks.select("text_id", "chunk_no", "text", "last", "ts").withWatermark("ts", after)
    return rows.groupBy("text_id").applyInPandasWithState(fold, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def guarded_batch(chunks: DataFrame) -> DataFrame:
    """N06 over chunks that have all come: the same rows; one shuffle, by text."""

    def fold(batches):
        own, guard = None, Guard()
        for b in batches:
            said = []
            for text_id, text, last in zip(*(b.column(c).to_pylist() for c in ("text_id", "text", "last"))):
                if text_id != own:
                    own, guard = text_id, Guard()
                out = guard.push(text or "")
                said.append(out + guard.end() if last else out)
            yield pa.RecordBatch.from_arrays([b.column("text_id"), b.column("chunk_no"), pa.array(said, pa.string())], names=["text_id", "chunk_no", "text"])

    dealt = chunks.repartition("text_id").sortWithinPartitions("text_id", "chunk_no")
    return dealt.select("text_id", "chunk_no", "text", "last").mapInArrow(fold, "text_id string, chunk_no int, text string")


# -- stale documents -------------------------------------------------------------------------


def stale_resets(news: DataFrame, after: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """doc_id, reset_at, resets: a document without news for `after` is reset, once until news comes again.

    news: doc_id, ts timestamp, closed boolean. Timers follow event time: a document times out when the
    watermark (`late` behind the newest row) passes its last news by `after`. Rows older than the watermark are dropped
    by it; rows in one batch are taken in order of time, so a gap inside it resets, too. A closed
    document needs no reset and has no state.
    """
    wait = pd.Timedelta(after)

    def fold(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, resets = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            out.append((key[0], last + wait, resets + 1))
        else:
            for r in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples(index=False):
                if last is not None and r.ts > last + wait:
                    resets += 1
                    out.append((key[0], last + wait, resets))
                last = None if r.closed else max(r.ts, last or r.ts)
            if last is None:
                if state.exists:
                    state.remove()
            else:
                state.update((int(last.value // 1000), resets))
                watermark = state.getCurrentWatermarkMs()
                state.setTimeoutTimestamp(max(int((last + wait).value // 1_000_000), watermark + 1))
        yield pd.DataFrame(out, columns=["doc_id", "reset_at", "resets"])

    rows = news.select("doc_id", F.col("ts").cast("timestamp").alias("ts"), "closed").withWatermark("ts", late)
    out = "doc_id long, reset_at timestamp, resets int"
    return rows.groupBy("doc_id").applyInPandasWithState(fold, out, "last long, resets int", "append", GroupStateTimeout.EventTimeTimeout)


# -- document states -------------------------------------------------------------------------

# A document's states in the order it runs through them; a part that fails makes it partial, all of them failed.
OPEN, READY, PARTIAL, FAILED = "processing", "ready", "partial", "error"


def final_state(wanted: Column, done: Column, failed: Column) -> Column:
    """The state that counters stand for."""
    return F.when(done + failed < wanted, OPEN).when(failed == 0, READY).when(done == 0, FAILED).otherwise(PARTIAL)


def document_states(events: DataFrame, keep: str = "1 day") -> DataFrame:
    """doc_id, gen, version, done, failed, status after each batch that changed a document.

    events: doc_id, gen, part_no, parts, ok, ts. A part counts once, with the last word said of it; a newer generation
    starts all counters anew; rows of an older one are dropped. version rises with each row of a document. The
    state is kept for `keep` of event time after the last row, so long as older work may still come in.
    """
    kept = int(pd.Timedelta(keep).total_seconds() * 1000)

    def fold(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "gen", "version", "parts", "done", "failed"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        gen, version, parts, said = state.get if state.exists else (-1, 0, 0, {})
        said, before = dict(said), (gen, dict(said))
        own = pd.concat(list(rows)).sort_values(["gen", "ts", "part_no"], kind="stable")
        for r in own[own["gen"] >= max(gen, own["gen"].max())].itertuples(index=False):
            if r.gen > gen:
                gen, said = int(r.gen), {}
            parts = int(r.parts)
            said[int(r.part_no)] = bool(r.ok)
        changed = before != (gen, said)
        version += changed
        state.update((gen, version, parts, said))
        state.setTimeoutTimestamp(max(int(own["ts"].max().value // 1_000_000), state.getCurrentWatermarkMs()) + kept)
        done = sum(said.values())
        yield pd.DataFrame([(key[0], gen, version, parts, done, len(said) - done)] if changed else [], columns=columns)

    rows = events.select("doc_id", "gen", "part_no", "parts", "ok", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", keep)
    out = rows.groupBy("doc_id").applyInPandasWithState(
        fold, "doc_id long, gen int, version int, parts int, done int, failed int", "gen int, version int, parts int, said map<int,boolean>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select("doc_id", "gen", "version", "done", "failed", final_state(F.col("parts"), F.col("done"), F.col("failed")).alias("status"))


def document_states_batch(events: DataFrame) -> DataFrame:
    """P15, R08 over all events: the last state of each document, by aggregates alone."""
    newest = F.max("gen").over(Window.partitionBy("doc_id"))
    rows = events.withColumn("_newest", newest).where("gen = _newest")
    parts = rows.groupBy("doc_id", "gen", "part_no").agg(F.max_by("ok", F.struct("ts", "part_no")).alias("ok"), F.max_by("parts", "ts").alias("parts"), F.max("ts").alias("ts"))
    out = parts.groupBy("doc_id", "gen").agg(F.max_by("parts", F.struct("ts", "part_no")).alias("parts"), F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    return out.select("doc_id", "gen", "done", "failed", final_state(F.col("parts"), F.col("done"), F.col("failed")).alias("status"))


# -- queries ---------------------------------------------------------------------------------


def _replies(turns: DataFrame) -> DataFrame:
    """Turns as model replies with a sum in JSON behind their text, cut into chunks of seven characters."""
    n = F.col("turn").cast("string")
    reply = F.concat(F.coalesce("text", F.lit("")), F.lit('\n```json\n{"turn": '), n, F.lit(" + 1, \"note\": \"1 + 1\"}\n```\n[\n  "), n, F.lit(" * 2,\n 3]\nend"))
    text_id = F.concat_ws(":", F.col("conv_id").cast("string"), n)
    rows = turns.select(text_id.alias("text_id"), F.posexplode(F.regexp_extract_all(reply, F.lit("(?s)(.{1,7})"))).alias("chunk_no", "text"), F.length(reply).alias("_n"), "turn")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    return rows.select("text_id", "chunk_no", "text", ts.alias("ts"), (F.col("chunk_no") == F.expr("(_n - 1) div 7")).alias("last"))


_GUARDED = """with r as (select conv_id || ':' || turn as text_id, coalesce(text, '') || chr(10) || '```json' || chr(10) || '{"turn": ' || (turn + 1) || ', "note": "1 + 1"}' || chr(10) || '```'
  || chr(10) || '[' || chr(10) || '  ' || (turn * 2) || ',' || chr(10) || ' 3]' || chr(10) || 'end' as whole from conversations) select text_id, md5(whole) as digest, length(whole) as chars from r"""


def _whole(parts: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda r: r["text"]), "")
    return parts.groupBy("text_id").agg(text.alias("text")).select("text_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query(_GUARDED)
def stream_json_guard(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a reply in chunks; sums in its JSON come out as numbers."""
    return _whole(to_end(guarded(_replies(as_stream(spark, d, "conversations")))))


@query(_GUARDED)
def json_guard_batch(spark: SparkSession, d: str) -> DataFrame:
    """N06, the same over all chunks at once."""
    return _whole(guarded_batch(_replies(load(spark, d, "conversations"))))


@query(
    """with e as (select user_id as doc_id, ts, event_type = 'purchase' as closed, max(ts) over () - interval 10 minute as mark from events),
    g as (select *, lag(ts) over w as last, lag(closed) over w as done, lead(ts) over w is null as newest from e window w as (partition by doc_id order by ts, closed)),
    r as (select doc_id, last + interval 12 hour as reset_at from g where last is not null and not done and ts > last + interval 12 hour
      union all select doc_id, ts + interval 12 hour from g where newest and not closed and ts + interval 12 hour < date_trunc('millisecond', mark))
    select doc_id, epoch_us(reset_at) as reset_us from r"""
)
def stream_stale_resets(spark: SparkSession, d: str) -> DataFrame:
    """Users as documents, reset after twelve hours without an event; a purchase closes."""
    news = as_stream(spark, d, "events").select(F.col("user_id").alias("doc_id"), "ts", (F.col("event_type") == "purchase").alias("closed"))
    return to_end(stale_resets(news, "12 hours")).select("doc_id", F.unix_micros("reset_at").alias("reset_us"))


_STATES = """with e as (select user_id as doc_id, (event_id % 3 + user_id % 2)::int as gen, (event_id % 5)::int as part_no, event_type <> 'error' as ok, ts from events),
  n as (select * from e qualify gen = max(gen) over (partition by doc_id)),
  p as (select doc_id, gen, part_no, max_by(ok, (ts, part_no)) as ok from n group by all),
  c as (select doc_id, gen, count(*) filter (where ok) as done, count(*) filter (where not ok) as failed from p group by all)
  select doc_id, gen, done, failed, case when done + failed < 5 then 'processing' when failed = 0 then 'ready' when done = 0 then 'error' else 'partial' end as status from c"""


def _work(events: DataFrame) -> DataFrame:
    gen = (F.col("event_id") % 3 + F.col("user_id") % 2).cast("int")
    return events.select(F.col("user_id").alias("doc_id"), gen.alias("gen"), (F.col("event_id") % 5).cast("int").alias("part_no"), F.lit(5).alias("parts"), (F.col("event_type") != "error").alias("ok"), "ts")


@query(_STATES)
def stream_document_states(spark: SparkSession, d: str) -> DataFrame:
    """Users as documents of five parts in three generations that come mixed; the last version of each."""
    seen = to_end(document_states(_work(as_stream(spark, d, "events")), "60 days"))
    last = seen.groupBy("doc_id").agg(F.max(F.struct("version", "gen", "done", "failed", "status")).alias("s"))
    return last.select("doc_id", "s.gen", F.col("s.done").cast("bigint").alias("done"), F.col("s.failed").cast("bigint").alias("failed"), "s.status")


@query(_STATES)
def document_states_by_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """P15, R08 in batch."""
    return document_states_batch(_work(load(spark, d, "events"))).select("doc_id", "gen", "done", "failed", "status")
