"""Structured Streaming forms: a deduplicated queue, dead letters, metering windows, completion counters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import cost
from ..registry import query
from ..session import load


def queue(tasks: DataFrame, late: str = "1 hour") -> DataFrame:
    """At-least-once delivery made once per task_id within the watermark. tasks: task_id, ts, kind, payload."""
    return tasks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id"])


# Attempts by kind of task, a policy given as data.
RETRIES = {"render": 3, "read": 5, "index": 3, "callback": 6}


def routed(tasks: DataFrame, retries: dict[str, int] = RETRIES) -> DataFrame:
    """Where each failed attempt goes: again, or to the dead letters."""
    most = F.create_map(*[F.lit(x) for kv in retries.items() for x in kv])
    left = F.coalesce(most[F.col("kind")], F.lit(1))
    return tasks.withColumn("route", F.when(F.col("error").isNull(), "done").when(F.col("attempt") < left, "retry").otherwise("dead"))


def metering(usage: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Cost by user and window, with late rows up to the watermark. usage: user_id, event_type, value, ts."""
    spent = cost(F.col("event_type"), F.col("value"))
    return usage.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.sum(spent).alias("spent"), F.count(F.lit(1)).alias("n"))


DONE = "doc_id long, gen int, pages int, failed int"
# Of a bucket's documents: those done, and what is known of the others; pages as (place among the open ones, page_no).
_KINDS = {"done": "i8", "done_gen": "i4", "open": "i8", "open_gen": "i4", "wanted": "i4", "failed": "i4", "seen": "i8"}
_STATE = ", ".join(f"{k} binary" for k in _KINDS)
BUCKETS = 4096


def count_pages(state: dict[str, np.ndarray], doc: np.ndarray, gen: np.ndarray, page: np.ndarray, wanted: np.ndarray, ok: np.ndarray):
    """The state after some pages of many documents, in order of arrival, and doc, gen, pages, failed of those now done."""
    docs = np.unique(np.concatenate((state["done"], state["open"], doc)))
    was_done, was_open, at = (np.searchsorted(docs, x) for x in (state["done"], state["open"], doc))
    old = np.full(len(docs), -1, np.int32)
    old[was_done], old[was_open] = state["done_gen"], state["open_gen"]
    newest = old.copy()
    np.maximum.at(newest, at, gen)
    new = newest > old
    closed, most, failed = np.zeros(len(docs), bool), np.zeros(len(docs), np.int32), np.zeros(len(docs), np.int32)
    closed[was_done] = True
    most[was_open], failed[was_open] = state["wanted"], state["failed"]
    most[new], failed[new], closed[new] = 0, 0, False
    live = (gen == newest[at]) & ~closed[at]
    at, page, wanted, ok = at[live], page[live], wanted[live], ok[live]
    first, row = np.unique(at, return_index=True)
    most[first[new[first]]] = wanted[row[new[first]]]
    place = was_open[state["seen"] >> 32]
    held = (place << 32 | state["seen"] & 0xFFFFFFFF)[~new[place]]
    seen, row = np.unique(np.concatenate((held, at << 32 | page.astype(np.int64) & 0xFFFFFFFF)), return_index=True)
    fresh = row[row >= len(held)] - len(held)
    np.add.at(failed, at[fresh], ~ok[fresh])
    pages = np.bincount(seen >> 32, minlength=len(docs))
    now = ~closed & (pages >= most) & (most > 0)
    closed |= now
    left = np.cumsum(~closed) - 1
    seen = seen[~closed[seen >> 32]]
    state = {"done": docs[closed], "done_gen": newest[closed], "open": docs[~closed], "open_gen": newest[~closed], "wanted": most[~closed], "failed": failed[~closed], "seen": left[seen >> 32] << 32 | seen & 0xFFFFFFFF}
    return state, (docs[now], newest[now], pages[now], failed[now])


def completions(pages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per document and generation, when the last of its pages has come.

    pages: doc_id, gen, page_no, page_count, ok. A page counts once; pages of an older generation than
    the newest seen are dropped; a newer one starts the count anew. Documents are counted in buckets, whose
    number must stay the same for a checkpoint; a document that is done takes twelve bytes of state.
    """

    def count(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [b""] * len(_KINDS)
        pdf = pd.concat(list(rows), ignore_index=True)
        columns = [pdf[c].to_numpy(kind) for c, kind in (("doc_id", "i8"), ("gen", "i4"), ("page_no", "i4"), ("page_count", "i4"), ("ok", "bool"))]
        after, done = count_pages({k: np.frombuffer(x, kind) for (k, kind), x in zip(_KINDS.items(), held, strict=True)}, *columns)
        state.update(tuple(after[k].astype(kind).tobytes() for k, kind in _KINDS.items()))
        out = pd.DataFrame(dict(zip(("doc_id", "gen", "pages", "failed"), done, strict=True)))
        yield out.astype({"doc_id": "Int64"}).assign(doc_id=None) if key[0] < 0 else out

    # rows without a document have a bucket of their own
    doc = F.col("doc_id").cast("long")
    bucket = F.when(doc.isNull(), -1).otherwise(F.pmod(F.xxhash64(doc), F.lit(buckets))).cast("int")
    rows = pages.select(bucket.alias("_bucket"), F.coalesce(doc, F.lit(0)).alias("doc_id"), F.col("gen").cast("int").alias("gen"), F.col("page_no").cast("int").alias("page_no"), F.col("page_count").cast("int").alias("page_count"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("_bucket").applyInPandasWithState(count, DONE, _STATE, "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, sink, checkpoint: str):
    """Hands every micro-batch to a sink, at least once."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


# -- queries ---------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the program ends; where that is unset a local
    session takes a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='folia-stream-')}"
    folder = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def to_end(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that its source holds now and returns what it wrote."""
    folder = shared_folder(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def as_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern, as a source of streams takes no single file by its name."""
    return spark.readStream.schema(load(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("select event_id, user_id, event_type from events")
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, made once."""
    e = as_stream(spark, d, "events").select(F.col("event_id").cast("string").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type")
    return to_end(queue(e.union(e)).select("event_id", "user_id", "event_type"))


@query("with p as (select l_orderkey, max(l_linenumber) as wanted, count(distinct l_linenumber) as pages from lineitem group by 1) select l_orderkey as doc_id, 1::int as gen, pages::int as pages from p where pages = wanted")
def stream_completions(spark: SparkSession, d: str) -> DataFrame:
    """An order is done when all its line numbers have come, repeated ones once; reported one time."""
    wanted = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("page_count"))
    lines = as_stream(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(wanted, "l_orderkey")
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("gen"), F.col("l_linenumber").cast("int").alias("page_no"), F.col("page_count").cast("int").alias("page_count"), F.lit(True).alias("ok"))
    return to_end(completions(rows)).select("doc_id", "gen", "pages")


@query("with e as (select event_id, event_type, 1 + event_id % 6 as attempt from events) select event_id, case when event_id % 3 = 0 then 'done' when attempt < case event_type when 'view' then 3 when 'click' then 5 else 1 end then 'retry' else 'dead' end as route from e")
def stream_routes(spark: SparkSession, d: str) -> DataFrame:
    """Failed attempts go again until their kind's number is used up, then to the dead letters."""
    e = as_stream(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("event_id") % 6 + 1).alias("attempt"), F.when(F.col("event_id") % 3 != 0, "failed").alias("error"))
    return to_end(routed(e, {"view": 3, "click": 5})).select("event_id", "route")
