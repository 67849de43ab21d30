import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from folia.streaming import streams


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_queue_delivers_once(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1), "read", "1"), ("a", dt.datetime(2024, 1, 1, 0, 5), "read", "1"), ("b", dt.datetime(2024, 1, 1), "read", "2")]
    spark.createDataFrame(rows, "task_id string, ts timestamp, kind string, payload string").write.parquet(str(tmp_path / "q"))
    s = spark.readStream.schema("task_id string, ts timestamp, kind string, payload string").parquet(str(tmp_path / "q"))
    assert sorted(r.task_id for r in run(streams.queue(s), "q1", "append").collect()) == ["a", "b"]


def test_routes(spark):
    df = spark.createDataFrame([("read", 1, "x"), ("read", 5, "x"), ("read", 1, None), ("odd", 1, "x")], "kind string, attempt int, error string")
    assert [r.route for r in streams.routed(df).collect()] == ["retry", "dead", "done", "dead"]


def test_metering_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = run(streams.metering(s), "m1", "complete").agg(F.sum("n")).collect()[0][0]
    assert got == e.count()


def test_completions_emit_once_and_drop_old_generations(spark, tmp_path):
    rows = [(1, 1, 1, 2, True), (1, 1, 1, 2, True), (1, 1, 2, 2, False), (2, 1, 1, 2, True), (2, 2, 1, 1, True), (2, 1, 2, 2, True)]
    schema = "doc_id long, gen int, page_no int, page_count int, ok boolean"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "p"))
    got = {tuple(r) for r in run(streams.completions(s), "c1", "append").collect()}
    assert got == {(1, 1, 2, 1), (2, 2, 1, 0)}


def test_page_counts_equal_a_plain_count(spark):
    """Batches of pages against one document at a time, in a dictionary; a call takes the pages of many documents."""
    rng = np.random.default_rng(7)
    state = {k: np.array([], kind) for k, kind in streams._KINDS.items()}
    plain = {}
    for _ in range(60):
        n = int(rng.integers(1, 60))
        columns = [rng.integers(-3, 9, n), rng.integers(1, 4, n).astype("i4"), rng.integers(-1, 4, n).astype("i4"), rng.integers(0, 6, n).astype("i4"), rng.random(n) < 0.7]
        state, done = streams.count_pages(state, *columns)
        for doc, gen, page, wanted, ok in zip(*(c.tolist() for c in columns), strict=True):
            p = plain.setdefault(doc, {"gen": -1})
            if gen > p["gen"]:
                p |= {"gen": gen, "wanted": wanted, "seen": {}, "closed": False}
            if gen == p["gen"] and not p["closed"]:
                p["seen"].setdefault(page, ok)
        want = set()
        for doc, p in plain.items():
            if not p["closed"] and len(p["seen"]) >= p["wanted"] > 0:
                p["closed"] = True
                want.add((doc, p["gen"], len(p["seen"]), sum(not x for x in p["seen"].values())))
        assert {tuple(map(int, r)) for r in zip(*done, strict=True)} == want
    assert sorted(state["done"]) == sorted(d for d, p in plain.items() if p["closed"])


def test_completions_take_few_calls_for_many_documents(spark, tmp_path):
    """A call of Python a document took most of the time; state goes on from batch to batch, rows without a document count as one."""
    schema = "doc_id long, gen int, page_no int, page_count int, ok boolean"
    for page in (1, 2):
        rows = spark.range(3000).selectExpr("if(id = 0, null, id) as doc_id", "1 as gen", f"{page} as page_no", "2 as page_count", "id % 5 > 0 as ok")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    df = streams.completions(s, buckets=8)
    got = run(df, "c2", "append").collect()
    assert {tuple(r) for r in got} == {(k or None, 1, 2, 2 * (k % 5 == 0)) for k in range(3000)} and len(got) == 3000
