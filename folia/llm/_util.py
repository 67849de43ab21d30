"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 64
PER_FILE = 32
_written: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one takes a temporary folder."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="folia-shared-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str, batch: int | None = None, few: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors.

    batch: rows an Arrow batch may hold while this table is written, where rows are wide.
    few: rows are narrow. Where Spark doesn't join small shuffle partitions by itself, they are dealt, in turn and
    without a key, to a file for every PER_FILE partitions, or for every core if there are more.
    """
    spark = df.sparkSession
    if few and "false" in (spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")):
        df = df.repartition(max(spark.sparkContext.defaultParallelism, partitions_for(spark) // PER_FILE))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if batch:
            spark.conf.set(key, str(batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    if _written:
        _written[-1].append(path)
    else:
        atexit.register(delete, spark, [path])
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """What stored() writes inside is deleted at the end; the function it gives stores a result that outlives it."""
    _written.append([])

    def result(df: DataFrame, name: str, few: bool = False) -> DataFrame:
        kept = stored(df, name, few=few)
        path = _written[-1].pop()
        if len(_written) > 1:
            _written[-2].append(path)
        else:
            atexit.register(delete, spark, [path])
        return kept

    try:
        yield result
    finally:
        delete(spark, _written.pop())


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Removes stored tables; at the end of the program only if the session still runs."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(rows: DataFrame, key: str, values: DataFrame, by: str, salts: int = SALTS) -> DataFrame:
    """rows joined with one row of values for each key, without a task for all rows of a hot key.

    Rows are dealt out by (key, salt) with the salt from column `by`; the pairs that occur, `salts`
    a key at most, meet the values by key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    pairs = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n")).drop("_n").join(values, key)
    return salted.join(pairs, [key, "_salt"]).drop("_salt")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) under fixed names; other columns, clashing or not, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are stored and whose plans are gone."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
