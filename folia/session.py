"""A session with the settings the operators expect; a cluster's own settings stay in force."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
