"""Tables in partitioned folders: edits that rewrite only the partitions they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.meta import compile_filter, merge
from ..registry import query
from ..session import load
from ..streaming.streams import shared_folder


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def edit_rows(spark: SparkSession, path: str, by: str, hit: Column, change: Callable[[DataFrame], DataFrame]) -> list:
    """Rows where `hit` is true become what `change` makes of them; gives the values of `by` that were rewritten.

    The values are found first (a scan of the columns that the filter reads; as many as there are partitions), then
    only their files are read and replaced; the new files are staged and take the place of the old when all are
    written. `change` keeps the columns and the partition of a row.
    """
    table = spark.read.parquet(path)
    touched = sorted(r[0] for r in table.where(hit).select(by).distinct().collect())
    if touched:
        rows = table.where(F.col(by).isin(touched)).withColumn("_hit", F.coalesce(hit, F.lit(False)))
        changed = change(rows.where("_hit").drop("_hit")).select(*table.columns)
        replace_partitions(rows.where("not _hit").drop("_hit").select(*table.columns).unionByName(changed), path, by)
    return touched


def set_metadata(spark: SparkSession, path: str, by: str, spec: dict, values: dict[str, str], unset: list[str], schema: dict[str, str] | None = None) -> list:
    """Sets and removes keys of the map `meta` in all rows that a metadata filter selects."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))] + [x for k in unset for x in (F.lit(k), F.lit(None).cast("string"))]
    own = F.create_map(*pairs).cast("map<string,string>")
    return edit_rows(spark, path, by, compile_filter(F.col("meta"), spec, schema), lambda rows: rows.withColumn("meta", merge(F.col("meta"), own)))


@query(
    """select o_orderkey, o_orderstatus as status, case when o_orderstatus = 'F' and o_totalprice >= 100000 then 'yes' end as reviewed,
      case when o_orderstatus = 'F' and o_totalprice >= 100000 then null else o_orderpriority end as priority from orders"""
)
def meta_set_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Closed orders from 100,000 up are marked and lose their priority; one of three partitions is rewritten."""
    path = shared_folder(spark) + "/orders"
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    meta = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("price"), price, F.lit("state"), F.col("o_orderstatus"))
    rows = load(spark, d, "orders").select("o_orderkey", meta.alias("meta"), F.col("o_orderstatus").alias("status"))
    replace_partitions(rows, path, "status")
    set_metadata(spark, path, "status", {"state": "F", "price": {"gte": 100000}}, {"reviewed": "yes"}, ["priority"])
    got = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    return spark.read.parquet(path).select("o_orderkey", "status", got("reviewed"), got("priority"))
