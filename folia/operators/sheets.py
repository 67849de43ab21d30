"""Extracted fields, record sheets and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load


def current_fields(fields: DataFrame, slot: list[str]) -> DataFrame:
    """The value that stands in a slot: confirmed first, then the newest, then the greatest id."""
    w = Window.partitionBy(*slot).orderBy(F.desc(F.col("status") == "confirmed"), F.desc("created_at"), F.desc("id"))
    return fields.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_fields(slots: DataFrame, wanted: DataFrame, fields: DataFrame) -> DataFrame:
    """(segment, key) pairs without a value; an answer of not found is asked once more.
    slots: segment_id, doc_type; wanted: doc_type, key; fields: segment_id, key, value, tries."""
    all_ = slots.join(wanted, "doc_type").select("segment_id", "key")
    settled = fields.where(F.col("value").isNotNull() | (F.col("tries") >= 2)).select("segment_id", "key")
    return all_.join(settled, ["segment_id", "key"], "left_anti")


def pivot_sheet(fields: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """A row a segment, a column a field (the declared ones, so no job finds them first), and how many are filled."""
    out = fields.groupBy(row).agg(*[F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(k) for k in keys])
    return out.withColumn("filled", sum((F.col(k).isNotNull().cast("int") for k in keys[1:]), F.col(keys[0]).isNotNull().cast("int")).cast("bigint"))


def with_evidence(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether each field's value is in the lines it cites; fields without evidence are errors.
    fields: doc_id, key, value, page_no, first, last; lines: doc_id, page_no, line_no, line."""
    inside = (F.col("line_no") >= F.col("first")) & (F.col("line_no") <= F.col("last"))
    met = fields.join(lines, ["doc_id", "page_no"]).where(inside)
    said = met.groupBy("doc_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), " ").alias("said"))
    out = fields.join(said, ["doc_id", "key"], "left")
    matched = F.coalesce(T.value_in(F.col("value"), F.col("said")), F.lit(False))
    return out.select("doc_id", "key", "value", matched.alias("value_matched"), F.when(F.col("said").isNull(), "evidence required").when(~matched, "value not in evidence").alias("note"))


def accuracy(truth: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """Right cells by cells, by field; values compare by key. truth: keys, field, value."""
    both = truth.withColumnRenamed("value", "want").join(output.withColumnRenamed("value", "got"), [*keys, "field"], "left")
    right = F.coalesce(T.value_key(F.col("want")) == T.value_key(F.col("got")), F.lit(False)).cast("double")
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("cells"), F.avg(right).alias("accuracy"))


_FIELDS = "f as (select o_orderkey as segment_id, 'status' as key, o_orderstatus as value from orders union all select o_orderkey, 'priority', o_orderpriority from orders where o_orderstatus <> 'P' union all select o_orderkey, 'total', o_totalprice::decimal(18,2)::varchar from orders)"


def _fields(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    cells = F.array(F.struct(F.lit("status").alias("key"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value")), F.struct(F.lit("total").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value")))
    return o.select(F.col("o_orderkey").alias("segment_id"), F.inline(cells)).where("value is not null")


@query(f"with {_FIELDS} select segment_id, max(value) filter (where key = 'status') as status, max(value) filter (where key = 'priority') as priority, max(value) filter (where key = 'total') as total, count(*)::bigint as filled from f group by 1")
def sheet_pivot(spark: SparkSession, d: str) -> DataFrame:
    return pivot_sheet(_fields(spark, d), "segment_id", ["status", "priority", "total"])


@query(f"with {_FIELDS} select o_orderkey as segment_id, k.key from orders, (values ('status'), ('priority'), ('total'), ('owner')) k(key) where not exists (select 1 from f where f.segment_id = o_orderkey and f.key = k.key)")
def sheet_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    slots = load(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), F.lit("order").alias("doc_type"))
    wanted = spark.createDataFrame([("order", k) for k in ("status", "priority", "total", "owner")], "doc_type string, key string")
    return missing_fields(slots, wanted, _fields(spark, d).withColumn("tries", F.lit(1)))


@query("select doc_id, contains(regexp_replace(lower(strip_accents(string_split(text, chr(10))[1])), '[^\\p{L}\\p{Nd}]', '', 'g'), regexp_replace(lower(strip_accents(source)), '[^\\p{L}\\p{Nd}]', '', 'g')) or contains(regexp_replace(string_split(text, chr(10))[1], '[^\\p{Nd}]', '', 'g'), regexp_replace(lower(strip_accents(source)), '[^\\p{L}\\p{Nd}]', '', 'g')) as value_matched, true as first_word_matched from documents where regexp_replace(split_part(trim(text), ' ', 1), '[^\\p{L}\\p{Nd}]', '', 'g') <> '' and trim(string_split(text, chr(10))[1]) <> ''")
def extraction_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A value that is not on its line (the source) and one that is (the first word of the text)."""
    from .documents import lines_of

    docs = load(spark, d, "documents")
    lines = lines_of(docs).withColumn("page_no", F.lit(1))
    word = F.split(F.trim("text"), " ")[0]
    good = docs.where((F.regexp_replace(word, r"[^\p{L}\p{Nd}]", "") != "") & (F.trim(F.split("text", "\n")[0]) != ""))
    cells = F.array(F.struct(F.lit("source").alias("key"), F.col("source").alias("value")), F.struct(F.lit("word").alias("key"), F.split(word, "\n")[0].alias("value")))
    fields = good.select("doc_id", F.inline(cells), F.lit(1).alias("page_no"), F.lit(1).alias("first"), F.lit(1).alias("last"))
    out = with_evidence(fields, lines)
    return out.groupBy("doc_id").agg(F.max(F.when(F.col("key") == "source", F.col("value_matched"))).alias("value_matched"), F.max(F.when(F.col("key") == "word", F.col("value_matched"))).alias("first_word_matched"))


@query("with t as (select o_orderkey, o_orderpriority as v from orders) select 'priority' as field, count(*) as cells, round(avg(case when v like '%1%' then 0.0 else 1.0 end), 6) as accuracy from t")
def extraction_accuracy(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value"))
    output = o.withColumn("value", F.when(F.col("value").contains("1"), "?").otherwise(F.upper("value")))
    return accuracy(o, output, ["o_orderkey"]).select("field", "cells", F.round("accuracy", 6).alias("accuracy"))
