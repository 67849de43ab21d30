"""Scalar functions lifted to queries: exact arithmetic, JSON, hashing, diffs, numbers, dates, boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from ..functions import dates
from ..functions import python_side as P
from ..functions import runs
from ..functions import text as T
from ..registry import query
from ..session import load


@F.pandas_udf(StringType())
def calculate(s: pd.Series) -> pd.Series:
    """The exact value as text, or what is wrong with the expression after 'error: '."""

    def one(e):
        if e is None:
            return None
        try:
            return P.render(P.calculate(e))
        except P.CalcError as x:
            return f"error: {x}"

    return s.map(one)


@F.pandas_udf(StructType([StructField("line", IntegerType()), StructField("col", IntegerType()), StructField("reason", StringType())]))
def json_problem(s: pd.Series) -> pd.DataFrame:
    rows = [P.json_problem(x) if x is not None else None for x in s]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["line", "col", "reason"]).astype({"line": "Int32", "col": "Int32"})


@F.pandas_udf(StringType())
def first_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: P.first_json(x) if x is not None else None)


@F.pandas_udf(StringType())
def repair_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: P.repair_json(x) if x is not None else None)


@F.pandas_udf(ArrayType(FloatType()))
def hash_embedding(s: pd.Series) -> pd.Series:
    return s.map(lambda x: P.hash_embedding(x or ""))


@F.pandas_udf(ArrayType(StructType([StructField("mark", StringType()), StructField("line", StringType())])))
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"mark": m, "line": t} for m, t in runs.line_diff(x or "", y or "")] for x, y in zip(a, b)])


def box_contains(box: Column, x: Column, y: Column) -> Column:
    return (x >= box["x0"]) & (x <= box["x1"]) & (y >= box["y0"]) & (y <= box["y1"])


def box_area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def horizontal_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def quad_box(points: Column) -> Column:
    """A box from an array of [x, y] points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def backoff(attempt: Column, schedule: list[int]) -> Column:
    """Seconds before the next attempt; null when none is left."""
    return F.try_element_at(F.array(*[F.lit(s) for s in schedule]), attempt.cast("int"))


@query("with v as (select o_orderkey, o_orderkey % 1000 as n from orders) select o_orderkey, case o_orderkey % 8 when 0 then (2 * n * n + n)::varchar when 1 then (n * 1500 + 1)::varchar when 2 then (-(n * n))::varchar when 3 then (n % 7 - 3)::varchar when 4 then case when n % 3 = 0 then (n // 3)::varchar else (n // 3)::varchar || case n % 3 when 1 then '.3333333333' else '.6666666667' end end when 5 then 'error: division by zero' when 6 then ((n + 1) // 2)::varchar else (9007199254740993 + n)::varchar end as exact from v")
def calc_exact(spark: SparkSession, d: str) -> DataFrame:
    """Formulas in turn: powers, exponents, signs, remainders, thirds, faults, rounding, whole numbers beyond doubles."""
    n = (F.col("o_orderkey") % 1000).cast("string")
    part = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    made = F.array(part("2*", n, "^2 + ", n), part(n, " * 1.5e3 + 1"), part("-", n, "^2"), part(n, " % 7 - abs(-3)"), part(n, "/3"), part(n, "/(1-1)"), part("round(", n, "/2)"), part("9007199254740993+", n))
    return load(spark, d, "orders").select("o_orderkey", calculate(F.element_at(made, (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("exact"))


@query("select event_id, event_type <> 'error' as ok from events")
def json_validate(spark: SparkSession, d: str) -> DataFrame:
    """Trailing text is found, which the built-in parser lets through."""
    s = F.when(F.col("event_type") == "error", F.concat("props", F.lit(","))).otherwise(F.col("props"))
    return load(spark, d, "events").select("event_id", json_problem(s)["reason"].isNull().alias("ok"))


@query("select event_id, case when event_type = 'error' then 1 end::int as line, case when event_type = 'error' then length(props) + 1 end::int as col from events")
def json_fault_position(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_type") == "error", F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return load(spark, d, "events").select("event_id", json_problem(s).alias("p")).select("event_id", "p.line", "p.col")


@query("select event_id, props::json->>'k' as k from events")
def reply_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON inside a model's reply."""
    reply = F.concat(F.lit("<think>{maybe}</think>Here:\n```json\n"), "props", F.lit("\n``` done"))
    return load(spark, d, "events").select("event_id", F.get_json_object(first_json(reply), "$.k").alias("k"))


@query("select event_id, case event_id % 4 when 0 then event_id % 7 + 2 when 1 then -(event_id % 9) * 3 when 2 then event_id when 3 then (event_id % 5 + 1) * 10 end::varchar as v, case event_id % 4 when 3 then '[' || event_id % 5 || ',6]' else '1+1' end as note from events")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Arithmetic in value positions becomes its value; strings and plain numbers stay."""
    e = lambda k: (F.col("event_id") % k).cast("string")
    made = F.array(F.concat(F.lit('{"note": "1+1", "v": '), e(7), F.lit(" + 2}")), F.concat(F.lit('{"v": -('), e(9), F.lit(') * 3, "note": "1+1"}')), F.concat(F.lit('{"note": "1+1", "v": '), F.col("event_id").cast("string"), F.lit("}")), F.concat(F.lit('{"note": ['), e(5), F.lit(", 2*3], \"v\": ("), e(5), F.lit("+1)*10}")))
    fixed = repair_json(F.element_at(made, (F.col("event_id") % 4 + 1).cast("int")))
    return load(spark, d, "events").select("event_id", F.get_json_object(fixed, "$.v").alias("v"), F.get_json_object(fixed, "$.note").alias("note"))


@query("select doc_id, 1.0::double as norm, 256 as width from documents")
def hash_embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of hashed words and trigrams."""
    v = load(spark, d, "documents").select("doc_id", hash_embedding("text").alias("v"))
    return v.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"), F.size("v").alias("width"))


@query("with l as (select doc_id, string_split(text, chr(10)) as l from documents), x as (select doc_id, len(l)::bigint as n, (len(l) // 3)::bigint as changed, ((len(l) + 1) // 3)::bigint as gone from l) select doc_id, n - changed - gone as kept, changed + 1 as added, changed + gone as removed from x")
def line_diff_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every third line changed, the one before it removed, one appended; numbered lines are distinct."""
    old = F.transform(F.split("text", "\n"), lambda t, i: F.concat((i + 1).cast("string"), F.lit(" "), t))
    kept = F.filter(old, lambda t, i: (i + 1) % 3 != 2)
    new = F.transform(kept, lambda t: F.when(F.substring_index(t, " ", 1).cast("int") % 3 == 0, F.concat(F.lit("changed "), t)).otherwise(t))
    x = load(spark, d, "documents").select("doc_id", line_diff(F.array_join(old, "\n"), F.array_join(F.array_append(new, F.lit("appended")), "\n")).alias("x"))
    n = lambda m: F.size(F.filter("x", lambda r: r["mark"] == m)).cast("bigint")
    return x.select("doc_id", n(" ").alias("kept"), n("+").alias("added"), n("-").alias("removed"))


@query("select o_orderkey, round(o_totalprice, 2) as total from orders")
def parse_locale_number(spark: SparkSession, d: str) -> DataFrame:
    """C11, C20: prices written with dots between thousands and a decimal comma, read back."""
    p = F.col("o_totalprice").cast("decimal(18,2)")
    whole, cents = F.floor(p), F.lpad(((p - F.floor(p)) * 100).cast("int").cast("string"), 2, "0")
    s = F.concat(T.thousands(whole), F.lit(","), cents, F.lit(" đ"))
    return load(spark, d, "orders").select("o_orderkey", F.round(T.parse_number(s), 2).alias("total"))


@query("select o_orderkey, o_orderdate::date as day, (date_trunc('month', o_orderdate::date) + interval 1 month + to_days(day(o_orderdate)::int - 1))::date as later from orders")
def dates_in_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Dates in turn in every accepted layout, and a month later with overflow."""
    layouts = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd"]
    s = F.element_at(F.array(*[F.date_format("o_orderdate", x) for x in layouts]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    day = dates.parse_date(s)
    return load(spark, d, "orders").select("o_orderkey", day.alias("day"), dates.add_overflowing(day, F.lit(1), "month").alias("later"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from part")
def part_slugs(spark: SparkSession, d: str) -> DataFrame:
    """C19."""
    return load(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("with l as (select l_orderkey, l_linenumber, l_extendedprice as x, l_quantity * 100 as y from lineitem), b as (select o_orderkey, x0, x0 + 30000 as x1, 0.0 as y0, 3000.0 as y1, r from orders, (values (0, 0.0), (1, 20000.0), (2, 40000.0)) v(r, x0)) select l_orderkey, l_linenumber, min(r)::int as region from l join b on o_orderkey = l_orderkey and x between x0 and x1 and y between y0 and y1 group by 1, 2")
def smallest_containing_box(spark: SparkSession, d: str) -> DataFrame:
    """Each point's smallest box of its page, ties to the first; equi key first, then geometry."""
    points = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 100).alias("y"))
    boxes = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(x0).alias("x0"), F.lit(x0 + 30000).alias("x1"), F.lit(0.0).alias("y0"), F.lit(3000.0).alias("y1")) for r, x0 in ((0, 0.0), (1, 20000.0), (2, 40000.0))])
    b = load(spark, d, "orders").select("o_orderkey", F.explode(boxes).alias("b"))
    met = points.join(b, F.col("l_orderkey") == F.col("o_orderkey")).where(box_contains(F.col("b"), F.col("x"), F.col("y")))
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("b.r", F.struct(box_area(F.col("b")), F.col("b.r"))).alias("region"))
