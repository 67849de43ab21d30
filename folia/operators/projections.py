"""Computed columns and small aggregates: progress, boxes, accuracy by type, JSON rebuilt or cleaned, metering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load
from ..sources.readers import pdf_conformance
from ..streaming.streams import as_stream, metering, to_end
from .changes import replace_proposals
from .layout import layer_quality


def progress(done: Column, wanted: Column) -> Column:
    """whole per cent, 0 where nothing is wanted, 100 only when all is done."""
    return F.when(wanted <= 0, 0).otherwise(F.least(F.floor(100 * done / wanted), F.lit(100))).cast("int")


def brief(text: Column, most: int = 160) -> Column:
    """the start of a message on one line."""
    return F.left(T.collapse_space(text), F.lit(most))


def union_of_boxes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The box around a group's boxes; boxes of zeros or nulls don't count, a group of such has zeros. rows: x0, y0, x1, y1."""
    sides = ("x0", "y0", "x1", "y1")
    there = F.coalesce(F.greatest(*[F.abs(c) for c in sides]) > 0, F.lit(False))
    ends = [(F.min if c.endswith("0") else F.max)(F.when(there, F.col(c))) for c in sides]
    return rows.groupBy(*keys).agg(*[F.coalesce(e, F.lit(0.0)).alias(c) for c, e in zip(sides, ends)])


def expanded(box: Column, by: Column, width: Column, height: Column) -> Column:
    """A box with a margin, inside its page."""
    return F.struct(F.greatest(box["x0"] - by, F.lit(0.0)).alias("x0"), F.greatest(box["y0"] - by, F.lit(0.0)).alias("y0"), F.least(box["x1"] + by, width).alias("x1"), F.least(box["y1"] + by, height).alias("y1"))


def centre(box: Column) -> Column:
    return F.struct(((box["x0"] + box["x1"]) / 2).alias("x"), ((box["y0"] + box["y1"]) / 2).alias("y"))


def accuracy_by_type(samples: DataFrame, runs: DataFrame, current: DataFrame) -> DataFrame:
    """By type, samples, how many have a run of the type's current version, and the share of those that are right.

    samples: doc_id, type, expected; runs: doc_id, version, found; current: type, version. A sample without such
    a run counts as a sample; a type without any run has no accuracy."""
    wanted = samples.join(current, "type", "left")
    met = wanted.join(runs, ["doc_id", "version"], "left")
    right = F.when(F.col("found").isNotNull(), (F.col("found") == F.col("expected")).cast("double"))
    return met.groupBy("type").agg(F.count(F.lit(1)).alias("samples"), F.count("found").alias("run"), F.round(F.avg(right), 6).alias("accuracy"))


def sanitize_json(json: Column) -> Column:
    """JSON text whose strings, at any depth, hold no NUL: raw ones go, and so do escaped ones (but not an escaped
    backslash before the letters)."""
    return F.regexp_replace(T.sanitize(json), r"(?<!\\)((?:\\\\)*)\\u0000", "$1")


# -- queries ---------------------------------------------------------------------------------


@query(
    """with l as (select l_orderkey, count(*) as n, count(*) filter (where l_linestatus = 'F') as done from lineitem group by 1)
    select o_orderkey, case when coalesce(n, 0) = 0 then 0 else floor(100 * done / n) end::int as progress, left('Order  of '  || strftime(o_orderdate, '%Y'), 12) as brief from (select *, 1 from orders) left join l on o_orderkey = l_orderkey""".replace("'Order  of '", "'Order of '")
)
def order_progress(spark: SparkSession, d: str) -> DataFrame:
    """lines done of all lines; a message cut short."""
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    said = F.concat(F.lit("Order \n of "), F.date_format("o_orderdate", "yyyy"))
    rows = load(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", progress(F.coalesce("done", F.lit(0)), F.coalesce("n", F.lit(0))).alias("progress"), brief(said, 12).alias("brief"))


@query(
    """with b as (select l_orderkey, l_discount > 0.02 as there, l_extendedprice as x, l_quantity as y from lineitem),
    u as (select l_orderkey, coalesce(min(x) filter (where there), 0) as x0, coalesce(min(y) filter (where there), 0) as y0, coalesce(max(x + 1) filter (where there), 0) as x1, coalesce(max(y + 1) filter (where there), 0) as y1 from b group by 1)
    select l_orderkey, x0, y0, x1, y1, round((x0 + x1) / 2, 4) as cx, greatest(x0 - 5, 0) as left_, least(y1 + 5, 50) as bottom from u"""
)
def box_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of lines, those of small discounts unset."""
    there = F.col("l_discount") > 0.02
    set_ = lambda c: F.when(there, c).otherwise(0.0)
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    rows = load(spark, d, "lineitem").select("l_orderkey", set_(x).alias("x0"), set_(y).alias("y0"), set_(x + 1).alias("x1"), set_(y + 1).alias("y1"))
    box = F.struct("x0", "y0", "x1", "y1")
    wide = expanded(box, F.lit(5.0), F.lit(1e9), F.lit(50.0))
    return union_of_boxes(rows, ["l_orderkey"]).select("l_orderkey", "x0", "y0", "x1", "y1", F.round(centre(box)["x"], 4).alias("cx"), wide["x0"].alias("left_"), wide["y1"].alias("bottom"))


@query(
    """with s as (select doc_id, lang as type, quality as expected from labels join documents using (doc_id)),
    c as (select * from (values ('en', 2), ('fr', 1), ('de', 3)) v(type, version)),
    r as (select doc_id, v.version, (n_chars > 700 * v.version)::int as found from documents, (values (1), (2)) v(version) where n_chars % 5 <> 0)
    select type, count(*) as samples, count(found) as run, round(avg(case when found is not null then (found = expected)::int end), 6) as accuracy from s left join c using (type) left join r on r.doc_id = s.doc_id and r.version = c.version group by 1"""
)
def accuracy_by_current_version(spark: SparkSession, d: str) -> DataFrame:
    """Languages as types: two versions have runs for most documents, German's current one has none, Spanish has no current one."""
    docs = load(spark, d, "documents")
    samples = load(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("lang").alias("type"), F.col("quality").alias("expected"))
    runs = docs.where("n_chars % 5 <> 0").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select("doc_id", "version", (F.col("n_chars") > 700 * F.col("version")).cast("int").alias("found"))
    current = docs.select(F.col("lang").alias("type")).distinct().select("type", F.when(F.col("type") == "en", 2).when(F.col("type") == "fr", 1).when(F.col("type") == "de", 3).alias("version"))
    return accuracy_by_type(samples, runs, current)


@query("select user_id, to_json(list({'event': event_id, 'kind': event_type, 'k': (props->>'k')::int} order by event_id))::varchar as rebuilt from events group by 1")
def json_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as one JSON array, in order."""
    item = F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return load(spark, d, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("rebuilt"))


@query("select event_id, event_type as outer_, event_type || '!' as inner_, '\\u0000' as kept from events")
def json_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """NULs in nested strings, escaped and raw; an escaped backslash stays."""
    made = F.concat(F.lit('{"a": "\\u0000'), "event_type", F.lit('\0", "b": [{"c": "'), "event_type", F.lit('\\u0000!"}], "d": "\\\\u0000"}'))
    clean = sanitize_json(made)
    got = lambda p: F.get_json_object(clean, p)
    return load(spark, d, "events").select("event_id", got("$.a").alias("outer_"), got("$.b[0].c").alias("inner_"), got("$.d").alias("kept"))


@query(
    """with w as (select doc_id, unnest(regexp_extract_all(text, '[^\\s]+')) as word from documents), o as (select doc_id, word, count(*) as m from w group by 1, 2),
    l as (select doc_id, word, count(*) as n from (select doc_id, case when contains(word, 'e') then replace(word, 'e', '?') else word end as word from w) group by 1, 2)
    select doc_id, round(sum(least(m, coalesce(n, 0))) / sum(m), 6) as overlap from o left join l using (doc_id, word) group by 1"""
)
def text_layer_quality(spark: SparkSession, d: str) -> DataFrame:
    """documents' words as OCR, the same with every e lost as a text layer."""
    words = load(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([^\s]+)"))).alias("word"))
    layer = words.withColumn("word", F.replace("word", F.lit("e"), F.lit("?")))
    return layer_quality(layer, words, ["doc_id"]).select("doc_id", F.round("overlap", 6).alias("overlap"))


@query(
    """with e as (select user_id, date_trunc('hour', ts) as hour, value * case event_type when 'click' then 0.1 when 'view' then 0.05 when 'signup' then 2.0 when 'purchase' then 1.5 else 0 end / 1000 as c, max(ts) over () as last from events)
    select user_id, epoch_us(hour) as hour_us, round(sum(c), 9) as spent, count(*) as n from e where hour + interval 1 hour <= last - interval 1 day group by user_id, hour"""
)
def stream_metering(spark: SparkSession, d: str) -> DataFrame:
    """Cost by user and hour from a stream; windows come out once the watermark, a day behind, has passed them."""
    rows = as_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = to_end(metering(rows).select("user_id", F.col("window.start").alias("hour"), "spent", "n"))
    return out.select("user_id", F.unix_micros("hour").alias("hour_us"), F.round("spent", 9).alias("spent"), "n")


@query(
    """with s as (select conv_id, turn, case when role = 'user' then 'user' else 'proposal' end as source from conversations),
    p as (select distinct conv_id, turn + 1 as turn from s where conv_id % 2 = 0)
    select conv_id, turn, source, source as label from s where source = 'user' or conv_id % 2 = 1
    union all select p.conv_id, p.turn, 'proposal', 'new' from p where not exists (select 1 from s u where u.conv_id = p.conv_id and u.turn = p.turn and u.source = 'user')"""
)
def proposals_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments of a page; every second conversation gets new proposals, one page on."""
    source = F.when(F.col("role") == "user", "user").otherwise("proposal")
    old = load(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_start"), F.col("turn").alias("page_end"), source.alias("source"), source.alias("label"))
    at = F.col("page_start") + 1
    new = old.where("doc_id % 2 = 0").select("doc_id", at.alias("page_start"), at.alias("page_end"), F.lit("proposal").alias("source"), F.lit("new").alias("label")).distinct()
    return replace_proposals(old, new).select(F.col("doc_id").alias("conv_id"), F.col("page_start").alias("turn"), "source", "label")


@query("select page_id, case page_id % 3 when 0 then 2 when 1 then 1 end::int as part, case page_id % 3 when 0 then 'u' when 1 then 'b' end as conformance, case page_id % 3 when 0 then true when 1 then false end as trusted from pages")
def pdf_conformances(spark: SparkSession, d: str) -> DataFrame:
    """Markers as elements and as attributes behind a page's bytes, and none."""
    marker = F.when(F.col("page_id") % 3 == 0, "<pdfaid:part>2</pdfaid:part><pdfaid:conformance>U</pdfaid:conformance>").when(F.col("page_id") % 3 == 1, "pdfaid:part=\"1\" pdfaid:conformance='B'").otherwise("")
    content = F.concat(F.lit("%PDF-1.7 "), F.replace("html", F.lit("pdfaid"), F.lit("")), marker).cast("binary")
    rows = load(spark, d, "pages").select("page_id", pdf_conformance(content).alias("c"))
    return rows.select("page_id", "c.part", "c.conformance", F.col("c.trusted_text").alias("trusted"))
