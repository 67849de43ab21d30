"""Ordered computations over pages and segments: grouping, gaps, overlaps, hints, bundles, cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..session import load


def islands(df: DataFrame, keys: list[str], pos: str, breaks: Column | None = None) -> DataFrame:
    """Adds island: a new one where the position isn't the one before plus 1, or where `breaks` holds."""
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.coalesce(F.col(pos) != F.lag(pos).over(w) + 1, F.lit(True))
    if breaks is not None:
        new = new | breaks
    return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def group_pages(pages: DataFrame, doc: str = "doc_id", least: float = 0.0) -> DataFrame:
    """Pages to documents: a first page, or a page after a gap, starts one; its label and confidence hold.

    Columns: page_no, label (null or empty: not classified), confidence, first_page. A document whose
    first page is below `least` or not classified is unknown and keeps the label as a proposal; runs of
    pages without any label give nothing.
    """
    w = Window.partitionBy(doc).orderBy("page_no")
    runs = islands(pages, [doc], "page_no").withColumnRenamed("island", "_run")
    label = F.nullif(F.col("label"), F.lit(""))
    in_run = Window.partitionBy(doc, "_run")
    starts = F.col("first_page") | (F.row_number().over(in_run.orderBy("page_no")) == 1)
    marked = runs.withColumn("_any", F.max(label.isNotNull()).over(in_run)).where("_any").withColumn("_start", starts.cast("int")).withColumn("_doc", F.sum("_start").over(w))
    out = marked.groupBy(doc, "_doc").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.min_by(F.struct(label.alias("l"), F.col("confidence").alias("c")), "page_no").alias("f"))
    sure = F.col("f.l").isNotNull() & (F.col("f.c") >= least)
    return out.select(doc, "page_start", "page_end", F.when(sure, F.col("f.l")).otherwise("unknown").alias("label"), F.when(~sure, F.col("f.l")).alias("proposed_label"), F.col("f.c").alias("confidence"))


def cover(spans: DataFrame, counts: DataFrame, skipped: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans that cover every page 1..page_count once: given ones, and unknown or not_processed ones in
    between. spans: doc, page_start, page_end, label (apart); skipped: doc, page_no."""
    pages = counts.join(spans.select(doc).distinct(), doc, "left_semi").select(doc, F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
    held = spans.select(doc, F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    free = pages.join(held, [doc, "page_no"], "left_anti").join(skipped.select(doc, "page_no").distinct().withColumn("skip", F.lit(True)), [doc, "page_no"], "left")
    free = free.withColumn("label", F.when(F.col("skip"), "not_processed").otherwise("unknown"))
    change = F.coalesce(F.col("label") != F.lag("label").over(Window.partitionBy(doc).orderBy("page_no")), F.lit(False))
    gaps = islands(free, [doc], "page_no", change).groupBy(doc, "island").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.first("label").alias("label"))
    return spans.select(doc, "page_start", "page_end", "label").unionByName(gaps.drop("island"))


def drop_overlaps(segments: DataFrame, order: list[Column], doc: str = "doc_id") -> DataFrame:
    """Greedy: in the given order a segment stays when it is apart from all that stayed. One fold over the
    document's own segments; a document's segments are few, and only they meet."""
    w = Window.partitionBy(doc).orderBy(*order)
    fields = [c for c in segments.columns if c != doc]
    ranked = segments.withColumn("_r", F.row_number().over(w))
    rows = ranked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_r", *fields))).alias("s"))
    apart = lambda kept, x: ~F.exists(kept, lambda k: (x["page_start"] <= k["page_end"]) & (x["page_end"] >= k["page_start"]))
    empty = F.slice("s", 1, 0)
    kept = F.aggregate("s", empty, lambda acc, x: F.when(apart(acc, x), F.array_append(acc, x)).otherwise(acc))
    return rows.select(doc, F.inline(kept)).drop("_r")


def cut_hints(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Why a page may begin a document. Columns: page_no, text, width, height."""
    w = Window.partitionBy(doc).orderBy("page_no")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    edge = F.array_join(F.concat(F.slice(lines, 1, 2), F.slice(F.reverse(lines), 1, 2)), "\n")
    number = F.nullif(F.regexp_extract(edge, r"(?im)^\W*(?:page|trang)?\W*(\d{1,4})(?:\s*/\s*\d+)?\W*$", 1), F.lit("")).cast("int")
    blank = F.size(lines) == 0
    rows = pages.withColumn("_n", number).withColumn("_b", blank)
    before = lambda c: F.lag(c).over(w)
    turned = (F.col("width") > F.col("height")) != (before("width") > before("height"))
    resized = (F.abs(F.col("width") - before("width")) > 0.05 * before("width")) | (F.abs(F.col("height") - before("height")) > 0.05 * before("height"))
    hints = F.array_compact(F.array(F.when((F.col("_n") == 1) & (F.col("page_no") > 1), "number_restarts"), F.when(before("_b") & (F.row_number().over(w) > 2), "after_blank"), F.when(turned, "orientation"), F.when(resized & ~turned, "size")))
    return rows.select(doc, "page_no", hints.alias("hints")).where(F.size("hints") > 0)


def bundles(segments: DataFrame, case: str, order: list[Column], opens_with: list[str]) -> DataFrame:
    """A segment with an opening label starts the next bundle; reviewed ones keep their code.
    Columns: label, reviewed_code (null unless reviewed)."""
    w = Window.partitionBy(case).orderBy(*order)
    number = F.regexp_extract("reviewed_code", r"(\d+)$", 1).try_cast("int")
    top = F.coalesce(F.max(number).over(Window.partitionBy(case)), F.lit(0))
    first = F.row_number().over(w) == 1
    opens = F.col("reviewed_code").isNull() & (F.col("label").isin(opens_with) | first)
    marked = segments.withColumn("_made", F.sum(opens.cast("int")).over(w)).withColumn("_top", top)
    own = F.when(opens, F.concat(F.lit("B"), F.lpad((F.col("_top") + F.col("_made")).cast("string"), 3, "0")))
    code = F.last(F.coalesce("reviewed_code", own), ignorenulls=True).over(w)
    return marked.withColumn("bundle_code", code).drop("_made", "_top")


def cover_errors(segments: DataFrame, counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages covered by no segment or by several."""
    pages = counts.select(doc, F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
    held = segments.select(doc, F.explode(F.sequence("page_start", "page_end")).alias("page_no")).groupBy(doc, "page_no").agg(F.count(F.lit(1)).alias("n"))
    return pages.join(held, [doc, "page_no"], "left").where(F.coalesce("n", F.lit(0)) != 1).select(doc, "page_no", F.coalesce("n", F.lit(0)).alias("covered"))


# -- queries on the driver's tables: turns of conversations stand for pages ------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), F.col("role").alias("label"), (F.length(F.coalesce("text", F.lit(""))) % 10 / 10).alias("confidence"), (F.col("role") == "user").alias("first_page"))


_PAGES = "p as (select conv_id as doc_id, (turn + 1)::int as page_no, role as label, (length(coalesce(text, '')) % 10) / 10 as confidence, role = 'user' as first_page from conversations), r as (select *, sum(case when page_no = lag_no + 1 then 0 else 1 end) over (partition by doc_id order by page_no) as run from (select *, lag(page_no) over (partition by doc_id order by page_no) as lag_no from p)), s as (select *, case when first_page or row_number() over (partition by doc_id, run order by page_no) = 1 then 1 else 0 end as st from r), g as (select *, sum(st) over (partition by doc_id order by page_no) as grp from s), m as (select doc_id, min(page_no) as page_start, max(page_no) as page_end, arg_min(label, page_no) as l, arg_min(confidence, page_no) as confidence from g group by doc_id, grp)"


@query(f"with {_PAGES} select doc_id, page_start, page_end, case when confidence >= 0.3 then l else 'unknown' end as label, case when confidence < 0.3 then l end as proposed_label, confidence from m")
def first_flag_groups(spark: SparkSession, d: str) -> DataFrame:
    return group_pages(_pages(spark, d), least=0.3)


_DAYS = "d as (select distinct user_id as doc_id, day(ts)::int as page_no from events where event_type = 'purchase'), i as (select *, page_no - row_number() over (partition by doc_id order by page_no) as k from d), sp as (select doc_id, min(page_no)::int as page_start, max(page_no)::int as page_end from i group by doc_id, k)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    days = load(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"), F.dayofmonth("ts").alias("page_no")).distinct()
    return islands(days, ["doc_id"], "page_no").groupBy("doc_id", "island").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end")).drop("island")


@query(f"with {_DAYS} select doc_id, page_start, page_end from sp")
def event_sessions_gap(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


@query(f"with {_DAYS}, x as (select distinct user_id as doc_id, day(ts)::int as page_no from events where event_type = 'error'), a as (select distinct doc_id, unnest(range(1, 32))::int as page_no from sp), f as (select a.doc_id, a.page_no, case when x.page_no is null then 'unknown' else 'not_processed' end as label from a left join x using (doc_id, page_no) where not exists (select 1 from d where d.doc_id = a.doc_id and d.page_no = a.page_no)), k as (select *, sum(case when prev = page_no - 1 and pl = label then 0 else 1 end) over (partition by doc_id order by page_no) as isl from (select *, lag(page_no) over w as prev, lag(label) over w as pl from f window w as (partition by doc_id order by page_no))) select doc_id, page_start, page_end, 'bought' as label from sp union all select doc_id, min(page_no), max(page_no), min(label) from k group by doc_id, isl")
def gap_fill_pages(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d).withColumn("label", F.lit("bought"))
    counts = spans.select("doc_id").distinct().withColumn("page_count", F.lit(31))
    skipped = load(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"), F.dayofmonth("ts").alias("page_no")).distinct()
    return cover(spans, counts, skipped)


@query(f"with {_DAYS}, a as (select distinct doc_id, unnest(range(1, 32))::int as page_no from sp) select doc_id, page_no, (select count(*) from sp where sp.doc_id = a.doc_id and a.page_no between page_start and page_end)::bigint as covered from a where (select count(*) from sp where sp.doc_id = a.doc_id and a.page_no between page_start and page_end) <> 1")
def page_cover_exactly_once(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d)
    return cover_errors(spans, spans.select("doc_id").distinct().withColumn("page_count", F.lit(31)))


_SEG = "seg as (select o_orderkey, o_custkey, o_orderstatus = 'F' as own, datediff('day', date '1990-01-01', o_orderdate::date)::int as page_start, (datediff('day', date '1990-01-01', o_orderdate::date) + (o_totalprice::int % 40))::int as page_end, o_totalprice from orders)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("own"), start.alias("page_start"), (start + (F.rint("o_totalprice").cast("int") % 40)).alias("page_end"), "o_totalprice")


@query(f"with {_SEG} select p.o_orderkey from seg p where not own and not exists (select 1 from seg u where u.own and u.o_custkey = p.o_custkey and u.page_end >= p.page_start and u.page_start <= p.page_end)")
def overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    """Proposals apart from every segment the user made; an equi key bounds the comparison."""
    s = _segments(spark, d)
    p, u = s.where("not own").alias("p"), s.where("own").alias("u")
    meet = (F.col("p.o_custkey") == F.col("u.o_custkey")) & (F.col("u.page_end") >= F.col("p.page_start")) & (F.col("u.page_start") <= F.col("p.page_end"))
    return p.join(u, meet, "left_anti").select("o_orderkey")


@query(f"with recursive {_SEG}, r as (select *, row_number() over (partition by o_custkey order by own desc, o_totalprice desc, o_orderkey) as n from seg), f as (select o_custkey, n, [{{'k': o_orderkey, 's': page_start, 'e': page_end}}] as kept from r where n = 1 union all select r.o_custkey, r.n, case when len(list_filter(f.kept, lambda k: r.page_start <= k.e and r.page_end >= k.s)) = 0 then list_append(f.kept, {{'k': r.o_orderkey, 's': r.page_start, 'e': r.page_end}}) else f.kept end from f join r on r.o_custkey = f.o_custkey and r.n = f.n + 1), u as (select o_custkey, unnest(arg_max(kept, n)) as x from f group by 1) select o_custkey, x.k as o_orderkey, x.s as page_start, x.e as page_end from u")
def overlap_greedy(spark: SparkSession, d: str) -> DataFrame:
    """The user's segments first, then by confidence (price), each kept when apart from those kept."""
    s = _segments(spark, d)
    return drop_overlaps(s, [F.desc("own"), F.desc("o_totalprice"), F.asc("o_orderkey")], "o_custkey").select("o_custkey", "o_orderkey", "page_start", "page_end")


@query("with t as (select conv_id, turn, role, case when role = 'system' then 'B' || lpad((conv_id % 3 + 1)::varchar, 3, '0') end as code from conversations), x as (select *, coalesce(max(right(code, 3)::int) over (partition by conv_id), 0) as top, case when code is null and (role = 'user' or row_number() over (partition by conv_id order by turn) = 1) then 1 else 0 end as opens from t), y as (select *, sum(opens) over (partition by conv_id order by turn) as made from x) select conv_id, turn, last_value(coalesce(code, case when opens = 1 then 'B' || lpad((top + made)::varchar, 3, '0') end) ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as bundle_code from y")
def bundle_numbers(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("role") == "system", F.concat(F.lit("B"), F.lpad((F.col("conv_id") % 3 + 1).cast("string"), 3, "0")))
    t = load(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("label"), code.alias("reviewed_code"))
    return bundles(t, "conv_id", [F.asc("turn")], ["user"]).select("conv_id", "turn", "bundle_code")


_TURN_PAGES = "c as (select conv_id as doc_id, turn as page_no, case when turn % 4 = 1 then ' ' when turn % 4 = 3 then coalesce(text, '') || chr(10) || 'Page 1 / 9' else coalesce(text, '') || chr(10) || '- ' || turn || ' -' end as text, case when role = 'user' then 595.0 when turn % 5 = 4 then 900.0 else 842.0 end as width, case when role = 'user' then 842.0 else 595.0 end as height from conversations)"


@query(f"with {_TURN_PAGES}, l as (select *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ls from c), e as (select *, len(ls) = 0 as blank, try_cast(nullif(regexp_extract(array_to_string(list_concat(ls[1:2], list_reverse(ls)[1:2]), chr(10)), '(?im)^[^0-9a-z_\\n]*(?:page|trang)?[^0-9a-z_\\n]*([0-9]{{1,4}})(?:\\s*/\\s*[0-9]+)?[^0-9a-z_]*$', 1), '') as int) as no from l), p as (select *, lag(blank) over w as b, lag(width) over w as pw, lag(height) over w as ph, row_number() over w as n from e window w as (partition by doc_id order by page_no)), h as (select doc_id, page_no, list_filter([case when no = 1 and page_no > 1 then 'number_restarts' end, case when b and n > 2 then 'after_blank' end, case when (width > height) <> (pw > ph) then 'orientation' end, case when (abs(width - pw) > 0.05 * pw or abs(height - ph) > 0.05 * ph) and not (width > height) <> (pw > ph) then 'size' end], lambda x: x is not null) as hints from p) select doc_id, page_no, array_to_string(hints, ',') as hints from h where len(hints) > 0")
def split_cut_hints(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages with page numbers, blank ones, turned and resized ones."""
    t = F.coalesce("text", F.lit(""))
    body = F.when(F.col("turn") % 4 == 1, " ").when(F.col("turn") % 4 == 3, F.concat(t, F.lit("\nPage 1 / 9"))).otherwise(F.concat(t, F.lit("\n- "), F.col("turn").cast("string"), F.lit(" -")))
    width = F.when(F.col("role") == "user", 595.0).when(F.col("turn") % 5 == 4, 900.0).otherwise(842.0)
    c = load(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), body.alias("text"), width.alias("width"), F.when(F.col("role") == "user", 842.0).otherwise(595.0).alias("height"))
    return cut_hints(c).select("doc_id", "page_no", F.array_join("hints", ",").alias("hints"))
