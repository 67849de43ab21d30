"""Scans, filters, facets and text functions over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """A row a line: doc_id, columns to keep, line_no from 1, line."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", *keep, (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


def document_filter(*, statuses=None, ids=None, cases=None, text: str | None = None, before: Column | None = None, more: Column | None = None) -> Column:
    """AND of what is given; what isn't given doesn't filter. Long id lists belong into a semi join."""
    out = F.lit(True)
    if statuses:
        out &= F.col("status").isin(list(statuses))
    if ids:
        out &= F.col("doc_id").isin(list(ids))
    if cases:
        out &= F.col("case_id").isin(list(cases))
    if text:
        out &= T.contains_fold(F.col("text"), F.lit(text))
    if before is not None:
        out &= F.col("created_at") < before
    if more is not None:
        out &= more
    return out


def visible(gen: str = "gen", doc_gen: str = "doc_gen", deleted: str = "deleted_at", status: str = "status") -> Column:
    """Rows of the document's current generation that aren't deleted and are ready for search."""
    return (F.col(gen) == F.col(doc_gen)) & F.col(deleted).isNull() & F.col(status).isin("completed", "partial")


def facet(df: DataFrame, value: Column, prefix: str = "", top: int | None = None) -> DataFrame:
    """Distinct values with counts, most frequent first, then by value; the prefix ignores accents and case."""
    out = df.select(value.cast("string").alias("value")).where("value is not null")
    if prefix:
        out = out.where(F.startswith(T.unaccent(F.col("value")), T.unaccent(F.lit(prefix))))
    out = out.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


FOLD = "lower(strip_accents(replace(replace({}, 'đ', 'd'), 'Đ', 'D')))"
NORM = "trim(regexp_replace(" + FOLD + ", '\\s+', ' ', 'g'))"
LINES = "(select doc_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))"


@query("select doc_id from documents where lang in ('en', 'de') and doc_id not in (1, 2) and contains(lower(strip_accents(text)), 'license') and n_chars < 3000")
def document_filters(spark: SparkSession, d: str) -> DataFrame:
    """optional parts joined by and; what isn't given doesn't filter."""
    docs = load(spark, d, "documents").withColumn("status", F.col("lang"))
    keep = document_filter(statuses=["en", "de"], text="LICENSE", more=~F.col("doc_id").isin(1, 2) & (F.col("n_chars") < 3000))
    return docs.where(keep & document_filter()).select("doc_id")


@query("select event_id from events where user_id % 3 = 1 and event_type <> 'error' and event_type in ('view', 'purchase')")
def visible_rows(spark: SparkSession, d: str) -> DataFrame:
    """current generation, not deleted, ready."""
    status = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "purchase", "partial").otherwise("pending")
    rows = load(spark, d, "events").withColumns({"gen": F.col("user_id") % 3, "doc_gen": F.lit(1), "deleted_at": F.when(F.col("event_type") == "error", F.col("ts")), "status": status})
    return rows.where(visible()).select("event_id")


@query(f"select doc_id, lang from documents where contains({NORM.format('text')}, 'licensed under the apache')")
def doc_fold_contains(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(T.contains_fold(F.col("text"), F.lit("Licensed  UNDER thé Apache"))).select("doc_id", "lang")


@query("select source as value, count(*) as n from documents where lang = 'en' and starts_with(lower(strip_accents(source)), 'src1') group by 1 order by n desc, value limit 5")
def doc_facet_lang_source(spark: SparkSession, d: str) -> DataFrame:
    return facet(load(spark, d, "documents").where("lang = 'en'"), F.col("source"), "SRC1", 5)


@query("select source, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'es') as es, count(*) filter (where lang = 'fr') as fr, count(*) as total from documents group by source")
def lang_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    by = load(spark, d, "documents").groupBy("source")
    return by.agg(*[F.count_if(F.col("lang") == x).alias(x) for x in ("de", "en", "es", "fr")], F.count(F.lit(1)).alias("total"))


@query(f"select min(doc_id) as doc_id, count(*) as copies, left(md5(k), 8) as key_md5 from (select doc_id, case when regexp_full_match(f, '[0-9 .,\\-/_'']*') and regexp_replace(f, '[^0-9]', '', 'g') <> '' then regexp_replace(f, '[^0-9]', '', 'g') else regexp_replace(f, '[^\\p{{L}}\\p{{Nd}}]', '', 'g') end as k from (select doc_id, {FOLD.format('trim(text)')} as f from documents)) group by k")
def doc_value_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    keyed = load(spark, d, "documents").select("doc_id", T.value_key(F.col("text")).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies", F.left(F.md5("k"), F.lit(8)).alias("key_md5"))


@query("select lang, sum(case when length(text) = 0 then 0 else length(text) // 3 + 1 end)::bigint as tokens, max(case when length(text) = 0 then 0 else length(text) // 3 + 1 end)::bigint as most, sum((strlen(text) + 3) // 4)::bigint as byte_tokens from documents group by lang")
def doc_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = T.estimate_tokens(F.col("text"))
    return load(spark, d, "documents").groupBy("lang").agg(F.sum(t).alias("tokens"), F.max(t).alias("most"), F.sum(T.history_tokens(F.col("text"))).alias("byte_tokens"))


@query("with t as (select doc_id, regexp_replace(text, '\\s', '', 'g') as t from documents) select doc_id, case when length(t) = 0 then 0.0 else round(length(regexp_replace(t, '[^\\x{fffd}\\p{Co}\\p{Cc}]', '', 'g')) / length(t), 6) end as bad from t")
def doc_bad_char_ratio(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.round(T.bad_char_ratio(F.col("text")), 6).alias("bad"))


@query("select doc_id, case when length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 then 0.0 else round(length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 6) end as latin from documents")
def doc_latin_ratio(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.round(T.latin_ratio(F.col("text")), 6).alias("latin"))


@query(f"select doc_id, line_no, length(line) as chars, md5(line) as line_md5 from {LINES}")
def doc_line_explode(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(load(spark, d, "documents")).select("doc_id", "line_no", F.length("line").cast("bigint").alias("chars"), F.md5("line").alias("line_md5"))


@query(f"select doc_id, line_no, (sum(length(line) + 1) over (partition by doc_id order by line_no) - length(line) - 1)::bigint as start, (sum(length(line) + 1) over (partition by doc_id order by line_no) - 1)::bigint as stop from {LINES}")
def doc_line_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = lines_of(load(spark, d, "documents"))
    stop = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.select("doc_id", "line_no", (stop - F.length("line") - 1).cast("bigint").alias("start"), (stop - 1).cast("bigint").alias("stop"))


def repeated_lines(lines: DataFrame, group: str, page: str, ratio: float = 0.6, pages: DataFrame | None = None) -> DataFrame:
    """Lines whose key is on at least max(2, ceil(ratio * pages)) pages of their group.

    A page's equal lines become one before anything moves by group, so a hot group is a count a task. pages: group
    and page, where a table of them is cheaper than the lines' own."""
    once = lines.select(group, page, T.furniture_key(F.col("line")).alias("key")).distinct()
    pages = (lines if pages is None else pages).select(group, page).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("pages"))
    seen = once.where("key <> ''").groupBy(group, "key").agg(F.count(F.lit(1)).alias("on_pages"))
    return seen.join(pages, group).where(F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.lit(ratio) * F.col("pages"))))


@query(f"with l as (select source, doc_id, regexp_replace({NORM.format('line')}, '\\d+', '#', 'g') as key from {LINES} join documents using (doc_id)), n as (select source, count(distinct doc_id) as pages from documents group by 1) select source, key, count(distinct doc_id) as on_pages from l join n using (source) where key <> '' group by source, key, pages having count(distinct doc_id) >= greatest(2, ceil(0.05 * pages))")
def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return repeated_lines(lines_of(docs, "source"), "source", "doc_id", 0.05, docs).select("source", "key", "on_pages")


@query(f"select doc_id, line_no, 1.0::double as score from {LINES} where contains({NORM.format('line')}, 'mit license') order by doc_id, line_no limit 50")
def line_contains_search(spark: SparkSession, d: str) -> DataFrame:
    hit = lines_of(load(spark, d, "documents")).where(T.contains_fold(F.col("line"), F.lit("MIT License")))
    return hit.select("doc_id", "line_no", F.lit(1.0).alias("score")).orderBy("doc_id", "line_no").limit(50)


@query("select doc_id, line_no, first_line, last_line from (select doc_id, line_no, 'doc:' || doc_id || ':p1:l' || line_no || '-l' || (line_no + 2) as c, line_no as first_line, line_no + 2 as last_line from " + LINES + ")")
def citation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Citations formatted and parsed again."""
    rows = lines_of(load(spark, d, "documents"))
    p = T.parse_citation(T.citation(F.col("doc_id"), F.lit(1), F.col("line_no"), F.col("line_no") + 2))
    return rows.select(p.alias("p"), "line_no").select(F.col("p.doc").cast("bigint").alias("doc_id"), "line_no", F.col("p.first").cast("bigint").alias("first_line"), F.col("p.last").cast("bigint").alias("last_line"))


@query("select o_orderkey, round(1 - levenshtein(lower(o_orderpriority), lower(c_mktsegment)) / greatest(length(o_orderpriority), length(c_mktsegment)), 6) as similarity from orders join customer on o_custkey = c_custkey")
def doc_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """C03 on two short texts of every order (ASCII, so both engines count the same edits)."""
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    pairs = load(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return pairs.select("o_orderkey", F.round(T.similarity(F.col("o_orderpriority"), F.col("c_mktsegment")), 6).alias("similarity"))


@query("with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents), b as (select word, count(*) as m from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark) group by 1), c as (select doc_id, word, count(*) as n from w group by 1, 2) select doc_id, round(sum(least(n, coalesce(m, 0))) / sum(n), 6)::double as overlap from c left join b using (word) group by doc_id")
def word_overlap_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Share of a document's word multiset met by the benchmark's."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word"))
    mine = words(load(spark, d, "documents"), "doc_id").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    theirs = words(load(spark, d, "benchmark")).groupBy("word").agg(F.count(F.lit(1)).alias("m"))
    return mine.join(theirs, "word", "left").groupBy("doc_id").agg(F.round(F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n"), 6).alias("overlap"))


@query("select page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[\\s\\S]*?</(script|style)>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as chars from pages")
def pages_strip_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("html", r"(?i)<(script|style)[^>]*>[\s\S]*?</(script|style)>", " "), r"<[^>]+>", " ")
    return load(spark, d, "pages").select("page_id", F.length(T.collapse_space(t)).cast("bigint").alias("chars"))


@query("select doc_id, source, n_chars from documents where n_chars between 1000 and 1400 and lang in ('en', 'fr') and source not in ('src3') order by doc_id")
def page_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """A range with membership tests; both reach the scan."""
    docs = load(spark, d, "documents").where(F.col("n_chars").between(1000, 1400) & F.col("lang").isin("en", "fr") & ~F.col("source").isin("src3"))
    return docs.select("doc_id", "source", "n_chars").orderBy("doc_id")


@query("select event_id, user_id, event_type from events where (ts, event_id) < (timestamp '2024-01-15 00:00:00', 0) order by ts desc, event_id desc limit 20")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """One page before a position."""
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rows = load(spark, d, "events").where((F.col("ts") < at) | ((F.col("ts") == at) & (F.col("event_id") < 0)))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


def markdown_document(pages: DataFrame, doc: str, page: str, body: str) -> DataFrame:
    """Pages of a document joined under page markers, with each page's offset in the whole."""
    piece = F.concat(F.lit("<!-- page:"), F.col(page).cast("string"), F.lit(" -->\n"), F.col(body), F.lit("\n"))
    w = Window.partitionBy(doc).orderBy(page)
    offset = F.coalesce(F.sum(F.length(piece)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pages.select(doc, page, piece.alias("piece"), offset.alias("offset"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "piece"))), lambda r: r["piece"]), "").alias("markdown"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(page, "offset")))).alias("offsets"))


@query("with p as (select conv_id, turn, '<!-- page:' || turn || ' -->' || chr(10) || coalesce(text, '') || chr(10) as piece from conversations) select conv_id, md5(string_agg(piece, '' order by turn)) as digest, sum(length(piece))::bigint as chars from p group by conv_id")
def markdown_sink(spark: SparkSession, d: str) -> DataFrame:
    turns = load(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return markdown_document(turns, "conv_id", "turn", "text").select("conv_id", F.md5("markdown").alias("digest"), F.length("markdown").cast("bigint").alias("chars"))
