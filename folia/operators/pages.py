"""What a reader sees of pages, and the text helpers behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load
from .documents import LINES, lines_of
from .headings import formula_problem

# -- text helpers ----------------------------------------------------------------------------


def words_with_offsets(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """word_no, start, stop (characters) and folded key, punctuation trimmed, of every word between white space."""
    cut = F.posexplode(F.regexp_extract_all("text", F.lit(r"(\s*\S+)"))).alias("word_no", "raw")
    w = Window.partitionBy(key).orderBy("word_no")
    rows = texts.select(key, cut).withColumn("stop", F.sum(F.length("raw")).over(w).cast("int"))
    word = F.regexp_replace("raw", r"^\s+", "")
    trimmed = F.regexp_replace(T.unaccent(word), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")
    return rows.select(key, "word_no", (F.col("stop") - F.length(word)).alias("start"), "stop", F.when(trimmed == "", word).otherwise(trimmed).alias("key"))


def clean_transcription(kind: Column, text: Column) -> Column:
    """C17: images dropped; headings on one line without marks; other text without trailing space and blank runs."""
    bare = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", ""), "\r\n", "\n")
    heading = T.collapse_space(F.replace(F.regexp_replace(bare, r"(?m)^#{1,6}\s+", ""), F.lit("*"), F.lit("")))
    body = F.regexp_replace(F.regexp_replace(bare, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.when(kind.isin("title", "heading"), heading).otherwise(F.regexp_replace(body, r"^\s+|\s+$", ""))


def plain_text(lines: DataFrame) -> DataFrame:
    """A page's text without furniture; a block with a transcription gives it once, in its first line's place.

    lines: doc_id, page_no, line_no, line, block_no, furniture, transcription (null: none), kind."""
    once = Window.partitionBy("doc_id", "page_no", "block_no").orderBy("line_no")
    whole = F.col("transcription").isNotNull() & (F.col("kind") != "table")
    said = F.when(~whole, F.nullif(F.col("line"), F.lit(""))).when(F.col("_n") == 1, F.col("transcription"))
    rows = lines.where(~F.col("furniture")).withColumn("_n", F.row_number().over(once)).withColumn("said", said).where("said is not null")
    return rows.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda r: r["said"]), "\n").alias("text"))


def locate(markdown: Column, lines: Column) -> Column:
    """Start of each line in the text, searched in order from the end of the one found before; -1 where absent."""
    start = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        at = F.call_function("locate", line, markdown, acc["cursor"])
        hit = (line != "") & (at > 0)
        return F.struct(F.when(hit, at + F.length(line)).otherwise(acc["cursor"]).alias("cursor"), F.array_append(acc["found"], F.when(hit, at - 1).otherwise(-1)).alias("found"))

    return F.aggregate(lines, start, step, lambda acc: acc["found"])


def ocr_text(text: Column, original: Column, source: Column) -> Column:
    """What OCR read: kept beside a rewritten line, nothing for a line a model made."""
    return F.when(F.coalesce(original, F.lit("")) != "", original).when(source == "vlm", F.lit("")).otherwise(text)


def pipe_rows(table: Column) -> Column:
    """A Markdown table's rows as 'cell | cell'; rules between rows are left out."""
    rows = F.filter(F.transform(F.split(table, "\n"), lambda r: F.trim(r)), lambda r: F.startswith(r, F.lit("|")) & (F.regexp_replace(r, r"[|\-: ]", "") != ""))
    return F.transform(rows, lambda r: F.array_join(F.transform(F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)), " | "))


def session_title(text: Column, most: int = 60) -> Column:
    """The first characters, never part of one, without space before the mark."""
    t = T.collapse_space(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…")))


def json_texts(json: Column) -> Column:
    """The values of a JSON object as one text, in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json(json, "map<string,string>"))), lambda e: e["value"]), " ")


def bands(parts: DataFrame, keys: list[str], top: float = 0.05, span: float = 0.9) -> DataFrame:
    """Stacked bands of a page, as high as their share of the text. Adds y0, y1; columns: part_no, weight."""
    by = Window.partitionBy(*keys)
    upto = F.sum("weight").over(by.orderBy("part_no"))
    total = F.greatest(F.sum("weight").over(by), F.lit(1))
    at = lambda sums: F.lit(top) + F.lit(span) * sums / total
    return parts.withColumn("y0", at(upto - F.col("weight"))).withColumn("y1", at(upto))


# -- what a reader sees ----------------------------------------------------------------------


def page_overview(pages: DataFrame, headings: DataFrame, sections: DataFrame) -> DataFrame:
    """Title, line count, a preview that is shorter the more pages a document shows, and the section.

    pages: doc_id, page_no, markdown; headings: doc_id, page_no, block_no, text (titles and headings, no furniture);
    sections: doc_id, page_no, section."""
    clean = T.collapse_space(F.regexp_replace("text", r"^[#\s]+", ""))
    titles = headings.withColumn("_t", clean).where("_t <> ''").groupBy("doc_id", "page_no").agg(F.min_by("_t", "block_no").alias("_t"))
    many = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    length = F.when(many > 200, 60).when(many > 50, 120).otherwise(240)
    flat = T.collapse_space(T.strip_md(F.col("markdown")))
    rows = pages.withColumn("_n", length).withColumn("_flat", flat).join(titles, ["doc_id", "page_no"], "left").join(sections, ["doc_id", "page_no"], "left")
    preview = F.when(F.length("_flat") > F.col("_n"), F.concat(F.left("_flat", F.col("_n")), F.lit("…"))).otherwise(F.col("_flat"))
    return rows.select("doc_id", "page_no", F.size(F.split("markdown", "\n")).alias("lines"), (F.col("_flat") == "").alias("blank"), T.truncate(F.coalesce("_t", F.lit("")), 160).alias("title"), preview.alias("preview"), "section")


def read_pages(lines: DataFrame, start: int, end: int, most: int = 10) -> DataFrame:
    """A document's pages start to end, ten at most, as numbered lines under page tags; blank lines keep their number.
    lines: doc_id, page_no, line_no, line."""
    start = max(start, 1)
    end = min(max(end, start), start + most - 1)
    kept = lines.where(F.col("page_no").between(start, end))
    said = F.when(F.trim("line") != "", F.concat(F.lit("[L"), F.col("line_no").cast("string"), F.lit("] "), "line", F.lit("\n"))).otherwise(F.lit(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", said.alias("said")))), lambda r: r["said"]), "")
    page = F.concat(F.lit('<page n="'), F.col("page_no").cast("string"), F.lit('" doc="'), F.col("doc_id").cast("string"), F.lit('">\n'), "body", F.lit("</page>\n"))
    pages = kept.groupBy("doc_id", "page_no").agg(body.alias("body")).select("doc_id", "page_no", page.alias("page"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page"))), lambda r: r["page"]), "").alias("text"))


# -- queries ---------------------------------------------------------------------------------


@query("with w as (select doc_id, unnest(range(len(r))) as word_no, unnest(r) as raw from (select doc_id, regexp_extract_all(text, '\\s*\\S+') as r from documents)), x as (select *, sum(length(raw)) over (partition by doc_id order by word_no) as stop, regexp_replace(raw, '^\\s+', '') as word from w) select doc_id, word_no::int as word_no, (stop - length(word))::int as start, stop::int as stop, coalesce(nullif(regexp_replace(lower(strip_accents(replace(replace(word, 'đ', 'd'), 'Đ', 'D'))), '^[^\\p{L}\\p{Nd}]+|[^\\p{L}\\p{Nd}]+$', '', 'g'), ''), word) as key from x")
def word_offsets(spark: SparkSession, d: str) -> DataFrame:
    """C16."""
    return words_with_offsets(load(spark, d, "documents"))


@query("select doc_id, md5(case when doc_id % 2 = 0 then trim(regexp_replace(replace(text, '*', ''), '\\s+', ' ', 'g')) else regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') end) as digest from documents")
def transcription_clean(spark: SparkSession, d: str) -> DataFrame:
    """C17: images and marks are put in first, and must go again."""
    kind = F.when(F.col("doc_id") % 2 == 0, "heading").otherwise("text")
    marked = F.when(kind == "heading", F.concat(F.lit("## ![x](y.png)"), "text")).otherwise(F.concat("text", F.lit("![](z)")))
    return load(spark, d, "documents").select("doc_id", F.md5(clean_transcription(kind, marked)).alias("digest"))


@query(f"with l as (select doc_id, (line_no - 1) // 6 + 1 as page_no, line_no, line, (line_no - 1) // 2 as block_no, line_no % 7 = 0 as furniture, ((line_no - 1) // 2) % 3 = 0 as whole, ((line_no - 1) // 2) % 2 = 0 as tabular from {LINES}), s as (select *, row_number() over (partition by doc_id, page_no, block_no order by line_no) as n from l where not furniture), t as (select doc_id, page_no, line_no, case when whole and not tabular then case when n = 1 then 'block ' || block_no end else nullif(line, '') end as said from s) select doc_id, page_no, md5(string_agg(said, chr(10) order by line_no)) as digest from t where said is not null group by 1, 2")
def page_plain_text(spark: SparkSession, d: str) -> DataFrame:
    """Six lines a page, two a block."""
    at = F.col("line_no") - 1
    block = F.floor(at / 2)
    rows = lines_of(load(spark, d, "documents")).withColumn("page_no", F.floor(at / 6) + 1).withColumn("block_no", block).withColumn("furniture", F.col("line_no") % 7 == 0)
    rows = rows.withColumn("transcription", F.when(F.col("block_no") % 3 == 0, F.concat(F.lit("block "), F.col("block_no").cast("string")))).withColumn("kind", F.when(F.col("block_no") % 2 == 0, "table").otherwise("text"))
    return plain_text(rows).select("doc_id", "page_no", F.md5("text").alias("digest"))


@query(f"select doc_id, line_no, case when line = '' then -1 else (sum(length(line) + 1) over (partition by doc_id order by line_no) - length(line) - 1)::int end as start from {LINES} union all select doc_id, len(string_split(text, chr(10))) + 1, -1 from documents")
def line_locations(spark: SparkSession, d: str) -> DataFrame:
    """Every line found in its own text in order, repeated ones each at its place; a last one isn't there."""
    lines = F.array_append(F.split("text", "\n"), F.lit("\x01 missing"))
    found = load(spark, d, "documents").select("doc_id", F.posexplode(locate(F.col("text"), lines)).alias("p", "start"))
    return found.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "start")


@query("select event_id, case when event_type = 'view' then event_type when user_id % 3 = 0 then '' else props end as text from events")
def ocr_fallback(spark: SparkSession, d: str) -> DataFrame:
    """C24."""
    original = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.lit(""))
    source = F.when(F.col("user_id") % 3 == 0, "vlm").otherwise("ocr")
    return load(spark, d, "events").select("event_id", ocr_text(F.col("props"), original, source).alias("text"))


@query("select o_orderkey, 'key | state' as head, o_orderkey || ' | ' || o_orderstatus as body, 2 as n from orders")
def pipe_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """C25."""
    table = F.concat(F.lit("| key | state |\n|---|:--:|\n\n| "), F.col("o_orderkey").cast("string"), F.lit(" |"), "o_orderstatus", F.lit(" |\nnote"))
    rows = load(spark, d, "orders").select("o_orderkey", pipe_rows(table).alias("r"))
    return rows.select("o_orderkey", F.col("r")[0].alias("head"), F.col("r")[1].alias("body"), F.size("r").alias("n"))


@query("with t as (select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from conversations) select conv_id, turn, case when length(t) <= 60 then t else rtrim(left(t, 60)) || '…' end as title from t")
def session_titles(spark: SparkSession, d: str) -> DataFrame:
    """Cut by characters in accented text."""
    return load(spark, d, "conversations").select("conv_id", "turn", session_title(F.coalesce("text", F.lit(""))).alias("title"))


@query("select event_id, event_type || ' ' || (props->>'k') as texts from events")
def json_value_texts(spark: SparkSession, d: str) -> DataFrame:
    """An object with its keys out of order."""
    made = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": "'), "event_type", F.lit('"}'))
    return load(spark, d, "events").select("event_id", json_texts(made).alias("texts"))


@query("with w as (select l_orderkey, l_linenumber, l_quantity::bigint as weight from lineitem), s as (select *, sum(weight) over (partition by l_orderkey order by l_linenumber) as upto, sum(weight) over (partition by l_orderkey) as total from w) select l_orderkey, l_linenumber, round((0.05::double + 0.9::double * (upto - weight) / total) * 1e5 - 0.01) as y0, round((0.05::double + 0.9::double * upto / total) * 1e5 - 0.01) as y1 from s")
def page_bands(spark: SparkSession, d: str) -> DataFrame:
    """lines' quantities as text lengths."""
    parts = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("part_no"), F.col("l_quantity").cast("bigint").alias("weight"))
    return bands(parts, ["l_orderkey"]).select("l_orderkey", "l_linenumber", *[F.round(F.col(y) * 1e5 - 0.01, 0).alias(y) for y in ("y0", "y1")])


@query("select p_partkey, case p_partkey % 6 when 0 then null when 1 then 'no column Z' when 2 then 'unknown function' when 3 then 'not a cell reference' when 4 then 'parentheses don''t match' else null end as problem from part")
def form_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas in turn, each with another fault."""
    made = ["=SUM(B{first}:B{last}) * 2", "=Z{r}+1", "=EVIL(B{r})", "=B7 + 1", "=ROUND(B{r}, 2", '=IF(B{r} > C{r}, "yes (B7)", 0)']
    f = F.element_at(F.array(*[F.lit(x) for x in made]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", formula_problem(f, ["B", "C"]).alias("problem"))


@query("with p as (select conv_id as doc_id, turn as page_no, coalesce(text, '') as md from conversations), h as (select doc_id, page_no, string_split(md, chr(10))[1] as t from p where page_no % 2 = 0), f as (select p.*, trim(regexp_replace(regexp_replace(regexp_replace(md, '(?m)^#{1,6}\\s+', '', 'g'), '[*_`|]', '', 'g'), '\\s+', ' ', 'g')) as flat, trim(regexp_replace(regexp_replace(coalesce(t, ''), '^[#\\s]+', ''), '\\s+', ' ', 'g')) as title from p left join h using (doc_id, page_no)) select doc_id, page_no, len(string_split(md, chr(10)))::int as lines, flat = '' as blank, case when length(title) > 160 then left(title, 160) || '…' else title end as title, case when length(flat) > 240 then left(flat, 240) || '…' else flat end as preview, case when page_no < 2 then 'first' end as section from f")
def page_overviews(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages, each second one with its first line as a heading."""
    pages = load(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.coalesce("text", F.lit("")).alias("markdown"))
    heads = pages.where("page_no % 2 = 0").select("doc_id", "page_no", F.lit(0).alias("block_no"), F.concat(F.lit("## "), F.split("markdown", "\n")[0]).alias("text"))
    heads = heads.unionByName(heads.select("doc_id", "page_no", F.lit(1).alias("block_no"), F.lit("later").alias("text")).where("text = 'never'"))
    sections = pages.where("page_no < 2").select("doc_id", "page_no", F.lit("first").alias("section"))
    return page_overview(pages, heads, sections)


@query("with l as (select conv_id as doc_id, turn + 1 as page_no, unnest(range(1, len(s) + 1)) as line_no, unnest(s) as line from (select conv_id, turn, string_split(coalesce(text, ''), chr(10)) as s from conversations)), p as (select doc_id, page_no, '<page n=\"' || page_no || '\" doc=\"' || doc_id || '\">' || chr(10) || coalesce(string_agg('[L' || line_no || '] ' || line || chr(10), '' order by line_no) filter (where trim(line) <> ''), '') || '</page>' || chr(10) as page from l where page_no between 1 and 10 group by 1, 2) select doc_id, md5(string_agg(page, '' order by page_no)) as digest from p group by 1")
def numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages; twelve are asked for, ten come."""
    turns = load(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "line"))
    lines = turns.select("doc_id", "page_no", (F.col("p") + 1).alias("line_no"), "line")
    return read_pages(lines, 0, 12).select("doc_id", F.md5("text").alias("digest"))
