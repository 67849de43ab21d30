"""Sources and sinks: files with digests, OCR JSON, Markdown regions, HTML tables, keyed overwrites."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as T
from ..registry import query
from ..session import load

# First bytes of the accepted kinds, fixed values.
MAGIC = (("application/pdf", "25504446"), ("image/png", "89504E47"), ("image/jpeg", "FFD8FF"), ("image/tiff", "49492A00"), ("application/zip", "504B0304"))


def files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Files with kind by first bytes, size and SHA-256; larger ones than most_bytes aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        df = df.where(F.col("length") <= most_bytes)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.coalesce(*[F.when(F.startswith(head, F.lit(m)), F.lit(k)) for k, m in MAGIC], F.lit("application/octet-stream"))
    return df.select("path", "length", kind.alias("mime"), F.sha2("content", 256).alias("sha256"), "content")


def pdf_conformance(content: Column) -> Column:
    """Part and conformance of a PDF/A marker; null without one. Levels a and u hold trusted text."""
    s = F.decode(content, "ISO-8859-1")
    part = F.coalesce(F.nullif(F.regexp_extract(s, r"pdfaid:part(?:>|=[\"'])\s*(\d)", 1), F.lit("")), F.lit(None))
    level = F.lower(F.regexp_extract(s, r"pdfaid:conformance(?:>|=[\"'])\s*([A-Za-z])", 1))
    return F.when(part.isNotNull(), F.struct(part.cast("int").alias("part"), level.alias("conformance"), level.isin("a", "u").alias("trusted_text")))


OCR = "struct<results:array<struct<id:int,text:string,confidence:double,bounding_box:array<array<double>>,layout_id:int>>,layout:array<struct<id:int,class:string,confidence:double,bounding_box:array<array<double>>>>,reading_order:array<int>,tables:array<struct<layout_id:int,html:string>>,formulas:array<struct<layout_id:int,latex:string>>>"


def quad(points: Column) -> Column:
    """Two corner points become the four corners; four stay."""
    a, b = points[0], points[1]
    return F.when(F.size(points) == 2, F.array(F.array(a[0], a[1]), F.array(b[0], a[1]), F.array(b[0], b[1]), F.array(a[0], b[1]))).otherwise(points)


def ocr_pages(df: DataFrame, body: str = "body") -> DataFrame:
    """An OCR reply as lines and regions with four-point boxes; tables and formulas join their region."""
    o = df.withColumn("_o", F.from_json(body, OCR))
    lines = F.transform("_o.results", lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text"), r["confidence"].alias("confidence"), quad(r["bounding_box"]).alias("quad"), r["layout_id"].alias("layout_id")))
    html = F.map_from_entries(F.transform(F.coalesce("_o.tables", F.array().cast("array<struct<layout_id:int,html:string>>")), lambda t: F.struct(t["layout_id"], t["html"])))
    latex = F.map_from_entries(F.transform(F.coalesce("_o.formulas", F.array().cast("array<struct<layout_id:int,latex:string>>")), lambda t: F.struct(t["layout_id"], t["latex"])))
    o = o.withColumn("_h", html).withColumn("_l", latex)
    regions = F.transform("_o.layout", lambda r: F.struct(r["id"].alias("id"), r["class"].alias("class"), r["confidence"].alias("confidence"), quad(r["bounding_box"]).alias("quad"), F.try_element_at(F.col("_h"), r["id"]).alias("html"), F.try_element_at(F.col("_l"), r["id"]).alias("latex")))
    return o.withColumn("lines", lines).withColumn("regions", regions).withColumn("reading_order", F.col("_o.reading_order")).drop("_o", "_h", "_l")


_TITLE = re.compile(r"^[^a-zà-ỹ]{4,80}$")
_LEGAL = re.compile(r"^(?:chương|mục|điều|phần|chapter|section|article|part)\s+[\divxlc]+", re.I)


def markdown_regions(md: str) -> list[tuple[str, str]]:
    """(kind, text) regions: headings, tables, formulas, figures and paragraphs, by lines."""
    out: list[tuple[str, list[str]]] = []
    mode = None
    for line in md.split("\n"):
        s = line.strip()
        if mode == "formula":
            out[-1][1].append(line)
            if s.endswith("$$"):
                mode = None
            continue
        if not s:
            mode = None
        elif s.startswith("$$"):
            out.append(("formula", [line]))
            mode = None if s.endswith("$$") and len(s) > 3 else "formula"
        elif s.startswith("|"):
            if mode != "table":
                out.append(("table", []))
            mode = "table"
            out[-1][1].append(line)
        elif re.match(r"^!\[[^\]]*\]\([^)]*\)$", s):
            out.append(("figure", [line]))
            mode = None
        elif re.match(r"^#{1,6}\s", s) or _LEGAL.match(s) or (_TITLE.match(s) and any(c.isalpha() for c in s)):
            out.append(("title" if s.startswith("# ") else "heading", [line]))
            mode = None
        else:
            if mode != "paragraph":
                out.append(("paragraph", []))
            mode = "paragraph"
            out[-1][1].append(line)
    return [(k, "\n".join(t)) for k, t in out]


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())])))
def split_markdown(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"kind": k, "text": x} for k, x in markdown_regions(t or "")])


class _Table(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[dict]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append({"text": "", "colspan": int(a.get("colspan") or 1), "rowspan": int(a.get("rowspan") or 1), "header": tag == "th"})
            self.open = True
        elif tag == "br" and self.open:
            self.rows[-1][-1]["text"] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1]["text"] += data


def html_table(html: str) -> list[list[dict]]:
    """Rows of cells with text, spans and header flag."""
    p = _Table()
    p.feed(html or "")
    return [[c | {"text": " ".join(c["text"].split())} for c in r] for r in p.rows]


def table_markdown(html: str) -> str:
    """A pipe table; column spans repeat as empty cells, bars are escaped."""
    rows = [[x for c in r for x in [c["text"].replace("|", "\\|"), *[""] * (c["colspan"] - 1)]] for r in html_table(html)]
    if not rows:
        return ""
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


@F.pandas_udf(StringType())
def to_pipe_table(s: pd.Series) -> pd.Series:
    return s.map(table_markdown)


@query("select page_id, url, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) as host, coalesce(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1), '') as title from pages")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    host = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")[0]
    return load(spark, d, "pages").select("page_id", "url", host.alias("host"), F.regexp_extract("html", "(?i)<title[^>]*>([^<]*)</title>", 1).alias("title"))


_LINE_KINDS = "l as (select doc_id, unnest(range(1, len(x) + 1)) as n, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)), t as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as s from l), k as (select *, case when s = '' then 'blank' when starts_with(s, '|') then 'table' when regexp_matches(s, '^#{1,6}\\s') or regexp_matches(s, '(?i)^(?:chương|mục|điều|phần|chapter|section|article|part)\\s+[0-9ivxlc]+') or (regexp_matches(s, '^[^a-zà-ỹ]{4,80}$') and regexp_matches(s, '\\p{L}')) then case when starts_with(s, '# ') then 'title' else 'heading' end else 'paragraph' end as kind from t), r as (select *, sum(case when kind in ('title', 'heading') or kind is distinct from prev then 1 else 0 end) over (partition by doc_id order by n) as region from (select *, lag(kind) over (partition by doc_id order by n) as prev from k))"


@query(f"with {_LINE_KINDS}, g as (select doc_id, region, min(kind) as kind, (sum(length(line) + 1) - 1)::int as chars from r where kind <> 'blank' group by 1, 2) select doc_id, (row_number() over (partition by doc_id order by region) - 1)::int as no, kind, chars from g")
def markdown_region_split(spark: SparkSession, d: str) -> DataFrame:
    """Headings, tables and paragraphs of every document, by runs of lines of a kind."""
    r = load(spark, d, "documents").select("doc_id", F.posexplode(split_markdown("text")).alias("no", "r"))
    return r.select("doc_id", "no", "r.kind", F.length("r.text").alias("chars"))


@query("select o_orderkey, '| Key | ' || o_orderpriority || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderstatus || ' | a\\|b |' as md from orders")
def html_table_to_pipes(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>Key</th><th>"), "o_orderpriority", F.lit("</th></tr><tr><td>"), "o_orderstatus", F.lit("</td><td>a|b</td></tr></table>"))
    return load(spark, d, "orders").select("o_orderkey", to_pipe_table(html).alias("md"))


@query("select l_orderkey, l_linenumber, 'line ' || l_linenumber as text, (l_quantity + 10)::double as x1, 'table' as class from lineitem")
def ocr_decode(spark: SparkSession, d: str) -> DataFrame:
    """OCR replies built from order lines and decoded again."""
    body = F.format_string('{"results":[{"id":1,"text":"line %d","confidence":0.9,"bounding_box":[[0,0],[%s,5]],"layout_id":7}],"layout":[{"id":7,"class":"table","confidence":1,"bounding_box":[[0,0],[9,0],[9,9],[0,9]]}],"reading_order":[1],"tables":[{"layout_id":7,"html":"<table/>"}],"formulas":[]}', "l_linenumber", (F.col("l_quantity") + 10).cast("string"))
    p = ocr_pages(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", body.alias("body")))
    return p.select("l_orderkey", "l_linenumber", F.col("lines")[0]["text"].alias("text"), F.col("lines")[0]["quad"][2][0].alias("x1"), F.when(F.col("regions")[0]["html"] == "<table/>", F.col("regions")[0]["class"]).alias("class"))


@query("select doc_id, length(text) as chars from documents")
def sanitised_text(spark: SparkSession, d: str) -> DataFrame:
    """Repaired UTF-8 without NUL characters."""
    dirty = F.concat(F.lit("\0"), "text")
    return load(spark, d, "documents").select("doc_id", F.length(T.sanitize(dirty)).cast("bigint").alias("chars"))
