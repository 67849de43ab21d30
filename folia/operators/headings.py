"""Headings of a page: which blocks belong under one, as windows over the blocks of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..session import load
from .documents import lines_of

# A heading has at most WORDS words; a group under LEAST tokens is small; such a start numbers a heading.
WORDS, LEAST = 20, 30
NUMBERED = r"^[0-9IVXLC]+[.)]"


def heading_groups(blocks: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """A page's blocks under their headings: doc_id, page_no, seq, title, level, body, tokens.

    blocks: doc_id, page_no, block_no, kind, level, text, tokens. A heading goes on with the one just before it where
    both have one level, that one doesn't end in a colon and this one has no number. A small group with another one
    behind it is taken into the group before, unless it stands higher: between two groups that stay for another
    reason, it stays only if its level is below every level since the first of them. One shuffle, by page.
    """
    page = Window.partitionBy("doc_id", "page_no")
    by = page.orderBy("block_no")
    n_words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = blocks.withColumn("head", F.col("kind").isin("title", "heading") & (n_words <= words))
    before = {c: F.lag(c).over(by) for c in ("head", "level", "text")}
    goes_on = F.col("head") & before["head"] & (before["level"] == F.col("level")) & (before["text"] != "") & ~F.endswith(before["text"], F.lit(":")) & ~F.col("text").rlike(NUMBERED)
    starts = before["head"].isNull() | (F.col("head") & ~F.coalesce(goes_on, F.lit(False)))
    rows = rows.withColumn("starts", starts).withColumn("grp", F.sum(F.col("starts").cast("int")).over(by))

    held = F.array_sort(F.collect_list(F.struct("block_no", "head", "level", "text")))
    groups = rows.groupBy("doc_id", "page_no", "grp").agg(held.alias("held"), F.sum("tokens").alias("tokens"))
    heads, rest = F.filter("held", lambda b: b["head"]), F.filter("held", lambda b: ~b["head"])
    groups = groups.withColumn("title", F.array_join(F.transform(heads, lambda b: b["text"]), " ")).withColumn("body", F.transform(rest, lambda b: b["text"]))
    groups = groups.withColumn("level", F.coalesce(F.try_element_at(heads, F.lit(1))["level"], F.lit(0)).cast("int"))

    order = page.orderBy("grp")
    small = (F.col("title") != "") & (F.col("tokens") < least) & (F.lead("grp").over(order).isNotNull()) & (F.lag("grp").over(order).isNotNull())
    groups = groups.withColumn("small", small).withColumn("run", F.sum((~F.col("small")).cast("int")).over(order))
    lowest = F.min("level").over(Window.partitionBy("doc_id", "page_no", "run").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("stays", ~F.col("small") | (F.col("level") < lowest)).withColumn("seq", F.sum(F.col("stays").cast("int")).over(order))

    said = F.when(F.col("stays"), F.col("body")).otherwise(F.concat(F.array("title"), F.col("body")))
    parts = F.array_sort(F.collect_list(F.struct("grp", said.alias("said"))))
    out = groups.groupBy("doc_id", "page_no", "seq").agg(F.min_by("title", "grp").alias("title"), F.min_by("level", "grp").alias("level"), parts.alias("parts"), F.sum("tokens").alias("tokens"))
    return out.select("doc_id", "page_no", "seq", "title", "level", F.flatten(F.transform("parts", lambda p: p["said"])).alias("body"), "tokens")


# Functions a form's formula may use: fixed names of the spreadsheet language.
FORM_FUNCTIONS = (
    "ABS AND AVERAGE COUNT COUNTA COUNTIF COUNTIFS IF IFERROR MAX MIN OR ROUND ROUNDDOWN ROUNDUP SUM SUMIF SUMIFS SUMPRODUCT"
).split()
_PIECES = r'("[^"]*"|[A-Za-z$]+\{[a-z]*\}|[A-Za-z][A-Za-z0-9.]*\s*\(|[0-9]+(?:\.[0-9]+)?|[A-Za-z]+[0-9]*|.)'


def formula_problem(formula: Column, columns: list[str], total: bool = False) -> Column:
    """The first fault of a form's formula, null for a good one.

    The formula is cut into pieces, each judged by its kind: texts and numbers are good; a cell is written D{r},
    D{first} or D{last} and its column must be known (a totals row knows no {r}); a call's name must be one of
    FORM_FUNCTIONS; else only marks of arithmetic, comparison and lists. Parentheses are judged last.
    """
    pieces = F.regexp_extract_all(F.regexp_replace(F.trim(formula), "^=", ""), F.lit("(?s)" + _PIECES))

    def judged(p: Column) -> Column:
        row, column = F.regexp_extract(p, r"\{(.*)\}$", 1), F.regexp_replace(p, r"\$|\{.*$", "")
        cell = (
            F.when(~row.isin("r", "first", "last"), F.lit("not a cell reference"))
            .when(~column.isin(columns), F.concat(F.lit("no column "), column))
            .when(F.lit(total) & (row == "r"), "a total can't use {r}")
        )
        name = F.upper(F.trim(F.regexp_replace(p, r"\($", "")))
        return (
            F.when(F.endswith(p, F.lit("}")), cell)
            .when(F.endswith(p, F.lit("(")), F.when((name != "") & ~name.isin(FORM_FUNCTIONS), "unknown function"))
            .when((F.length(p) > 1) & F.startswith(p, F.lit('"')), F.lit(None).cast("string"))
            .when(~p.rlike(r"^(?s:[0-9.]+|[,:;+\-*/^&%<>=)\s])$"), "not a cell reference")
        )

    open_now = F.aggregate(pieces, F.lit(0), lambda n, p: F.when(n < 0, n).otherwise(n + F.endswith(p, F.lit("(")).cast("int") - (p == ")").cast("int")))
    return F.coalesce(F.try_element_at(F.array_compact(F.transform(pieces, judged)), F.lit(1)), F.when(open_now != 0, F.lit("parentheses don't match")))


# -- queries ---------------------------------------------------------------------------------

_BLOCKS = """b as (
  select doc_id, (i // 40 + 1)::int as page_no, i % 40 as block_no, length(t) < 40 as head, case when length(t) < 40 then 1 + length(t) % 3 else 9 end as level, t as text, length(t) // 3 + 1 as tokens
  from (select doc_id, unnest(range(0, len(l))) as i, unnest(l) as t from (select doc_id, string_split(text, chr(10)) as l from documents)) where t <> '')"""


@query(
    f"""with {_BLOCKS},
    m as (select *, not coalesce(head and lag(head) over w and lag(level) over w = level and not ends_with(lag(text) over w, ':')
        and not regexp_matches(text, '^[0-9IVXLC]+[.)]'), false) and (head or lag(head) over w is null) as starts
      from b window w as (partition by doc_id, page_no order by block_no)),
    n as (select *, sum(starts::int) over (partition by doc_id, page_no order by block_no) as grp from m),
    g as (select doc_id, page_no, grp, coalesce(string_agg(text, ' ' order by block_no) filter (where head), '') as title,
        coalesce(min(level) filter (where head), 0) as level, coalesce(list(text order by block_no) filter (where not head), []) as body, sum(tokens) as tokens
      from n group by all),
    s as (select *, title <> '' and tokens < 30 and lead(grp) over w is not null and lag(grp) over w is not null as small
      from g window w as (partition by doc_id, page_no order by grp)),
    r as (select *, sum((not small)::int) over (partition by doc_id, page_no order by grp) as run from s),
    k as (select *, not small or level < min(level) over (partition by doc_id, page_no, run order by grp rows between unbounded preceding and 1 preceding) as stays from r),
    q as (select *, sum(stays::int) over (partition by doc_id, page_no order by grp) as seq from k)
    select doc_id, page_no, seq::bigint as seq, min_by(title, grp) as title, min_by(level, grp)::int as level,
      md5(array_to_string(flatten(list(case when stays then body else list_prepend(title, body) end order by grp)), chr(10))) as body, sum(tokens)::bigint as tokens
    from q group by doc_id, page_no, seq"""
)
def page_heading_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks, forty a page; short ones are headings of three levels."""
    at = F.col("line_no") - 1
    rows = lines_of(load(spark, d, "documents")).where("line <> ''")
    short = F.length("line") < 40
    rows = rows.select(
        "doc_id", (F.floor(at / 40) + 1).cast("int").alias("page_no"), (at % 40).alias("block_no"), F.when(short, "heading").otherwise("text").alias("kind"),
        F.when(short, 1 + F.length("line") % 3).otherwise(9).alias("level"), F.col("line").alias("text"), (F.floor(F.length("line") / 3) + 1).alias("tokens"),
    )
    return heading_groups(rows).select("doc_id", "page_no", "seq", "title", "level", F.md5(F.array_join("body", "\n")).alias("body"), "tokens")
