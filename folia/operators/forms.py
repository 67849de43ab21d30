"""Regions of a form from its cells: header, record rows, total row, placeholders and footnotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load

# Words that begin a total row, and the shapes of footnotes and blanks to fill in, fixed values.
TOTAL = r"^(tong|tong cong|cong|tong so|total)\b"
NOTE_LINE = r"^\s*\[(\d+)\]\s*(.+)$"
NOTE_REF = r"\[(\d+)\]"
DOTS = r"\.{2,}|…"


def shown_cells(cells: DataFrame) -> DataFrame:
    """Cells with the text they show: that of the top left cell of their merged range.
    cells: form, row, col, text, bordered, top, left, bottom, right (the merged range; a plain cell is its own)."""
    own = F.coalesce(F.trim("text"), F.lit(""))
    corner = F.when((F.col("row") == F.col("top")) & (F.col("col") == F.col("left")), own)
    w = Window.partitionBy("form", "top", "left")
    return cells.withColumn("own", own).withColumn("shown", F.coalesce(F.max(corner).over(w), F.lit("")))


def _first_total(col: str):
    """Whether the first text of a row, by column, begins a total."""
    return F.coalesce(F.min_by(T.normalize(F.col(col)), F.when(F.col(col) != "", F.col("col"))).rlike(TOTAL), F.lit(False))


def form_regions(cells: DataFrame) -> DataFrame:
    """Form, title, header_top, header_bottom, first_col, last_col, data_rows, total_row, total_col.

    The header is the first row with two bordered cells of text or more, widened and lowered by the merged ranges it
    meets and by rows of text in every column; empty bordered rows below are records; a bordered row that begins with
    a total word ends them. Forms without a header are left out. cells hold every row of a form's used range.
    """
    shown = shown_cells(cells)
    named = (F.col("shown") != "") & F.col("bordered")
    rows = shown.where(named).groupBy("form", "row").agg(F.count(F.lit(1)).alias("n"), F.min("left").alias("first_col"), F.max("right").alias("last_col")).where("n >= 2")
    head = rows.groupBy("form").agg(F.min_by(F.struct(F.col("row").alias("header_top"), "first_col", "last_col"), "row").alias("h")).select("form", "h.*")
    # a row a form, so never broadcast; one join serves the title above the header as well
    placed = shown.join(head.hint("merge"), "form")
    inside = placed.where("(col between first_col and last_col and row >= header_top) or (row < header_top and own <> '')")
    width = F.col("last_col") - F.col("first_col") + 1
    totals = F.min(F.when(T.normalize(F.col("own")).rlike(TOTAL), F.col("col")))
    by = inside.groupBy("form", "header_top", "first_col", "last_col", "row").agg(
        (F.count_if(named) == F.first(width)).alias("full"),
        F.bool_or(F.col("top") == F.col("row")).alias("begins"),
        F.max("bottom").alias("reach"),
        F.bool_or("bordered").alias("framed"),
        F.bool_or(F.col("own") != "").alias("written"),
        _first_total("own").alias("total"),
        totals.alias("total_col"),
        F.min_by(T.collapse_space(F.col("own")), F.when((F.col("row") < F.col("header_top")) & (F.col("own") != ""), F.col("col"))).alias("title"),
    )
    form = Window.partitionBy("form")
    lowest = F.max(F.when(F.col("row") == F.col("header_top"), F.col("reach"))).over(form)
    below = by.withColumn("low", lowest).withColumn("end", F.max("row").over(form))
    grows = F.col("full") & F.col("begins") & ~F.col("total")
    stop = F.min(F.when((F.col("row") > F.col("low")) & ~grows, F.col("row"))).over(form)
    below = below.withColumn("header_bottom", F.coalesce(stop, F.col("end") + 1) - 1)
    record = F.col("framed") & ~F.col("written")
    last = F.min(F.when((F.col("row") > F.col("header_bottom")) & ~record, F.col("row"))).over(form)
    below = below.withColumn("stop", F.coalesce(last, F.col("end") + 1))
    at = F.col("framed") & F.col("total") & (F.col("row") == F.col("stop"))
    keys = ["form", "header_top", "header_bottom", "first_col", "last_col", "stop"]
    title = F.min_by("title", F.when(F.col("row") < F.col("header_top"), F.col("row"))).alias("title")
    out = below.groupBy(*keys).agg(F.max(F.when(at, F.col("row"))).alias("total_row"), F.max(F.when(at, F.col("total_col"))).alias("total_col"), title)
    return out.select("form", "title", "header_top", "header_bottom", "first_col", "last_col", (F.col("stop") - F.col("header_bottom") - 1).alias("data_rows"), "total_row", "total_col")


def form_placeholders_of(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Form, row, col, text, note: cells outside the table with a run of dots, and the footnotes they point to."""
    shown = shown_cells(cells).join(regions, "form")
    line = F.col("own").rlike(NOTE_LINE)
    note = shown.where(line & ~F.col("row").between(F.col("header_top"), F.col("header_bottom"))).select("form", F.regexp_extract("own", NOTE_LINE, 1).alias("ref"), T.collapse_space(F.regexp_extract("own", NOTE_LINE, 2)).alias("note"), "row", "col")
    notes = note.groupBy("form", "ref").agg(F.max_by("note", F.struct("row", "col")).alias("note"))
    end = F.coalesce("total_row", F.col("header_bottom") + F.col("data_rows"))
    table = F.col("row").between(F.col("header_top"), end) & F.col("col").between(F.col("first_col"), F.col("last_col"))
    blank = shown.where(~table & F.col("own").rlike(DOTS) & ~line).select("form", "row", "col", T.collapse_space(F.col("own")).alias("text"))
    refs = blank.select("form", "row", "col", F.posexplode(F.regexp_extract_all("text", F.lit(NOTE_REF), F.lit(1))).alias("at", "ref"))
    said = refs.join(notes, ["form", "ref"]).groupBy("form", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda r: r["note"]), "; ").alias("note"))
    return blank.join(said, ["form", "row", "col"], "left").withColumn("note", F.coalesce("note", F.lit("")))


def _customer_forms(spark: SparkSession, d: str) -> DataFrame:
    """A form a customer: a title, a header of three columns (every fifth has a second row), records by nation,
    a total for every other one, then a line of dots and its footnote."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("form"), (2 + F.col("c_custkey") % 3).alias("h"), (F.col("c_custkey") % 5 == 0).cast("long").alias("sub"), (F.col("c_nationkey") % 4).alias("n"), (F.col("c_custkey") % 2 == 0).alias("sums"), "c_name")
    b = F.col("h") + F.col("sub")
    rows = c.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), b + F.col("n") + 3)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    row, col, after = F.col("row"), F.col("col"), b + F.col("n") + 1
    head = F.concat(F.lit("column "), col.cast("string"))
    text = (
        F.when((row == 1) & (col == 1), F.concat(F.lit(" Form  of "), "c_name"))
        .when(row == F.col("h"), head)
        .when((row > F.col("h")) & (row <= b), F.concat(F.lit("unit "), col.cast("string")))
        .when((row == after) & F.col("sums") & (col == 2), "Tổng cộng")
        .when((row == after + 1) & (col == 1), "Signed by ..... [1]")
        .when((row == after + 2) & (col == 1), "[1] by  name")
        .otherwise("")
    )
    framed = (row >= F.col("h")) & ((row < after) | ((row == after) & F.col("sums")))
    return cells.select("form", "row", "col", text.alias("text"), framed.alias("bordered"), row.alias("top"), col.alias("left"), row.alias("bottom"), col.alias("right"))


_FORMS = "c as (select c_custkey as form, 2 + c_custkey % 3 as h, 2 + c_custkey % 3 + (c_custkey % 5 = 0)::int as b, c_nationkey % 4 as n, c_custkey % 2 = 0 as sums, c_name from customer)"


@query(f"with {_FORMS} select form, 'Form of ' || c_name as title, h as header_top, b as header_bottom, 1::bigint as first_col, 3::bigint as last_col, n as data_rows, case when sums then b + n + 1 end as total_row, case when sums then 2::bigint end as total_col from c")
def form_region_detection(spark: SparkSession, d: str) -> DataFrame:
    return form_regions(_customer_forms(spark, d))


@query(f"with {_FORMS} select form, b + n + 2 as row, 1::bigint as col, 'Signed by ..... [1]' as text, 'by name' as note from c")
def form_blanks(spark: SparkSession, d: str) -> DataFrame:
    cells = _customer_forms(spark, d)
    return form_placeholders_of(cells, form_regions(cells))
