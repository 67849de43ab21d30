"""The text layer of a page and a page's transcription: characters to words and rows, the merge with
OCR lines, and the way of transcribed text back to lines and regions.

Characters become words by windows over their page. What depends on the order of earlier decisions
(rows with a growing box, words that are used once, alignments) runs on a page's own arrays, in Arrow
batches without a shuffle. A page is the largest unit that is ever held in one place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import python_side as P
from ..registry import query
from ..session import load
from .layout import union

GOOD = 0.5  # highest cost of a pair of words that counts as agreement


def rows_type(texts: str, numbers: str = "") -> ArrayType:
    return ArrayType(StructType([StructField(c, StringType()) for c in texts.split()] + [StructField(c, DoubleType()) for c in numbers.split()]))


# -- characters, words, rows -------------------------------------------------------------------


def words_of_chars(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a page's characters: white space, another row or a gap wider than a character is high ends one.

    chars: keys, char_no, text, x0, y0, x1, y1; a run is summed in content order, so nothing is moved but to its page."""
    w = Window.partitionBy(*keys).orderBy("char_no")
    before = lambda c: F.lag(c).over(w)
    blank = F.col("text").rlike(r"^\s*$")
    high = F.greatest(before(F.col("y1") - F.col("y0")), F.col("y1") - F.col("y0"), F.lit(1.0))
    shared = F.least(before("y1"), F.col("y1")) - F.greatest(before("y0"), F.col("y0"))
    level = F.abs(before(F.col("y0") + F.col("y1")) - F.col("y0") - F.col("y1")) / 2 < high * 0.5
    gap = F.col("x0") - before("x1")
    first = before(blank).isNull() | before(blank) | ~((shared > 0) | level) | (F.abs(gap) > high)
    marked = chars.withColumn("_first", first & ~blank).where(~blank)
    runs = marked.withColumn("word_no", F.sum(F.col("_first").cast("int")).over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_no", "text"))), lambda c: c["text"]), "")
    return runs.groupBy(*keys, "word_no").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def box_of(w: dict) -> tuple[float, float, float, float]:
    return w["x0"], w["y0"], w["x1"], w["y1"]


def boxed(text: str, box: tuple, **more) -> dict:
    return more | {"text": text} | dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True))


def rows_of(words: list[dict]) -> list[dict]:
    """Rows from top to bottom by centres: a word joins the last row when they share three tenths of the lower height."""
    rows: list[list[dict]] = []
    around = None
    for w in sorted(words, key=lambda w: w["y0"] + w["y1"]):
        b = box_of(w)
        if rows and min(around[3], b[3]) - max(around[1], b[1]) > 0.3 * min(around[3] - around[1], b[3] - b[1]):
            rows[-1].append(w)
            around = union((around, b))
        else:
            rows.append([w])
            around = b
    return [boxed(" ".join(w["text"] for w in sorted(r, key=lambda w: w["x0"])), union(map(box_of, r))) for r in rows]


@F.pandas_udf(rows_type("text", "x0 y0 x1 y1"))
def text_rows(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: rows_of([] if ws is None else list(ws)))


def pages_from_layer(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs of a page that has only its text layer: a gap of over one and a half rows starts one. pages: keys, words."""
    w = Window.partitionBy(*keys).orderBy("_row")
    rows = pages.select(*keys, F.posexplode(text_rows("words")).alias("_row", "r")).select(*keys, "_row", "r.*")
    last, high = F.lag("y1").over(w), F.greatest(F.lag(F.col("y1") - F.col("y0")).over(w), F.lit(1.0))
    starts = F.coalesce((F.col("y0") - last > 1.5 * high).cast("int"), F.lit(0))
    blocks = rows.withColumn("_s", starts).withColumn("block_no", F.sum("_s").over(w).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "text"))), lambda r: r["text"]), "\n")
    return blocks.groupBy(*keys, "block_no").agg(F.count(F.lit(1)).alias("lines"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


# -- merge with OCR -----------------------------------------------------------------------------


def merge_layer(lines: list[dict], words: list[dict], least: float = 0.6, grow: float = 0.15) -> list[dict]:
    """Each line, in order, takes the layer's free words in its grown box. A text alike enough is
    replaced; else the line stays and its words remain free. What no line took becomes lines of its own."""
    free = dict(enumerate(words))
    out = []
    for x in lines:
        x0, y0, x1, y1 = box_of(x)
        by = grow * (y1 - y0)
        inside = [i for i, w in free.items() if x0 - by <= (w["x0"] + w["x1"]) / 2 <= x1 + by and y0 - by <= (w["y0"] + w["y1"]) / 2 <= y1 + by]
        said = " ".join(free[i]["text"] for i in inside)
        plain = lambda s: " ".join(P.fold(s).split())
        if inside and P.alike(plain(said), plain(x["text"])) >= least:
            for i in inside:
                del free[i]
            changed = said != x["text"]
            out.append(boxed(said, box_of(x), ocr=x["text"] if changed else None, layer=None, source="layer" if changed else "ocr"))
        else:
            out.append(boxed(x["text"], box_of(x), ocr=None, layer=said or None, source="ocr"))
    return out + [r | {"ocr": None, "layer": None, "source": "layer_only"} for r in rows_of(list(free.values()))]


@F.pandas_udf(rows_type("text ocr layer source", "x0 y0 x1 y1"))
def merged_lines(lines: pd.Series, words: pd.Series) -> pd.Series:
    some = lambda v: [] if v is None else list(v)
    return pd.Series([merge_layer(some(a), some(b)) for a, b in zip(lines, words, strict=True)], dtype=object)


# -- transcriptions -----------------------------------------------------------------------------


def place(lines: list[dict], text: str) -> list[dict]:
    """Gives each OCR line the span of the transcription its words agree with. A line without agreement
    keeps its text, unless OCR doubts it itself. A block too long to align stays as it is."""
    said, owner, words = P.words_at(text), [], []
    for i, x in enumerate(lines):
        for _, _, key in P.words_at(x["text"]):
            words.append(key)
            owner.append(i)
    pairs = P.align(words, [key for _, _, key in said]) or []
    agreed = {owner[i] for i, _, c in pairs if c <= GOOD}
    spans: dict[int, list[int]] = {}
    for i, j, _ in pairs:
        if owner[i] in agreed or lines[owner[i]]["doubtful"]:
            spans.setdefault(owner[i], []).extend(said[j][:2])
    return [{"text": text[min(spans[i]) : max(spans[i])], "ocr": x["text"], "source": "vlm"} if i in spans else {"text": x["text"], "ocr": None, "source": "ocr"} for i, x in enumerate(lines)]


@F.pandas_udf(rows_type("text ocr source"))
def placed_lines(lines: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([place([] if a is None else list(a), b or "") for a, b in zip(lines, text, strict=True)], dtype=object)


def distribute(regions: list[str], segments: list[str]) -> list[int | None]:
    """The region of each transcribed segment, by votes of agreeing words; ties to the earlier region.
    A segment without a vote has none and becomes a region of its own."""
    cut = lambda texts: [(key, i) for i, t in enumerate(texts) for _, _, key in P.words_at(t or "")]
    ocr, said = cut(regions), cut(segments)
    votes: list[dict[int, int]] = [{} for _ in segments]
    for i, j, c in P.align([k for k, _ in ocr], [k for k, _ in said]) or []:
        if c <= GOOD:
            v = votes[said[j][1]]
            v[ocr[i][1]] = v.get(ocr[i][1], 0) + 1
    return [min(v, key=lambda r: (-v[r], r)) if v else None for v in votes]


@F.pandas_udf(ArrayType(IntegerType()))
def segment_regions(regions: pd.Series, segments: pd.Series) -> pd.Series:
    return pd.Series([distribute(list(a), list(b)) for a, b in zip(regions, segments, strict=True)], dtype=object)


# -- queries ------------------------------------------------------------------------------------

PAGE = ["conv_id", "turn"]
# Rows of eight words of every turn; k counts rows, j the words in one.
_WORDS = "w as (select conv_id, turn, unnest(range(0, len(x)))::int as n, unnest(x) as word from (select conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') as x from conversations)), r as (select conv_id, turn, n // 8 as k, string_agg(word, ' ' order by n) as line, count(*) as words from w group by 1, 2, 3)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "conversations").select(*PAGE, F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("w"))
    return t.select(*PAGE, F.posexplode("w").alias("n", "word")).withColumn("k", F.floor(F.col("n") / 8).cast("int"))


def _in_order(order: str, *columns: Column | str) -> Column:
    """The group's rows as an array of structs, by a number."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_v"))))
    return F.transform(rows, lambda r: r["_v"])


def _line(rows: Column, name: str = "word") -> Column:
    return F.array_join(F.transform(rows, lambda r: r[name]), " ")


def _rows(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE, "k").agg(_line(_in_order("n", "word")).alias("line"), F.count(F.lit(1)).alias("words"))


def _sql_box(x0: str, y0: str, x1: str, y1: str) -> list[Column]:
    return [F.expr(e).cast("double").alias(n) for n, e in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))]


@query("with c as (select conv_id, turn, unnest(range(0, (length(text) + 59) // 60)) as l, text from conversations), p as (select conv_id, turn, l, unnest(regexp_extract_all(substring(text, (l * 60 + 1)::int, 60), '\\S+')) as word, generate_subscripts(regexp_extract_all(substring(text, (l * 60 + 1)::int, 60), '\\S+'), 1) as i from c) select conv_id, turn, (row_number() over (partition by conv_id, turn order by l, i) - 1)::bigint as word_no, word as text from p")
def layer_words(spark: SparkSession, d: str) -> DataFrame:
    """Characters set in rows of sixty; a word ends at white space and with its row."""
    c = load(spark, d, "conversations").select(*PAGE, F.posexplode(F.split("text", "")).alias("char_no", "text")).where("text <> ''")
    placed = c.select(*PAGE, "char_no", "text", *_sql_box("char_no % 60 * 6", "floor(char_no / 60) * 20", "char_no % 60 * 6 + 5", "floor(char_no / 60) * 20 + 10"))
    return words_of_chars(placed, PAGE).select(*PAGE, F.col("word_no").cast("bigint").alias("word_no"), "text")


@query(f"with {_WORDS} select conv_id, turn, (k // 5)::int as block_no, count(*) as lines, string_agg(line, chr(10) order by k) as text from r group by 1, 2, 3")
def layer_only_pages(spark: SparkSession, d: str) -> DataFrame:
    """Words in no order, a little off their row's height; a wide gap after every fifth row."""
    w = _words(spark, d).withColumn("j", F.col("n") % 8).withColumn("o", F.md5(F.concat("word", F.col("n").cast("string"))))
    box = _sql_box("j * 100", "k * 20 + floor(k / 5) * 40 + j % 3", "j * 100 + 90", "k * 20 + floor(k / 5) * 40 + j % 3 + 10")
    pages = w.groupBy(*PAGE).agg(_in_order("o", F.col("word").alias("text"), *box).alias("words"))
    return pages_from_layer(pages, PAGE).select(*PAGE, "block_no", "lines", "text")


_OCR = "case when k % 3 = 2 then 'zzzz' else replace(line, 'e', 'c') end"


@query(f"with {_WORDS}, o as (select *, {_OCR} as ocr from r), s as (select *, 1 - levenshtein(line, ocr) / greatest(length(line), length(ocr)) >= 0.6 as same from o), m as (select conv_id, turn, 0 as part, k, case when same then line else ocr end as text, case when same and line <> ocr then ocr end as ocr, case when not same then line end as layer, case when same and line <> ocr then 'layer' else 'ocr' end as source from s union all select conv_id, turn, 1, k, line, null, null, 'layer_only' from s where not same) select conv_id, turn, (row_number() over (partition by conv_id, turn order by part, k) - 1)::int as line_no, text, ocr, layer, source from m")
def layer_merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """OCR lines with misread letters, every third one unreadable, beside the layer's words."""
    words = _words(spark, d)
    layer = words.groupBy(*PAGE).agg(_in_order("n", F.col("word").alias("text"), *_sql_box("n % 8 * 100", "k * 20", "n % 8 * 100 + 90", "k * 20 + 10")).alias("words"))
    lines = _rows(words).groupBy(*PAGE).agg(_in_order("k", F.expr(_OCR).alias("text"), *_sql_box("0", "k * 20", "790", "k * 20 + 10")).alias("lines"))
    return layer.join(lines, PAGE).select(*PAGE, F.posexplode(merged_lines("lines", "words")).alias("line_no", "m")).select(*PAGE, "line_no", "m.text", "m.ocr", "m.layer", "m.source")


@query(f"with {_WORDS}, o as (select *, k % 3 = 1 as lost, k % 6 = 1 as doubtful, rtrim(repeat('ωω ', words::int)) as noise from r) select conv_id, turn, k::int as line_no, case when lost and not doubtful then noise else line end as text, case when lost and not doubtful then 'ocr' else 'vlm' end as source from o")
def transcribed_lines(spark: SparkSession, d: str) -> DataFrame:
    """A transcription placed on OCR lines, of which every third one can't be read and every sixth is doubtful."""
    ocr = F.when(F.col("k") % 3 == 1, F.rtrim(F.repeat(F.lit("ωω "), F.col("words").cast("int")))).otherwise(F.col("line"))
    blocks = _rows(_words(spark, d)).groupBy(*PAGE).agg(_in_order("k", ocr.alias("text"), (F.col("k") % 6 == 1).alias("doubtful")).alias("lines"), F.array_join(F.transform(_in_order("k", "line"), lambda r: r["line"]), "\n").alias("text"))
    return blocks.select(*PAGE, F.posexplode(placed_lines("lines", "text")).alias("line_no", "l")).select(*PAGE, "line_no", "l.text", "l.source")


@query("with t as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as region, len(regexp_extract_all(lower(text), '[a-z]+')) as words from conversations), n as (select conv_id, sum(words) as words, count(*) as regions from t group by 1), s as (select conv_id, region // 2 as segment, arg_max(region, words * 1000000 - region) filter (where words > 0) as region from t group by 1, 2 union all select conv_id, (regions + 1) // 2, null from n) select conv_id, segment::int as segment, case when words * (words + 2) <= 4000000 then region end as region from s join n using (conv_id)")
def transcribed_regions(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns as regions; each segment covers two of them, and the last one none."""
    t = load(spark, d, "conversations").select(*PAGE, F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), " ").alias("said"))
    pages = t.groupBy("conv_id").agg(F.transform(_in_order("turn", "said"), lambda r: r["said"]).alias("regions"))
    pair = lambda i: F.array_join(F.slice("regions", i * 2 + 1, F.lit(2)), " ")
    some = F.ceil(F.size("regions") / 2).cast("int")
    segments = F.array_append(F.transform(F.sequence(F.lit(0), some - 1), pair), F.lit("ωω ωω"))
    return pages.select("conv_id", F.posexplode(segment_regions("regions", segments)).alias("segment", "region"))
