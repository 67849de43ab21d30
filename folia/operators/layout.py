"""Page assembly: OCR lines and regions to ordered blocks and Markdown.

Pages are small and independent, and their order rules are not transitive. A page is one row with its
lines and regions in arrays, so it is built where it lies, in Arrow batches without a shuffle.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load
from ..sources.readers import ocr_pages, table_markdown

# Region classes of the layout engine by the block kind they give; a caller may give others.
KINDS = {
    "title": "doc_title title",
    "heading": "paragraph_title heading",
    "paragraph": "text paragraph abstract content reference aside_text algorithm",
    "list": "list",
    "table": "table",
    "formula": "formula formula_number equation",
    "figure": "figure image chart seal header_image footer_image",
    "caption": "caption figure_title table_title chart_title",
    "header": "header",
    "footer": "footer",
    "page_number": "number page_number",
    "footnote": "footnote",
}
CLASSES = {c: kind for kind, names in KINDS.items() for c in names.split()}
FURNITURE = ("header", "footer", "page_number")
BLOCKS = "doc_id long, page_no int, block_no int, kind string, x0 double, y0 double, x1 double, y1 double, line_from int, line_to int, text string, md_start int, md_end int"


def box(quad) -> tuple[float, float, float, float]:
    xs, ys = [float(p[0]) for p in quad], [float(p[1]) for p in quad]
    return min(xs), min(ys), max(xs), max(ys)


def union(boxes) -> tuple[float, float, float, float]:
    """Around all boxes; unset ones (all zero) don't count."""
    real = [b for b in boxes if any(b)]
    return (min(b[0] for b in real), min(b[1] for b in real), max(b[2] for b in real), max(b[3] for b in real)) if real else (0.0, 0.0, 0.0, 0.0)


def reading_ranks(lines: list[dict], order: list[int]) -> list[int]:
    """Lines in the engine's order first, the others by rows from top to bottom, left to right in a row."""
    at = {line["id"]: i for i, line in enumerate(lines)}
    listed = list(dict.fromkeys(at[i] for i in order if i in at))

    def earlier(a: int, b: int) -> int:
        p, q = lines[a]["box"], lines[b]["box"]
        if abs(p[1] - q[1]) > min(p[3] - p[1], q[3] - q[1]) / 2:
            return -1 if p[1] < q[1] else 1
        return (p[0] > q[0]) - (p[0] < q[0])

    known = set(listed)
    rest = sorted((i for i in range(len(lines)) if i not in known), key=functools.cmp_to_key(earlier))
    ranks = [0] * len(lines)
    for r, i in enumerate([*listed, *rest]):
        ranks[i] = r
    return ranks


def overlap(a, b) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0]))


def above(a, b) -> bool:
    """a ends above b's start and shares three tenths of the narrower one's width."""
    narrow = min(a[2] - a[0], b[2] - b[0])
    return a[3] <= b[1] + 0.2 * min(a[3] - a[1], b[3] - b[1]) and narrow > 0 and overlap(a, b) >= 0.3 * narrow


def assemble(lines: list[dict], regions: list[dict], order: list[int], classes: dict[str, str] = CLASSES) -> list[dict]:
    """Blocks in reading order with their lines. lines: id, text, quad, layout_id; regions: id, class, quad, html, latex."""
    lines = [x | {"box": box(x["quad"])} for x in lines]
    rank = reading_ranks(lines, order)
    blocks = [{"id": r["id"], "kind": classes.get(r["class"].strip().lower(), "unknown"), "box": box(r["quad"]), "html": r.get("html"), "latex": r.get("latex"), "lines": []} for r in regions]
    by_id = {b["id"]: b for b in blocks}
    orphans = []
    for i, x in enumerate(lines):
        own = by_id.get(x.get("layout_id"))
        if own is None:  # the smallest region around the line's centre
            cx, cy = (x["box"][0] + x["box"][2]) / 2, (x["box"][1] + x["box"][3]) / 2
            around = [b for b in blocks if b["box"][0] <= cx <= b["box"][2] and b["box"][1] <= cy <= b["box"][3]]
            own = min(around, key=lambda b: (b["box"][2] - b["box"][0]) * (b["box"][3] - b["box"][1]), default=None)
        if own is None:
            orphans.append(i)
        else:
            own["lines"].append(i)
    orphans.sort(key=rank.__getitem__)
    for k, i in enumerate(orphans):  # neighbours in reading order become a paragraph
        if k and rank[i] == rank[orphans[k - 1]] + 1:
            blocks[-1]["lines"].append(i)
        else:
            blocks.append({"id": -1, "kind": "paragraph", "box": None, "html": None, "latex": None, "lines": [i]})
    for b in blocks:
        b["lines"].sort(key=rank.__getitem__)
        b["box"] = b["box"] or union(lines[i]["box"] for i in b["lines"])
    placed = [b for b in blocks if b["lines"]]
    for b in placed:
        b["at"] = float(rank[b["lines"][0]])
    last = max((b["at"] for b in placed), default=-1.0)
    for b in blocks:
        if not b["lines"]:  # before the first block below it in its column, else at the end by height
            below = [o["at"] - 0.5 for o in placed if o["box"][1] >= b["box"][1] and overlap(o["box"], b["box"]) > 0]
            b["at"] = min([*below, last + 1 + b["box"][1] / 1e6])
    blocks.sort(key=lambda b: b["at"])
    for _ in range(len(blocks)):  # a block that lies above an earlier one goes before it
        moved = False
        for i in range(1, len(blocks)):
            j = next((j for j in range(i) if above(blocks[i]["box"], blocks[j]["box"]) and not above(blocks[j]["box"], blocks[i]["box"])), None)
            if j is not None:
                blocks.insert(j, blocks.pop(i))
                moved = True
        if not moved:
            break
    for b in blocks:
        b["texts"] = [lines[i]["text"] for i in b["lines"]]
    return blocks


def block_markdown(b: dict) -> str:
    body = " ".join(t.strip() for t in b["texts"] if t.strip())
    kind = b["kind"]
    if kind == "table" and b.get("html"):
        return table_markdown(b["html"])
    if kind == "formula":
        return f"$$\n{b['latex']}\n$$" if b.get("latex") else body
    if kind == "title":
        return f"# {body}" if body else ""
    if kind == "heading":
        return f"{'#' * heading_depth(body)} {body}" if body else ""
    if kind == "list":
        return "\n".join(t if t.lstrip().startswith(("-", "*")) else f"- {t.strip()}" for t in b["texts"] if t.strip())
    return "![figure]()" if kind == "figure" and not body else body


def heading_depth(title: str) -> int:
    """Two, and one more for every further part of a number like 1.2.3."""
    number = title.split(" ", 1)[0].rstrip(".")
    parts = number.split(".")
    return min(6, 1 + len(parts)) if all(p.isdigit() for p in parts) else 2


def render(blocks: list[dict]) -> list[dict]:
    """Numbers blocks and lines and gives each block its offsets in the page's Markdown; furniture has none."""
    out, at, line = [], 0, 1
    for n, b in enumerate(blocks):
        md = "" if b["kind"] in FURNITURE else block_markdown(b)
        start = at + (2 if at and md else 0)
        end = start + len(md) if md else start
        out.append(b | {"block_no": n, "line_from": line if b["lines"] else None, "line_to": line + len(b["lines"]) - 1 if b["lines"] else None, "text": md or " ".join(b["texts"]), "md_start": start if md else None, "md_end": end if md else None})
        line += len(b["lines"])
        at = end if md else at
    return out


def pages(ocr: DataFrame, classes: dict[str, str] = CLASSES) -> DataFrame:
    """Blocks of every page. ocr: doc_id, page_no, lines, regions, reading_order, as the OCR source gives them."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples(index=False):
            made = assemble([dict(x) for x in r.lines], [dict(x) for x in r.regions], list(r.reading_order if r.reading_order is not None else []), classes)
            rows += [(r.doc_id, r.page_no, b["block_no"], b["kind"], *map(float, b["box"]), b["line_from"], b["line_to"], b["text"], b["md_start"], b["md_end"]) for b in render(made)]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("line_from", "line_to", "md_start", "md_end")})

    plain = ocr.select("doc_id", "page_no", F.transform("lines", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["quad"].alias("quad"), x["layout_id"].alias("layout_id"))).alias("lines"), F.transform("regions", lambda x: F.struct(x["id"].alias("id"), x["class"].alias("class"), x["quad"].alias("quad"), x["html"].alias("html"), x["latex"].alias("latex"))).alias("regions"), "reading_order")
    return plain.mapInPandas(lambda batches: map(build, batches), BLOCKS)


def flag_furniture(blocks: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Blocks whose key is on at least max(2, ratio * pages) pages of their document."""
    key = T.furniture_key(F.col("text"))
    keyed = blocks.withColumn("_k", key)
    n = blocks.groupBy("doc_id").agg(F.count_distinct("page_no").alias("_pages"))
    often = keyed.where("_k <> ''").groupBy("doc_id", "_k").agg(F.count_distinct("page_no").alias("_on")).join(n, "doc_id").where(F.col("_on") >= F.greatest(F.lit(2), F.ceil(F.lit(ratio) * F.col("_pages")))).select("doc_id", "_k", F.lit(True).alias("_f"))
    return keyed.join(often, ["doc_id", "_k"], "left").withColumn("furniture", F.coalesce("_f", F.lit(False)) | F.col("kind").isin(*FURNITURE)).drop("_k", "_f")


# -- texts and cards -------------------------------------------------------------------------


def layer_quality(layer_words: DataFrame, ocr_words: DataFrame, key: list[str]) -> DataFrame:
    """Share of the OCR's word multiset that the layer holds. Both: key..., word."""
    a = layer_words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    b = ocr_words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("m"))
    return b.join(a, [*key, "word"], "left").groupBy(*key).agg((F.sum(F.least("m", F.coalesce("n", F.lit(0)))) / F.sum("m")).alias("overlap"))


def choose_text(blocks: DataFrame) -> DataFrame:
    """A block's text: transcription, then a trusted text layer, then OCR. Columns vlm, layer, layer_score, ocr."""
    said = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return blocks.withColumn("text", F.coalesce(said("vlm"), F.when(F.col("layer_score") >= 0.6, said("layer")), said("ocr"), said("layer")))


def document_cards(docs: DataFrame, blocks: DataFrame, words: int = 40) -> DataFrame:
    """A title and summary for each document: given ones, else the first title block, else the first words."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "block_no")
    first = blocks.where(~F.col("kind").isin(*FURNITURE)).withColumn("_t", F.first(F.when(F.col("kind").isin("title", "heading"), F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "_t", F.col("text").alias("_b"))
    out = docs.join(first, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), T.strip_md(F.col("_t")), F.concat(F.lit("document "), F.col("doc_id").cast("string"))).alias("title"), F.coalesce(F.nullif(F.trim("summary"), F.lit("")), T.first_words(T.strip_md(F.col("_b")), words), F.lit("")).alias("summary"))


# -- queries ---------------------------------------------------------------------------------------


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """An OCR reply for every order: its lines in no order, some on one row; the first three lie in a text region, the next ones in none,
    a table without lines follows, and the page's number."""
    line = F.format_string('{"id":%d,"text":"item %d","confidence":0.9,"bounding_box":[[%s,%d],[90,%d]]}', F.col("l_linenumber"), F.col("l_partkey"), (F.lit(10) + F.col("l_partkey") / 1000000).cast("decimal(12,6)").cast("string"), F.col("l_linenumber") * 10 + 20, F.col("l_linenumber") * 10 + 28)
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("lines"))
    body = F.format_string(
        '{"results":[{"id":90,"text":"%d","confidence":0.9,"bounding_box":[[40,200],[60,208]],"layout_id":4},%s,{"id":91,"text":"Order %d","confidence":0.9,"bounding_box":[[10,5],[90,15]],"layout_id":1}],'
        '"layout":[{"id":4,"class":"number","confidence":1,"bounding_box":[[30,195],[70,210]]},{"id":3,"class":"table","confidence":1,"bounding_box":[[5,110],[95,130]]},{"id":2,"class":"text","confidence":1,"bounding_box":[[5,28],[95,59]]},{"id":1,"class":"doc_title","confidence":1,"bounding_box":[[5,2],[95,18]]}],'
        '"reading_order":[91],"tables":[{"layout_id":3,"html":"<table><tr><td>a</td><td>b</td></tr></table>"}],"formulas":[]}',
        F.col("l_orderkey"), "lines", F.col("l_orderkey"),
    )
    return ocr_pages(lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), body.alias("body")))


_ASSEMBLED = "l as (select l_orderkey as doc_id, l_linenumber as n, l_partkey as p, 'item ' || l_partkey as t from lineitem), b as (select doc_id, 0 as o, 'title' as kind, '# Order ' || doc_id as text, 1 as lines from (select distinct doc_id from l) union all select doc_id, 1, 'paragraph', coalesce(string_agg(t, ' ' order by n, p) filter (where n <= 3), ''), count(*) filter (where n <= 3) from l group by 1 union all select doc_id, 2, 'paragraph', string_agg(t, ' ' order by n, p), count(*) from l where n > 3 group by 1 union all select doc_id, 3, 'table', '| a | b |' || chr(10) || '| --- | --- |', 0 from (select distinct doc_id from l) union all select doc_id, 4, 'page_number', doc_id::varchar, 1 from (select distinct doc_id from l))"


@query(f"with {_ASSEMBLED}, f as (select *, sum(lines) over (partition by doc_id order by o) as upto, sum(case when kind <> 'page_number' and text <> '' then length(text) + 2 end) over (partition by doc_id order by o) as md from b) select doc_id, (row_number() over (partition by doc_id order by o) - 1)::int as block_no, kind, text, case when lines > 0 then (upto - lines + 1)::int end as line_from, case when lines > 0 then upto::int end as line_to, case when kind <> 'page_number' and text <> '' then (md - 2 - length(text))::int end as md_start, case when kind <> 'page_number' and text <> '' then (md - 2)::int end as md_end from f")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in reading order, with their lines and their place in the page's Markdown."""
    return pages(_replies(spark, d)).select("doc_id", "block_no", "kind", "text", "line_from", "line_to", "md_start", "md_end")


@query("with k as (select conv_id, turn, role || ' ' || (turn % 3) as text from conversations), n as (select conv_id, count(distinct turn) as pages from conversations group by 1), o as (select conv_id, regexp_replace(text, '\\d+', '#', 'g') as key, count(distinct turn) as on_pages from k group by 1, 2) select k.conv_id, turn, on_pages >= greatest(2, ceil(0.6 * pages)) as furniture from k join o on o.conv_id = k.conv_id and o.key = regexp_replace(k.text, '\\d+', '#', 'g') join n on n.conv_id = k.conv_id")
def furniture_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Who speaks, as a running head with a number, flagged where most pages of a conversation hold it."""
    head = F.concat("role", F.lit(" "), (F.col("turn") % 3).cast("string"))
    b = load(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.lit("paragraph").alias("kind"), head.alias("text"))
    return flag_furniture(b).select(F.col("doc_id").alias("conv_id"), F.col("page_no").alias("turn"), "furniture")


@query("select event_id, case event_type when 'view' then 'seen ' || event_id when 'click' then 'layer' else case when event_id % 2 = 0 then 'read' else 'layer' end end as text from events")
def chosen_texts(spark: SparkSession, d: str) -> DataFrame:
    """A transcription first, then a trusted layer, then OCR, then any layer."""
    e = load(spark, d, "events")
    vlm = F.when(F.col("event_type") == "view", F.concat(F.lit("seen "), F.col("event_id").cast("string"))).otherwise(F.lit(" "))
    rows = e.select("event_id", vlm.alias("vlm"), F.lit("layer").alias("layer"), F.when(F.col("event_type") == "click", 0.6).otherwise(0.59).alias("layer_score"), F.when(F.col("event_id") % 2 == 0, F.lit("read")).otherwise(F.lit("")).alias("ocr"))
    return choose_text(rows).select("event_id", "text")
