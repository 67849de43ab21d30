"""Trees from bookmarks, spans and page headings; places of citations and texts; cards and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load
from .documents import LINES, lines_of
from .layout import document_cards
from .trees import tree

# Order of what begins on a page: spans by type, bookmarks, text before the page's first heading, headings.
RANKS = {"doctype": 0, "bookmark": 1, "lead": 2, "layout": 3}


def outline(marks: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, origin, page_start, tokens: the nodes of a tree, for tree().

    marks: doc_id, page_no, origin (a key of RANKS), ord, level, title, tokens. A span is a first level and closes
    all before it; bookmarks stand below it by their depth; headings of pages stand below the last bookmark of
    the span. Text before a heading counts for the node before it, or makes a node of its own where there is none. A
    heading that repeats a bookmark of its page is that bookmark. Windows over the marks of a document, one shuffle.
    """
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("origin")]
    doc = Window.partitionBy("doc_id")
    by = doc.orderBy("page_no", "rank", "ord")
    rows = marks.withColumn("rank", rank).withColumn("off", F.max((F.col("rank") == 0).cast("int")).over(doc)).withColumn("span", F.count_if(F.col("rank") == 0).over(by))
    own = F.when(F.col("rank") == 0, 1).when(F.col("rank") == 1, F.col("level") + F.col("off"))
    inside = Window.partitionBy("doc_id", "span").orderBy("page_no", "rank", "ord").rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.last(F.when(F.col("rank") == 1, F.col("own")), ignorenulls=True).over(inside), F.col("off"))
    rows = rows.withColumn("own", own).withColumn("base", base)
    rows = rows.withColumn("at", F.coalesce("own", F.when(F.col("rank") == 2, F.col("base") + 1).otherwise(F.col("base") + F.col("level"))))
    key = T.normalize(F.col("title"))
    twin = F.max((F.col("rank") == 1).cast("int")).over(Window.partitionBy("doc_id", "page_no", key)) == 1
    repeats = (F.col("rank") == 3) & twin
    rows = rows.withColumn("key", key).withColumn("repeats", repeats)
    # a node of its own; text before any heading only where nothing has begun
    some = F.coalesce(F.max(F.when(F.col("rank") != 2, ~F.col("repeats"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    first_lead = F.row_number().over(Window.partitionBy("doc_id", F.col("rank") == 2).orderBy("page_no", "rank", "ord")) == 1
    rows = rows.withColumn("starts", F.when(F.col("rank") == 2, first_lead & ~some).otherwise(~F.col("repeats")))
    rows = rows.withColumn("node", F.sum(F.col("starts").cast("int")).over(by))
    home = F.first(F.when(F.col("rank") == 1, F.col("node")), ignorenulls=True).over(Window.partitionBy("doc_id", "page_no", "key").orderBy("rank", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("node", F.when(F.col("repeats"), home).otherwise(F.col("node")))
    head = F.min_by(F.struct("at", "title", F.when(F.col("rank") == 2, "layout").otherwise(F.col("origin")).alias("origin"), "page_no"), F.struct("page_no", "rank", "ord"))
    out = rows.groupBy("doc_id", "node").agg(head.alias("h"), F.sum("tokens").alias("tokens"))
    return out.select("doc_id", F.col("node").cast("int").alias("ord"), F.col("h.at").cast("int").alias("level"), "h.title", "h.origin", F.col("h.page_no").alias("page_start"), "tokens")


def to_points(rows: DataFrame, dpi: str = "dpi") -> DataFrame:
    """Boxes in points beside those in pixels; 0 where a page's resolution is unknown."""
    by = F.coalesce(F.when(F.col(dpi) > 0, 72 / F.col(dpi)), F.lit(0.0))
    return rows.select("*", *[(F.col(c) * by).alias(f"{c}_pt") for c in ("x0", "y0", "x1", "y1")])


def locate_citations(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines a citation names; a citation that is none, or names no line, gives no row.
    citations: cite; lines: doc_id, page_no, line_no, text, x0, y0, x1, y1, dpi."""
    parsed = citations.select("cite", T.parse_citation(F.col("cite")).alias("c")).where("c is not null")
    wanted = parsed.select("cite", F.col("c.doc").alias("_doc"), F.col("c.page").alias("page_no"), F.explode(F.sequence("c.first", F.greatest("c.first", "c.last"))).alias("line_no"))
    met = lines.withColumn("_doc", F.col("doc_id").cast("string")).join(wanted, ["_doc", "page_no", "line_no"]).drop("_doc")
    return to_points(met)


def locate_text(wanted: DataFrame, lines: DataFrame, fuzzy: Column | None = None) -> DataFrame:
    """The lines that contain a text, folded; with `fuzzy` (a condition on `wanted` and `line` texts) those that pass
    it as well. wanted: doc_id, page_no (null: any), wanted."""
    pages = F.col("w.page_no").isNull() | (F.col("w.page_no") == F.col("l.page_no"))
    met = lines.alias("l").join(wanted.alias("w"), (F.col("l.doc_id") == F.col("w.doc_id")) & pages)
    near = T.contains_fold(F.col("l.text"), F.col("w.wanted"))
    return to_points(met.where((F.trim("w.wanted") != "") & (near if fuzzy is None else near | fuzzy)).select("l.*", "w.wanted"))


def first_line(markdown: Column) -> Column:
    """The first line with words, without marks; images are passed over."""
    bare = F.transform(F.split(markdown, "\n"), lambda t: T.collapse_space(F.regexp_replace(F.regexp_replace(t, r"[#*]|---|> ", ""), r"\|", " ")))
    return F.coalesce(F.try_element_at(F.filter(bare, lambda t: (t != "") & ~F.startswith(t, F.lit("!["))), F.lit(1)), F.lit(""))


def joined_summary(parts: Column, words: int) -> Column:
    """The summaries of continued pages in one, joined by "; ", until twice `words` words are held."""
    held = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))

    def join(acc: Column, part: Column) -> Column:
        return F.when(F.trim(part) == "", acc).when(F.trim(acc) == "", part).when(held(acc) >= 2 * words, acc).otherwise(T.first_words(F.concat(acc, F.lit("; "), part), 2 * words))

    return F.aggregate(parts, F.lit(""), join)


def plain_number(number: Column) -> Column:
    """A double's shortest digits without an exponent, and without a point where it is whole."""

    def placed(s: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(s, r"([\d.]+)E", 1), r"\.0$|\.", "")
        power = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
        body = (
            F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .when(F.length(digits) > power + 1, F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
            .otherwise(F.rpad(digits, power + 1, "0"))
        )
        return F.when(power.isNull(), F.regexp_replace(s, r"\.0$", "")).otherwise(F.concat(F.regexp_extract(s, "^-?", 0), body))

    return T.let(number.cast("string"), placed)


def value_text(value: Column) -> Column:
    """A JSON scalar as a user reads it: text as it is, whole numbers without a point, else its JSON form; null for null."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    number = plain_number(F.try_variant_get(v, "$", "double"))
    return F.when(kind == "VOID", F.lit(None).cast("string")).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), number).otherwise(value)


# -- queries ---------------------------------------------------------------------------------


def _marks(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("line_no") - 1
    lines = lines_of(load(spark, d, "documents")).where("line <> ''").withColumn("page_no", (F.floor(at / 8) + 1).cast("int")).withColumn("tok", F.floor(F.length("line") / 3) + 1)
    head = F.length("line") < 40
    before = F.coalesce(F.max(head.cast("int")).over(Window.partitionBy("doc_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    lines = lines.withColumn("head", head).withColumn("lead", ~head & ~before)
    nodes = lines.where("head").select("doc_id", "page_no", F.lit("layout").alias("origin"), F.col("line_no").alias("ord"), (1 + F.length("line") % 2).alias("level"), F.col("line").alias("title"), F.col("tok").alias("tokens"))
    lead = lines.where("lead").groupBy("doc_id", "page_no").agg(F.sum("tok").alias("tokens"))
    lead = lead.select("doc_id", "page_no", F.lit("lead").alias("origin"), F.lit(0).alias("ord"), F.lit(1).alias("level"), F.concat(F.lit("Page "), F.col("page_no").cast("string")).alias("title"), "tokens")
    first = nodes.groupBy("doc_id", "page_no").agg(F.min_by("title", "ord").alias("title")).where("page_no % 3 = 1")
    marks = first.select("doc_id", "page_no", F.lit("bookmark").alias("origin"), F.lit(0).alias("ord"), (1 + F.col("page_no") % 2).alias("level"), "title", F.lit(0).alias("tokens"))
    spans = lines.where("doc_id % 2 = 0 and page_no in (1, 5)").select("doc_id", "page_no").distinct()
    spans = spans.select("doc_id", "page_no", F.lit("doctype").alias("origin"), F.lit(0).alias("ord"), F.lit(1).alias("level"), F.concat(F.lit("Part "), F.col("page_no").cast("string")).alias("title"), F.lit(0).alias("tokens"))
    return nodes.unionByName(lead).unionByName(marks).unionByName(spans)


_FOLDED = "trim(regexp_replace(lower(strip_accents(replace(replace({}, 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g'))"


@query(
    f"""with recursive l as (select *, ((line_no - 1) // 8 + 1)::int as page_no, length(line) // 3 + 1 as tok, length(line) < 40 as head from {LINES} where line <> ''),
    n as (select doc_id, page_no, 3 as rank, line_no as ord, 1 + length(line) % 2 as level, line as title, tok as tokens from l where head),
    ld as (select doc_id, page_no, sum(tok) as tokens from (select *, coalesce(max(head::int) over (partition by doc_id, page_no order by line_no rows between unbounded preceding and 1 preceding), 0) as b from l) where not head and b = 0 group by 1, 2),
    m as (select * from n union all select doc_id, page_no, 2, 0, 1, 'Page ' || page_no, tokens from ld
      union all select doc_id, page_no, 1, 0, 1 + page_no % 2, arg_min(title, ord), 0 from n where page_no % 3 = 1 group by 1, 2
      union all select distinct doc_id, page_no, 0, 0, 1, 'Part ' || page_no, 0 from l where doc_id % 2 = 0 and page_no in (1, 5)),
    q as (select *, row_number() over (partition by doc_id order by page_no, rank, ord) as i, {_FOLDED.format("title")} as key, max((rank = 0)::int) over (partition by doc_id) as off,
      count(*) filter (where rank = 0) over (partition by doc_id order by page_no, rank, ord) as span from m),
    w as (select q.*, case when rank = 0 then 1 when rank = 1 then level + off end as own,
      exists (select 1 from q b where b.doc_id = q.doc_id and b.page_no = q.page_no and b.rank = 1 and b.key = q.key) and rank = 3 as rep from q),
    v as (select w.*, coalesce((select arg_max(b.own, b.i) from w b where b.doc_id = w.doc_id and b.span = w.span and b.rank = 1 and b.i <= w.i), off) as base from w),
    s as (select v.*, coalesce(own, case when rank = 2 then base + 1 else base + level end) as lvl,
      case when rank = 2 then not exists (select 1 from v b where b.doc_id = v.doc_id and b.i < v.i and (b.rank = 2 or not b.rep)) else not rep end as starts from v),
    t as (select *, sum(starts::int) over (partition by doc_id order by i) as k from s),
    u as (select t.*, case when rep then (select min(b.k) from t b where b.doc_id = t.doc_id and b.page_no = t.page_no and b.rank = 1 and b.key = t.key) else k end as node from t),
    g as (select doc_id, node, arg_min(lvl, i) as level, arg_min(title, i) as title, arg_min(case rank when 0 then 'doctype' when 1 then 'bookmark' else 'layout' end, i) as origin, min(page_no) as page_start, sum(tokens) as tokens from u group by 1, 2)
    select doc_id, node::int as ord, coalesce((select max(b.node) from g b where b.doc_id = g.doc_id and b.node < g.node and b.level < g.level
        and not exists (select 1 from g c where c.doc_id = g.doc_id and c.node > b.node and c.node < g.node and c.level < g.level)), -1)::int as parent,
      origin, title, page_start, tokens::bigint as tokens from g"""
)
def tree_with_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """Pages of eight lines; every third page's first heading is a bookmark, too; every second document has two spans."""
    nodes = outline(_marks(spark, d))
    parents = tree(nodes.select("doc_id", "ord", "level", "title", "tokens")).select("doc_id", "ord", "parent")
    return nodes.join(parents, ["doc_id", "ord"]).select("doc_id", "ord", "parent", "origin", "title", "page_start", F.col("tokens").cast("bigint").alias("tokens"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("line_no")
    rows = lines_of(load(spark, d, "documents"))
    return rows.select("doc_id", (F.floor((n - 1) / 6) + 1).cast("int").alias("page_no"), ((n - 1) % 6 + 1).cast("int").alias("line_no"), F.col("line").alias("text"), F.lit(10.0).alias("x0"), (n * 10.0).alias("y0"), F.length("line").cast("double").alias("x1"), (n * 10.0 + 8).alias("y1"), F.when(F.col("doc_id") % 3 != 0, 150.0).alias("dpi"))


_BOXES = f"bx as (select doc_id, ((line_no - 1) // 6 + 1)::int as page_no, ((line_no - 1) % 6 + 1)::int as line_no, line as text, length(line)::double as x1, case when doc_id % 3 <> 0 then 72 / 150.0::double else 0 end as by_ from {LINES})"


@query(f"with {_BOXES} select doc_id, page_no, line_no, x1, round(x1 * by_, 6) as x1_pt from bx where page_no = 2 and line_no between 2 and 3")
def locate_cited_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every document is cited with the second and third line of its second page; some citations are none."""
    cite = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit(":p2:l2-l3"))
    cited = load(spark, d, "documents").select(F.explode(F.array(cite, F.concat(cite, F.lit("x")))).alias("cite")).distinct()
    return locate_citations(cited, _boxes(spark, d)).select("doc_id", "page_no", "line_no", "x1", F.round("x1_pt", 6).alias("x1_pt"))


@query(f"with {_BOXES}, w as (select doc_id, case when doc_id % 2 = 0 then 1 end as page_no, left(split_part(text, chr(10), 1), 9) as wanted from documents) select distinct bx.doc_id, bx.page_no, line_no from bx join w on w.doc_id = bx.doc_id and (w.page_no is null or w.page_no = bx.page_no) where trim(wanted) <> '' and contains({_FOLDED.format('text')}, {_FOLDED.format('wanted')})")
def locate_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first nine characters of each document; every second one on its first page only."""
    first = F.left(F.split("text", "\n")[0], F.lit(9))
    wanted = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).alias("page_no"), first.alias("wanted"))
    return locate_text(wanted, _boxes(spark, d)).select("doc_id", "page_no", "line_no").distinct()


_WORDS = "list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda w: w <> '')"


@query(
    f"""with t as (select conv_id, turn, coalesce(text, '') as t from conversations),
    s as (select conv_id, string_agg(t, '; ' order by turn) as whole, list({_WORDS.format('t')} order by turn) as parts from t where trim(t) <> '' group by 1)
    select c.conv_id, regexp_replace(coalesce(array_to_string(({_WORDS.format('s.whole')})[:24], ' '), ''), ';$', '') as summary,
      coalesce(trim(regexp_replace(regexp_replace(replace(regexp_replace(list_filter(string_split(f.t, chr(10)), lambda x: trim(x) <> '')[1], '[#*]|---|> ', '', 'g'), '|', ' '), '\\s+', ' ', 'g'), '^$', '')), '') as first
    from (select distinct conv_id from t) c left join s using (conv_id) left join t f on f.conv_id = c.conv_id and f.turn = 0"""
)
def summaries_and_first_lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns as continued pages, twelve words each; the first line of the first turn."""
    turns = load(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    first = F.max(F.when(F.col("turn") == 0, F.col("text")))
    rows = turns.groupBy("conv_id").agg(parts.alias("parts"), first.alias("first"))
    long = T.first_words(joined_summary("parts", 12), 24)
    return rows.select("conv_id", long.alias("summary"), F.coalesce(first_line(F.col("first")), F.lit("")).alias("first"))


@query(
    """with b as (select conv_id as doc_id, turn, coalesce(text, '') as t, turn % 3 = 1 as head from conversations),
    f as (select doc_id, arg_min(t, turn) filter (where head) as title, arg_min(t, turn) as body from b group by 1),
    x as (select doc_id, case when doc_id % 4 = 0 then 'Given' end as given, trim(regexp_replace(regexp_replace(title, '(?m)^#{1,6}\\s+', '', 'g'), '[*_`|]', '', 'g')) as title, trim(regexp_replace(regexp_replace(regexp_replace(body, '(?m)^#{1,6}\\s+', '', 'g'), '[*_`|]', '', 'g'), '\\s+', ' ', 'g')) as body from f)
    select doc_id, coalesce(given, title, 'document ' || doc_id) as title, array_to_string(string_split(body, ' ')[:40], ' ') as summary from x"""
)
def conversation_cards(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents: given titles, else the first heading's, else the number; the first words as a summary."""
    turns = load(spark, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 1, "heading").otherwise("paragraph")
    blocks = turns.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("turn").alias("block_no"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    docs = turns.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.when(F.col("doc_id") % 4 == 0, "Given").alias("title"), F.lit("").alias("summary"))
    return document_cards(docs, blocks)


@query("select event_id, case event_id % 5 when 0 then (props->>'k') when 1 then event_type when 2 then (event_id * 2.5)::decimal(18,1)::varchar when 3 then 'true' end as text from (select * from events) where event_id % 5 <> 2 or (event_id * 2.5) % 1 <> 0 union all select event_id, (event_id * 2.5)::bigint::varchar from events where event_id % 5 = 2 and (event_id * 2.5) % 1 = 0")
def json_scalar_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers, texts, fractions, yes or no, and null."""
    e = F.col("event_id")
    made = F.array(F.get_json_object("props", "$.k"), F.concat(F.lit('"'), "event_type", F.lit('"')), F.format_string("%.1f", e * 2.5), F.lit("true"), F.lit("null"))
    return load(spark, d, "events").select("event_id", value_text(F.element_at(made, (e % 5 + 1).cast("int"))).alias("text"))
