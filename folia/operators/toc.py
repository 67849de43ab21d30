"""Tables of contents under a budget, and the walk over document trees that they serve."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load
from .trees import _RANGES, _TREE, _ranged

# Words of a card's summary in each form of a table of contents, and whether it names branches: fixed values.
FORMS = ((True, 120), (False, 120), (False, 40), (False, 0))
LINE_TOKENS = 10


def estimated(length: Column) -> Column:
    return F.floor(length / 3) + 1


def line_tokens(title: Column) -> Column:
    """What a node's line costs in a table of contents."""
    return estimated(F.length(title) + 1) + LINE_TOKENS


def below(nodes: DataFrame, levels: int = 9) -> DataFrame:
    """Adds `below`, the number of nodes under each. nodes: doc_id, ord (pre-order), depth."""
    by = Window.partitionBy("doc_id")
    behind = by.orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("_at", F.row_number().over(by.orderBy("ord"))).withColumn("_end", F.count(F.lit(1)).over(by) + 1)
    # the next node that stands as high or higher ends a subtree
    ends = [F.when(F.col("depth") == k, F.last(F.when(F.col("depth") <= k, F.col("_at")), ignorenulls=True).over(behind)) for k in range(1, levels + 1)]
    return rows.withColumn("below", (F.coalesce(*ends, F.col("_end")) - F.col("_at") - 1).cast("int")).drop("_at", "_end")


def view(nodes: DataFrame, budget: int) -> DataFrame:
    """The nodes of each tree to show: whole levels, from the first on, while they fit; the first one always.

    Adds hidden: how many nodes are under one whose children aren't shown. nodes: doc_id, ord, depth, title, below.
    """
    by = Window.partitionBy("doc_id").orderBy("depth").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(line_tokens(F.col("title"))).over(by)
    rows = nodes.withColumn("_fits", (upto <= budget) | (F.col("depth") == 1))
    last = F.max(F.when(F.col("_fits"), F.col("depth"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_last", last).where("_fits")
    return rows.withColumn("hidden", F.when(F.col("depth") == F.col("_last"), F.col("below")).otherwise(0)).drop("_fits", "_last")


def pages_of(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def case_contents(docs: DataFrame, nodes: DataFrame, budget: int, tree_budget: int) -> DataFrame:
    """The table of contents of each case, in the first of FORMS that fits the budget, or else the last.

    docs: case_id, doc_id, created, file, page_count, summary, expanded (shown with its whole tree, within
    tree_budget). nodes: doc_id, ord, depth, short_id, title, page_start, page_end. Where a case expands nothing and
    all its trees fit tree_budget together, all are shown whole. Gives case_id, form (from 0), tokens, text.
    """
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("created", "doc_id"))
    docs = docs.withColumn("no", number).withColumn("ref", F.concat(F.lit("d"), F.col("no").cast("string")))
    nodes = below(nodes.select("doc_id", "ord", "depth", "short_id", "title", "page_start", "page_end"))
    costs = nodes.groupBy("doc_id").agg(F.sum(line_tokens(F.col("title"))).alias("cost"), F.count(F.lit(1)).alias("n_nodes"))
    docs = docs.join(costs, "doc_id", "left")
    case = Window.partitionBy("case_id")
    whole = ~F.max("expanded").over(case) & (F.sum(F.coalesce("cost", F.lit(0))).over(case) <= tree_budget)
    docs = docs.withColumn("whole", whole).withColumn("expanded", F.col("expanded") | F.col("whole"))

    named = nodes.join(docs.select("doc_id", "ref", "expanded"), "doc_id")
    head = F.concat(F.lit("["), "ref", F.lit("."), "short_id", F.lit("] "))
    where = F.concat(F.lit(" (p. "), pages_of(F.col("page_start"), F.col("page_end")), F.lit(")"))
    more = F.when(F.col("hidden") > 0, F.concat(F.lit("   (+"), F.col("hidden").cast("string"), F.lit(" nodes, expand "), "ref", F.lit("."), "short_id", F.lit(")"))).otherwise("")
    full = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), head, "title", where, more, F.lit("\n"))
    trees = view(named.where("expanded"), tree_budget).groupBy("doc_id").agg(_joined("ord", full).alias("tree"))
    branch = F.concat(head, T.truncate(F.col("title"), 80), where, F.when(F.col("below") > 0, F.lit(" +")).otherwise(""))
    firsts = named.where("depth = 1 and not expanded").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", branch.alias("b")))), lambda r: r["b"]).alias("firsts"))
    in_twos = F.transform(F.sequence(F.lit(0), F.expr("(size(firsts) - 1) div 2")), lambda k: F.concat(F.lit("  "), F.array_join(F.slice("firsts", 2 * k + 1, 2), "   "), F.lit("\n")))
    docs = docs.join(trees, "doc_id", "left").join(firsts, "doc_id", "left").withColumn("branches", F.when(F.size("firsts") > 0, F.array_join(in_twos, "")))

    count = F.concat(F.lit("  (+"), F.col("n_nodes").cast("string"), F.lit(" nodes, expand "), "ref", F.lit(")\n"))
    card = F.concat(F.lit("["), "ref", F.lit("] "), "file", F.lit(" ("), F.col("page_count").cast("string"), F.lit(" p.)"))
    tail = F.when(F.col("n_nodes").isNull(), " (no contents yet)").otherwise("")

    def form(branches: bool, words: int) -> Column:
        said = T.first_words(F.col("summary"), words) if words else F.lit("")
        line = F.concat(card, F.when(said != "", F.concat(F.lit(" — "), said)).otherwise(""), tail, F.lit("\n"))
        under = F.when(F.col("expanded"), F.coalesce("tree", F.lit(""))).otherwise(F.coalesce(F.col("branches") if branches else count, F.lit("")))
        return F.concat(line, under)

    docs = docs.select("case_id", "no", "whole", *[form(b, w).alias(f"f{k}") for k, (b, w) in enumerate(FORMS)])
    sizes = docs.groupBy("case_id").agg(F.count(F.lit(1)).alias("files"), F.max("whole").alias("whole"), *[F.sum(F.length(f"f{k}")).alias(f"n{k}") for k in range(len(FORMS))])
    opening = F.concat(F.lit('<case code="'), F.col("case_id").cast("string"), F.lit('" files="'), F.col("files").cast("string"), F.lit('">\n'))
    tokens = F.array(*[estimated(F.length(opening) + F.col(f"n{k}") + F.length(F.lit("</case>\n"))) for k in range(len(FORMS))])
    fits = F.when(F.col("whole"), 0)
    for k in range(len(FORMS) - 1):
        fits = fits.when(tokens[k] <= budget, k)
    sizes = sizes.withColumn("form", fits.otherwise(len(FORMS) - 1)).select("case_id", "form", opening.alias("opening"), F.get(tokens, "form").alias("tokens"))
    # only the form chosen is gathered
    chosen = docs.join(sizes, "case_id").withColumn("said", F.get(F.array(*[f"f{k}" for k in range(len(FORMS))]), "form"))
    texts = chosen.groupBy("case_id").agg(F.first("form").alias("form"), F.first("tokens").alias("tokens"), F.first("opening").alias("opening"), _joined("no", F.col("said")).alias("said"))
    return texts.select("case_id", "form", "tokens", F.concat("opening", "said", F.lit("</case>\n")).alias("text"))


def _joined(order: str, text: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda r: r["t"]), "")


# -- the walk --------------------------------------------------------------------------------


def by_terms(frontier: DataFrame, big: int, last: bool) -> DataFrame:
    """A picker without a model: reads nodes whose titles match, opens those with matches below that don't match
    themselves or are too big to read. frontier: score, score_below, page_start, page_end."""
    opens = (F.col("score_below") > 0) & ((F.col("score") == 0) | (F.col("page_end") - F.col("page_start") + 1 > big))
    return frontier.withColumn("choice", F.when(F.lit(not last) & opens, "open").when(F.col("score") > 0, "read"))


Picker = Callable[[DataFrame, int, bool], DataFrame]


def walk(queries: DataFrame, nodes: DataFrame, picker: Picker = by_terms, hops: int = 3, big: int = 3, per_doc: int = 5, per_query: int = 40) -> DataFrame:
    """Pages to read for each query: query_id, doc_id, page_no, hop, ord (the node that led there).

    queries: query_id, term (folded), a row for each. nodes: doc_id, ord, parent, path, title, page_start, page_end.
    The frontier begins with the first level of every tree; the picker (rules, or a completer that answers
    with choices) says of each node whether to read or to open it; the children of opened nodes are
    the next frontier, for `hops` hops at most. Pages go to the budgets of their document and their query by hop,
    then by score. Only nodes that match, and those above them, are carried; matching is a join on words.
    """
    words = nodes.select("doc_id", "ord", "path", F.explode(F.array_distinct(F.regexp_extract_all(T.unaccent(F.col("title")), F.lit(r"([\p{L}\p{N}]+)")))).alias("term"))
    met = words.join(queries.select("query_id", "term").distinct(), "term").groupBy("query_id", "doc_id", "ord").agg(F.count(F.lit(1)).alias("score"), F.first("path").alias("path"))
    up = met.select("query_id", "doc_id", F.explode("path").alias("ord"), (F.col("ord") != F.element_at("path", -1)).alias("_"), "score", F.element_at("path", -1).alias("own"))
    live = up.groupBy("query_id", "doc_id", "ord").agg(
        F.coalesce(F.max(F.when(F.col("own") == F.col("ord"), F.col("score"))), F.lit(0)).alias("score"),
        F.coalesce(F.max(F.when(F.col("own") != F.col("ord"), F.col("score"))), F.lit(0)).alias("score_below"),
    )
    live = live.join(nodes.select("doc_id", "ord", "parent", "page_start", "page_end"), ["doc_id", "ord"])
    frontier, read = live.where("parent = -1"), None
    for hop in range(hops + 1):
        said = picker(frontier, big, hop == hops)
        found = said.where("choice = 'read'").select("query_id", "doc_id", "ord", "score", F.lit(hop).alias("hop"), "page_start", "page_end")
        read = found if read is None else read.unionByName(found)
        opened = said.where("choice = 'open'").select("query_id", "doc_id", F.col("ord").alias("parent"))
        frontier = live.join(opened, ["query_id", "doc_id", "parent"])
    pages = read.select("query_id", "doc_id", F.struct("hop", (-F.col("score")).alias("less"), "ord").alias("at"), F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    pages = pages.groupBy("query_id", "doc_id", "page_no").agg(F.min("at").alias("at"))
    own = Window.partitionBy("query_id", "doc_id").orderBy("at", "page_no")
    pages = pages.withColumn("n", F.row_number().over(own)).where(F.col("n") <= per_doc)
    every = Window.partitionBy("query_id").orderBy("at.hop", "at.less", "doc_id", "at.ord", "page_no")
    pages = pages.withColumn("n", F.row_number().over(every)).where(F.col("n") <= per_query)
    return pages.select("query_id", "doc_id", "page_no", F.col("at.hop").alias("hop"), F.col("at.ord").alias("ord"))


# -- queries ---------------------------------------------------------------------------------

_CASES = """docs as (
  select floor(sqrt(doc_id))::int as case_id, doc_id, 'file' || doc_id as file, page_count,
    array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[:150], ' ') as summary, floor(sqrt(doc_id)) % 2 = 1 and doc_id % 7 = 0 as asked
  from documents join pc using (doc_id))"""


def _form_sql(k: int) -> str:
    branches, words = FORMS[k]
    said = f"array_to_string(string_split(summary, ' ')[:{words}], ' ')" if words else "''"
    other = "branches" if branches else "'  (+' || n_nodes || ' nodes, expand ' || ref || ')' || chr(10)"
    return f"card || case when {said} <> '' then ' — ' || {said} else '' end || tail || chr(10) || coalesce(case when expanded then tree else {other} end, '') as f{k}"


@query(
    f"""with recursive {_TREE}, {_RANGES}, {_CASES},
    nd as (select tr.*, page_start, page_end, (length(tr.title) + 1) // 3 + 11 as cost,
        case when page_start = page_end then page_start::varchar else page_start || '–' || page_end end as pages from tr join rg using (doc_id, ord)),
    dup as (select doc_id, o as ord, count(*) - 1 as below from (select doc_id, unnest(path) as o from dp) group by 1, 2),
    n1 as (select nd.*, below from nd join dup using (doc_id, ord)),
    cost as (select doc_id, sum(cost) as cost, count(*) as n_nodes from n1 group by 1),
    d1 as (select *, 'd' || row_number() over (partition by case_id order by doc_id) as ref, row_number() over (partition by case_id order by doc_id) as no from docs left join cost using (doc_id)),
    d2 as (select *, not max(asked) over (partition by case_id) and sum(coalesce(cost, 0)) over (partition by case_id) <= 1500 as whole from d1),
    d3 as (select *, asked or whole as expanded from d2),
    lvl as (select doc_id, depth, sum(sum(cost)) over (partition by doc_id order by depth) as upto from n1 group by 1, 2),
    sh as (select doc_id, max(depth) as last from lvl where upto <= 1500 or depth = 1 group by 1),
    tx as (select doc_id, string_agg(repeat('  ', depth - 1) || '[' || ref || '.' || short_id || '] ' || title || ' (p. ' || pages || ')'
        || case when depth = last and below > 0 then '   (+' || below || ' nodes, expand ' || ref || '.' || short_id || ')' else '' end || chr(10), '' order by ord) as tree
      from n1 join sh using (doc_id) join d3 using (doc_id) where expanded and depth <= last group by 1),
    b1 as (select doc_id, ord, '[' || ref || '.' || short_id || '] ' || case when length(title) > 80 then left(title, 80) || '…' else title end || ' (p. ' || pages || ')'
        || case when below > 0 then ' +' else '' end as b, row_number() over (partition by doc_id order by ord) - 1 as k
      from n1 join d3 using (doc_id) where depth = 1 and not expanded),
    b2 as (select doc_id, k // 2 as two, '  ' || string_agg(b, '   ' order by ord) || chr(10) as line from b1 group by 1, 2),
    b3 as (select doc_id, string_agg(line, '' order by two) as branches from b2 group by 1),
    d4 as (select *, '[' || ref || '] ' || file || ' (' || page_count || ' p.)' as card, case when n_nodes is null then ' (no contents yet)' else '' end as tail
      from d3 left join tx using (doc_id) left join b3 using (doc_id)),
    d5 as (select case_id, no, whole, {", ".join(_form_sql(k) for k in range(4))} from d4),
    sz as (select case_id, bool_or(whole) as whole, '<case code="' || case_id || '" files="' || count(*) || '">' || chr(10) as opening, {", ".join(f"sum(length(f{k})) as n{k}" for k in range(4))} from d5 group by 1),
    fm as (select case_id, opening, list_transform([n0, n1, n2, n3], lambda n: (length(opening) + n + 8) // 3 + 1) as t, whole from sz),
    ch as (select *, case when whole or t[1] <= 2500 then 0 when t[2] <= 2500 then 1 when t[3] <= 2500 then 2 else 3 end as form from fm)
    select case_id, form, t[form + 1]::bigint as tokens, md5(opening || string_agg([f0, f1, f2, f3][form + 1], '' order by no) || '</case>' || chr(10)) as digest
    from d5 join ch using (case_id) group by case_id, form, t, opening"""
)
def case_toc_forms(spark: SparkSession, d: str) -> DataFrame:
    """Cases of one, three, five and more documents, so that every form is reached; some documents of every second case are expanded."""
    nodes, counts = _ranged(spark, d)
    case = F.floor(F.sqrt("doc_id")).cast("int")
    docs = load(spark, d, "documents").join(counts, "doc_id").select(
        case.alias("case_id"), "doc_id", F.col("doc_id").alias("created"), F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("file"), "page_count",
        T.first_words(F.col("text"), 150).alias("summary"), ((case % 2 == 1) & (F.col("doc_id") % 7 == 0)).alias("expanded"),
    )
    return case_contents(docs, nodes, 2500, 1500).select("case_id", "form", "tokens", F.md5("text").alias("digest"))


@query(
    f"""with recursive {_TREE}, {_RANGES},
    q as (select distinct lang as query_id, w as term from (select lang, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+')[:3]) as w
      from (select lang, arg_min(text, doc_id) as text from documents group by 1))),
    w as (select distinct doc_id, ord, unnest(regexp_extract_all(lower(strip_accents(title)), '[\\p{{L}}\\p{{N}}]+')) as term from h),
    met as (select query_id, doc_id, ord, count(*) as score from w join q using (term) group by 1, 2, 3),
    up as (select query_id, m.doc_id, unnest(path) as anc, m.ord, score from met m join dp on dp.doc_id = m.doc_id and dp.ord = m.ord),
    live as (select query_id, u.doc_id, anc as ord, coalesce(max(score) filter (where u.ord = anc), 0) as score, coalesce(max(score) filter (where u.ord <> anc), 0) as under from up u group by 1, 2, 3),
    l as (select live.*, p.parent, page_start, page_end from live join p using (doc_id, ord) join rg using (doc_id, ord)),
    f as (select *, 0 as hop, under > 0 and (score = 0 or page_end - page_start + 1 > 3) as opens from l where parent = -1
      union all select l.*, f.hop + 1, f.hop + 1 < 3 and l.under > 0 and (l.score = 0 or l.page_end - l.page_start + 1 > 3) from f join l on l.query_id = f.query_id and l.doc_id = f.doc_id and l.parent = f.ord where f.opens),
    pg as (select query_id, doc_id, unnest(range(page_start, page_end + 1)) as page_no, hop, -score as less, ord from f where not opens and score > 0),
    one as (select query_id, doc_id, page_no, min((hop, less, ord)) as m from pg group by 1, 2, 3),
    a as (select *, row_number() over (partition by query_id, doc_id order by m, page_no) as n from one),
    b as (select *, row_number() over (partition by query_id order by m[1], m[2], doc_id, m[3], page_no) as k from a where n <= 5)
    select query_id, doc_id, page_no::int as page_no, m[1]::int as hop, m[3]::int as ord from b where k <= 400"""
)
def reasoning_pages(spark: SparkSession, d: str) -> DataFrame:
    """A query a language, the first three words of its first document, walked over all trees by rules."""
    docs = load(spark, d, "documents")
    first = docs.groupBy("lang").agg(F.min_by("text", "doc_id").alias("text"))
    terms = F.explode(F.slice(F.regexp_extract_all(T.unaccent(F.col("text")), F.lit(r"([\p{L}\p{N}]+)")), 1, 3))
    queries = first.select(F.col("lang").alias("query_id"), terms.alias("term"))
    return walk(queries, _ranged(spark, d)[0], per_query=400)
