"""Lexical retrieval over sections and lines: boolean match, ranking, fuzzy match, snippets, verification."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import python_side as P
from ..functions import text as T
from ..registry import query
from ..session import load
from .documents import lines_of

WORDS = r"([\p{L}\p{N}]+)"


def words(c: Column) -> Column:
    """Folded words of a text, in order, without stemming or stop words."""
    return F.regexp_extract_all(T.unaccent(c), F.lit(WORDS))


def parse_query(q: str) -> list[list[tuple[bool, list[str]]]]:
    """Web-style query: words are joined by and, "..." is a phrase, or splits, a leading - negates.

    Alternatives, each a list of (wanted, words of a term or phrase).
    """
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', q):
        if m[3] is None:
            term, wanted = P.tokens(m[2]), not m[1]
        elif m[3].lower() == "or":
            out.append([])
            continue
        else:
            wanted = not m[3].startswith("-")
            term = P.tokens(m[3].lstrip("-"))
        if term:
            out[-1].append((wanted, term))
    return [a for a in out if a]


def matches(tokens: Column, q: str) -> Column:
    """Whether a token array matches; a phrase is its words in a row."""

    def term(ws: list[str]) -> Column:
        if len(ws) == 1:
            return F.array_contains(tokens, ws[0])
        joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        return F.contains(joined, F.lit(f" {' '.join(ws)} "))

    out = F.lit(False)
    for alternative in parse_query(q):
        hit = F.lit(True)
        for wanted, ws in alternative:
            hit &= term(ws) if wanted else ~term(ws)
        out |= hit
    return out


def matches_text(text: Column, q: str) -> Column:
    """matches(words(text), q) with the text folded once, and cut into words only where every wanted word of an
    alternative occurs in it as characters."""

    def judge(folded: Column) -> Column:
        near = F.lit(False)
        for alternative in parse_query(q):
            here = F.lit(True)
            for w in dict.fromkeys(w for wanted, ws in alternative if wanted for w in ws):
                here &= F.contains(folded, F.lit(w))
            near |= here
        return near & T.let(F.regexp_extract_all(folded, F.lit(WORDS)), lambda t: matches(t, q))

    return T.let(T.unaccent(text), judge)


def clamp_top(k: int | None, least: int = 1, most: int = 50, usual: int = 10) -> int:
    """A wanted number of hits, or the usual one where it is out of bounds."""
    return k if k is not None and least <= k <= most else usual


def wanted_terms(q: str) -> list[str]:
    return list(dict.fromkeys(w for a in parse_query(q) for ok, ws in a if ok for w in ws))


def wanted_alternatives(q: str) -> list[list[str]]:
    """The terms a cover must hold: of each alternative those wanted; a phrase counts as its words."""
    found = [list(dict.fromkeys(w for ok, ws in a if ok for w in ws)) for a in parse_query(q)]
    return [a for a in found if a]


def cover_rank(text: Column, q: str) -> Column:
    ways = wanted_alternatives(q)

    @F.pandas_udf("double")
    def rank(s: pd.Series) -> pd.Series:
        return s.map(lambda t: P.cover_density(P.entries_of(P.tokens(t or ""), ways), ways))

    return rank(text)


def fuzzy(text: Column, q: str, least: float = 0.0, whole: Column | None = None) -> Column:
    """Word similarity to the query. What is below `least` may come as 0, but where `whole` holds."""

    @F.pandas_udf("double")
    def score(s: pd.Series, always: pd.Series) -> pd.Series:
        texts = s.fillna("")
        out = pd.Series(0.0, s.index)
        out[always] = [P.word_similarity(q, t) for t in texts[always]]
        out[~always] = P.word_similarities(q, texts[~always].tolist(), least)
        return out

    return score(text, F.lit(least <= 0) if whole is None else F.coalesce(whole, F.lit(False)))


def headline(text: Column, q: str) -> Column:
    ways = wanted_alternatives(q)

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: P.headline(t or "", ways))

    return cut(text)


def maybe_fuzzy(text: Column, q: str, least: float) -> Column:
    """A necessary condition that built-ins can test: enough of the query's trigrams occur in the text at all."""
    grams = sorted(P.trigrams(q))
    if not grams:
        return F.lit(least <= 0)
    padded = F.concat(F.lit("  "), F.regexp_replace(T.unaccent(text), r"[^\p{L}\p{N}]+", "  "), F.lit("  "))
    # a filter shares no parts of its condition: without let the text is cut anew for each trigram
    return T.let(padded, lambda p: sum((F.contains(p, F.lit(g)).cast("int") for g in grams[1:]), F.contains(p, F.lit(grams[0])).cast("int")) >= least * len(grams))


def section_hits(sections: DataFrame, q: str, top: int = 50) -> DataFrame:
    """Rank + half the exact rank + 0.3 word similarity, over sections that match or are similar enough."""
    exact = F.contains(T.normalize(F.col("text")), T.normalize(F.lit(q)))
    some = sections.withColumn("_m", matches_text(F.col("text"), q)).where(F.col("_m") | maybe_fuzzy(F.col("text"), q, 0.6))
    scored = some.withColumn("_rank", cover_rank(F.col("text"), q)).withColumn("_sim", fuzzy(F.col("text"), q, 0.6, F.col("_m")))
    kept = scored.where(F.col("_m") | (F.col("_sim") >= 0.6))
    score = F.col("_rank") + 0.5 * F.when(exact, F.col("_rank")).otherwise(0.0) + 0.3 * F.col("_sim")
    keys = [c for c in sections.columns if c != "text"]
    best = kept.select(*keys, F.round(score, 6).alias("score"), "text").orderBy(F.desc("score"), *keys).limit(top)
    return best.select(*keys, "score", headline(F.col("text"), q).alias("snippet"))


def page_ranks(pages: DataFrame, q: str) -> DataFrame:
    """Rank of the pages that match. pages: doc_id, page_no, text."""
    hit = pages.where(matches_text(F.col("text"), q))
    return hit.select("doc_id", "page_no", F.round(cover_rank(F.col("text"), q), 6).alias("rank"))


def document_ranks(cards: DataFrame, pages: DataFrame, q: str, top: int = 10) -> DataFrame:
    """Twice the rank of the document's card and its best page's rank; documents without any hit rank 0.
    cards: doc_id, card, created_at."""
    best = page_ranks(pages, q).groupBy("doc_id").agg(F.max("rank").alias("page_rank"))
    score = 2 * cover_rank(F.col("card"), q) + F.coalesce("page_rank", F.lit(0.0))
    rows = cards.join(best, "doc_id", "left").select("doc_id", F.round(score, 6).alias("score"), "created_at")
    return rows.orderBy(F.desc("score"), F.desc("created_at"), "doc_id").limit(clamp_top(top))


def keyword_hints(sections: DataFrame, most: int = 8) -> DataFrame:
    """At most eight pages a document, from its best sections on. sections: doc_id, score, page_start, page_end."""
    pages = sections.select("doc_id", "score", "page_start", F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    first = pages.groupBy("doc_id", "page_no").agg(F.min(F.struct(-F.col("score"), "page_start", "page_no")).alias("at"))
    w = Window.partitionBy("doc_id").orderBy("at")
    kept = first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("page_no")).alias("pages"))


def by_page(hits: DataFrame, least: float = 0.4) -> DataFrame:
    """Line hits from a score up, grouped by page. hits: doc_id, page_no, line_no, line, score."""
    rows = hits.where(F.col("score") >= least).select("doc_id", "page_no", "score", F.struct("line_no", "line", "score").alias("h"))
    return rows.groupBy("doc_id", "page_no").agg(F.max("score").alias("best"), F.array_sort(F.collect_list("h")).alias("hits"))


def line_hits(lines: DataFrame, q: str, least: float = 0.5) -> DataFrame:
    """1 for lines that contain the query, else word similarity from `least` up."""
    has = T.contains_fold(F.col("line"), F.lit(q))
    some = lines.where(has | maybe_fuzzy(F.col("line"), q, least))
    return some.withColumn("score", F.when(has, F.lit(1.0)).otherwise(fuzzy(F.col("line"), q, least))).where(F.col("score") >= least)


def keyword_search(sections: DataFrame, lines: DataFrame, q: str, top: int = 10) -> DataFrame:
    """Best sections, then their three best lines each; where no section is found, the lines that
    resemble the query from 0.5 up. sections: doc_id, first_line, last_line, text."""
    top = clamp_top(top)
    hits = section_hits(sections.select("doc_id", "first_line", "last_line", "text"), q, 5 * top).drop("snippet").withColumnRenamed("score", "section_score")
    inside = (F.col("l.line_no") >= F.col("s.first_line")) & (F.col("l.line_no") <= F.col("s.last_line"))
    found = lines.alias("l").join(F.broadcast(hits).alias("s"), (F.col("l.doc_id") == F.col("s.doc_id")) & inside)  # at most 5 * top rows
    scored = found.withColumn("_line", F.when(T.contains_fold(F.col("l.line"), F.lit(q)), F.lit(1.0)).otherwise(fuzzy(F.col("l.line"), q)))
    w = Window.partitionBy("l.doc_id", "s.first_line").orderBy(F.desc("_line"), "l.line_no")
    best = scored.withColumn("_n", F.row_number().over(w)).where("_n <= 3").select(F.col("l.doc_id").alias("doc_id"), F.col("l.line_no").alias("line_no"), (F.col("section_score") + F.col("_line")).alias("score"))
    # one row, so that the fallback is decided inside the plan
    none = F.broadcast(hits.agg(F.count(F.lit(1)).alias("_hits")).where("_hits = 0"))
    loose = line_hits(lines, q, 0.5).join(none, how="cross").select("doc_id", "line_no", "score")
    both = best.unionByName(loose).groupBy("doc_id", "line_no").agg(F.round(F.max("score"), 6).alias("score"))
    return both.orderBy(F.desc("score"), "doc_id", "line_no").limit(top)


def verify_quotes(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """The smallest window of one to four consecutive lines that holds the quote; quotes that no window
    holds are dropped. quotes: doc_id, quote."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    # lines are folded once, before they are joined; empty ones leave no space
    folded = lines.select("doc_id", "line_no", T.normalize(F.col("line")).alias("_n"))
    cols = [F.array_join(F.filter(F.collect_list("_n").over(w.rowsBetween(0, k)), lambda x: x != ""), " ").alias(f"w{k + 1}") for k in range(4)]
    wide = folded.select("doc_id", "line_no", *cols)
    met = wide.join(quotes.withColumn("_q", T.normalize(F.col("quote"))), "doc_id")
    size = F.coalesce(*[F.when(F.contains(F.col(f"w{k}"), F.col("_q")), F.lit(k)) for k in range(1, 5)])
    hit = met.withColumn("size", size).where("size is not null")
    best = hit.groupBy("doc_id", "quote").agg(F.min(F.struct("size", "line_no")).alias("m"))
    return best.select("doc_id", "quote", F.col("m.line_no").alias("first_line"), (F.col("m.line_no") + F.col("m.size") - 1).alias("last_line"))


def tool_score(name: Column, description: Column, q: str) -> Column:
    """Name word 10, inside the name 5, description word 2, inside it 1; a +term must match."""
    names, said = words(name), words(description)
    total, ok = F.lit(0), F.lit(True)
    for raw in q.split():
        need, w = raw.startswith("+"), "".join(P.tokens(raw))
        if not w:
            continue
        s = F.when(F.array_contains(names, w), 10).when(F.contains(T.unaccent(name), F.lit(w)), 5).otherwise(0) + F.when(F.array_contains(said, w), 2).when(F.contains(T.unaccent(description), F.lit(w)), 1).otherwise(0)
        total += s
        if need:
            ok &= s > 0
    return F.when(ok, total).otherwise(0)


def line_sections(docs: DataFrame, size: int = 5) -> DataFrame:
    """Sections of `size` lines, a stand-in where no layout is known."""
    rows = lines_of(docs).withColumn("_s", F.floor((F.col("line_no") - 1) / size))
    return rows.groupBy("doc_id", "_s").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text")).drop("_s")


_TOK = "regexp_extract_all(lower(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))), '[\\p{L}\\p{N}]+')"


@query(f"with t as (select doc_id, {_TOK} as t from documents) select doc_id from t where (list_contains(t, 'license') and not list_contains(t, 'mit')) or contains(' ' || array_to_string(t, ' ') || ' ', ' creative commons ') or contains(' ' || array_to_string(t, ' ') || ' ', ' the apache ')")
def bool_search_and_or_not(spark: SparkSession, d: str) -> DataFrame:
    """T01-T03."""
    return load(spark, d, "documents").where(matches_text(F.col("text"), 'license -mit or "creative commons" or "the Apache"')).select("doc_id")


# -- the same measures as SQL, for checking ------------------------------------------------------



def _grams(tokens: str) -> str:
    """SQL: the trigrams of a list of words, in order, as hashes."""
    return f"flatten(list_transform({tokens}, lambda w: list_transform(range(1, length(w) + 2), lambda i: hash(substr('  ' || w || ' ', i, 3)))))"


def _similar(q: str, least: float = 0.0) -> str:
    """SQL: word similarity by its definition, over all extents between shared trigrams of a column g of _grams; 0
    where fewer are shared than `least` takes."""
    want, n = "[" + ", ".join(f"hash('{t}')" for t in sorted(P.trigrams(q))) + "]", len(P.trigrams(q))
    places = f"list_filter(range(1, len(g) + 1), lambda p: list_contains({want}, g[p]))"
    like = f"list_transform([list_distinct(s.g[a:z])], lambda e: len(list_intersect(e, {want})) / ({n} + len(e) - len(list_intersect(e, {want}))))[1]"
    of_start = f"list_max(list_transform(list_filter(s.p, lambda p: p >= a), lambda z: {like}))"
    every = f"list_transform([{{'g': g, 'p': {places}}}], lambda s: list_max(list_transform(s.p, lambda a: {of_start})))[1]"
    return f"case when len(list_intersect(list_distinct(g), {want})) <= {least * n - 1e-9} then 0 else coalesce({every}, 0) end"


def _covers(rows: str, key: str, q: str) -> str:
    """SQL: key and cover density of the rows' words (a table with columns key, text), for terms that are all wanted."""
    terms = wanted_terms(q)
    k_of = range(len(terms))
    last = ", ".join(f"max(case when w = '{t}' then i end) over x as p{k}, max(case when w = '{t}' then i - e end) over x as g{k}" for k, t in enumerate(terms))
    held = " and ".join(f"p{k} is not null" for k in k_of)
    low, gap = (f"least({', '.join(f'{c}{k}' for k in k_of)})" if len(terms) > 1 else f"{c}0" for c in "pg")
    words_ = f"select {key}, unnest(range(1, len(t) + 1)) as i, unnest(t) as w from (select {key}, {_TOK} as t from {rows})"
    kept = f"select *, row_number() over (partition by {key} order by i) as e from ({words_}) where w in ({', '.join(f"'{t}'" for t in terms)})"
    placed = f"select *, {last} from ({kept}) window x as (partition by {key} order by i)"
    covers = f"select {key}, start, min(i - e) - min(gap) as noise from (select *, {low} as start, {gap} as gap from ({placed}) where {held}) group by {key}, start"
    return f"(select {key}, sum(0.1::double / (1 + noise)) as rank from ({covers}) group by {key})"


_NORM = "trim(regexp_replace(lower(strip_accents(replace(replace({}, 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g'))"
_LINE_ROWS = "(select doc_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))"
_SECS = f"secs as (select doc_id || ':' || s as sec, doc_id, min(line_no) as first_line, max(line_no) as last_line, string_agg(line, chr(10) order by line_no) as text from (select *, (line_no - 1) // 5 as s from {_LINE_ROWS}) group by doc_id, s)"


def _section_sql(q: str, holds: str, top: int) -> str:
    """SQL: secs scored; holds is the boolean match over a word list t."""
    return f"{_SECS}, sc as (select *, case when {holds} then {_similar(q)} else {_similar(q, 0.6)} end as sim, {holds} as m, contains({_NORM.format('text')}, '{q.lower()}') as exact from (select *, {_grams('t')} as g from (select *, {_TOK} as t from secs))), rk as {_covers('secs', 'sec', q)}, hit as (select doc_id, first_line, last_line, round(coalesce(rank, 0) + case when exact then 0.5 * coalesce(rank, 0) else 0 end + 0.3 * sim, 6)::double as score from sc left join rk using (sec) where m or sim >= 0.6 order by score desc, doc_id, first_line, last_line limit {top})"


_QA, _QB, _QC = "licensed apache license", "Licenced under Apache", "MIT Licence text"


@query(f"with {_section_sql(_QA, ' and '.join(f"list_contains(t, '{w}')" for w in ('licensed', 'apache', 'license')), 50)} select * from hit")
def hybrid_section_rank(spark: SparkSession, d: str) -> DataFrame:
    """T06."""
    return section_hits(line_sections(load(spark, d, "documents")), _QA).drop("snippet")


def _line_sql(q: str, least: float) -> str:
    return f"select doc_id, line_no, line, round(score, 6)::double as score from (select doc_id, line_no, line, case when contains({_NORM.format('line')}, '{q.lower()}') then 1.0 else {_similar(q, least)} end as score from (select *, {_grams('t')} as g from (select *, {_TOK.replace('text', 'line')} as t from {_LINE_ROWS}))) where score >= {least}"


@query(f"select doc_id, line_no, score from ({_line_sql(_QB, 0.6)})")
def trigram_word_similarity(spark: SparkSession, d: str) -> DataFrame:
    """T05, T07."""
    return line_hits(lines_of(load(spark, d, "documents")), _QB, 0.6).select("doc_id", "line_no", F.round("score", 6).alias("score"))


_MIT = "MIT License"
_GRAM_LINES = f"(select *, {_grams('t')} as g from (select *, {_TOK.replace('text', 'line')} as t from {_LINE_ROWS}))"
_BEST = f"""best as (select doc_id, line_no, score + ls as score from (
    select *, row_number() over (partition by doc_id, first_line order by ls desc, line_no) as n from (
      select h.doc_id, h.first_line, l.line_no, h.score, case when contains({_NORM.format('line')}, 'mit license') then 1.0 else {_similar(_MIT)} end as ls
      from hit h join {_GRAM_LINES} l on l.doc_id = h.doc_id and l.line_no between first_line and last_line)) where n <= 3)"""


@query(f"with {_section_sql(_MIT, "list_contains(t, 'mit') and list_contains(t, 'license')", 50)}, {_BEST} select doc_id, line_no, round(max(score), 6)::double as score from best group by 1, 2 order by 3 desc, 1, 2 limit 10")
def keyword_search_lines(spark: SparkSession, d: str) -> DataFrame:
    """By sections."""
    docs = load(spark, d, "documents")
    return keyword_search(line_sections(docs), lines_of(docs), _MIT)


_CODE = "Lizensed undr Apachy Licenss"


@query(f"select doc_id, line_no, score from ({_line_sql(_CODE, 0.5)}) order by score desc, doc_id, line_no limit 20")
def keyword_search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A misspelt query no section matches; lines are searched by trigrams instead."""
    docs = load(spark, d, "documents")
    return keyword_search(line_sections(docs), lines_of(docs), _CODE, 20)


@query(f"select doc_id, (line_no - 1) // 5 + 1 as page_no, max(score) as best, string_agg(line_no::varchar, ',' order by line_no) as lines from ({_line_sql(_QC, 0.4)}) group by 1, 2")
def find_in_document(spark: SparkSession, d: str) -> DataFrame:
    """Hits grouped by page (five lines each)."""
    hits = line_hits(lines_of(load(spark, d, "documents")), _QC, 0.4).withColumn("page_no", F.expr("(line_no - 1) div 5 + 1"))
    return by_page(hits).select("doc_id", "page_no", F.round("best", 6).alias("best"), F.array_join(F.transform("hits", lambda h: h["line_no"].cast("string")), ",").alias("lines"))


_TURNS = "(select conv_id || ':' || turn as sec, conv_id as doc_id, turn as page_no, coalesce(text, '') as text from conversations)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"with p as {_TURNS}, t as (select *, {_TOK} as t from p), rk as {_covers('p', 'sec', 'the of')} select doc_id, page_no, round(coalesce(rank, 0), 6)::double as rank from t left join rk using (sec) where list_contains(t, 'the') and list_contains(t, 'of')")
def page_search(spark: SparkSession, d: str) -> DataFrame:
    """T08, T04."""
    return page_ranks(_turns(spark, d), "the of")


@query(f"with p as {_TURNS}, cards as (select doc_id as sec, doc_id, text from p where page_no = 0), ck as {_covers('cards', 'sec', 'the of')}, t as (select *, {_TOK} as t from p), rk as {_covers('p', 'sec', 'the of')}, b as (select doc_id, max(rank) as page_rank from t join rk using (sec) where list_contains(t, 'the') and list_contains(t, 'of') group by 1) select c.doc_id, round(2 * coalesce(ck.rank, 0) + coalesce(round(page_rank, 6), 0), 6)::double as score from cards c left join ck on ck.sec = c.doc_id left join b on b.doc_id = c.doc_id order by score desc, c.doc_id desc limit 20")
def document_rank(spark: SparkSession, d: str) -> DataFrame:
    """First turns as cards, later conversations first."""
    turns = _turns(spark, d)
    cards = turns.where("page_no = 0").select("doc_id", F.col("text").alias("card"), F.col("doc_id").alias("created_at"))
    return document_ranks(cards, turns, "the of", 20).select("doc_id", "score")


@query(f"with {_section_sql(_QA, ' and '.join(f"list_contains(t, '{w}')" for w in ('licensed', 'apache', 'license')), 50)}, pg as (select doc_id, score, first_line, unnest(range(first_line, last_line + 1)) as page_no from hit), f as (select doc_id, page_no, max(score) as score, min(first_line) as s from pg group by 1, 2), n as (select *, row_number() over (partition by doc_id order by score desc, s, page_no) as n from f) select doc_id, string_agg(page_no::varchar, ',' order by page_no) as pages from n where n <= 8 group by 1")
def keyword_hint_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for pages."""
    hits = section_hits(line_sections(load(spark, d, "documents")), _QA).withColumnsRenamed({"first_line": "page_start", "last_line": "page_end"})
    return keyword_hints(hits).select("doc_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


_TAILS = f"l as {_LINE_ROWS}, q as (select doc_id, right(a.line, 12) || ' ' || left(b.line, 12) as quote from l a join l b using (doc_id) where a.line_no = 1 and b.line_no = 2 union all select doc_id, arg_min(line, (-length(line), line_no)) from l group by 1), n as (select doc_id, line_no, line as w1, line || ' ' || lead(line) over w as w2, line || ' ' || lead(line) over w || ' ' || lead(line, 2) over w as w3, line || ' ' || lead(line) over w || ' ' || lead(line, 2) over w || ' ' || lead(line, 3) over w as w4 from l window w as (partition by doc_id order by line_no))"


@query(f"with {_TAILS}, m as (select q.doc_id, quote, n.line_no, case when contains({_NORM.format('w1')}, nq) then 1 when contains({_NORM.format('w2')}, nq) then 2 when contains({_NORM.format('w3')}, nq) then 3 when contains({_NORM.format('w4')}, nq) then 4 end as size from (select *, {_NORM.format('quote')} as nq from q) q join n using (doc_id)) select doc_id, md5(quote) as quote, arg_min(line_no, (size, line_no)) as first_line, arg_min(line_no, (size, line_no)) + min(size) - 1 as last_line from m where size is not null group by doc_id, quote")
def quote_verification(spark: SparkSession, d: str) -> DataFrame:
    """Every document's longest line, and a quote that runs from its first line into the second."""
    lines = lines_of(load(spark, d, "documents"))
    longest = lines.groupBy("doc_id").agg(F.min_by("line", F.struct(-F.length("line"), "line_no")).alias("quote"))
    first, second = lines.where("line_no = 1"), lines.where("line_no = 2").select("doc_id", F.col("line").alias("next"))
    across = first.join(second, "doc_id").select("doc_id", F.concat(F.right("line", F.lit(12)), F.lit(" "), F.left("next", F.lit(12))).alias("quote"))
    found = verify_quotes(lines, longest.unionByName(across).distinct())
    return found.select("doc_id", F.md5("quote").alias("quote"), "first_line", "last_line")


@query("select p_partkey, (case when list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'part') then 10 when contains(lower(p_name), 'part') then 5 else 0 end + case when list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), 'part') then 2 when contains(lower(p_type), 'part') then 1 else 0 end + case when list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'std') then 10 when contains(lower(p_name), 'std') then 5 else 0 end + case when list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), 'std') then 2 when contains(lower(p_type), 'std') then 1 else 0 end)::int as score from part")
def tool_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", tool_score(F.col("p_name"), F.col("p_type"), "part std").alias("score"))
