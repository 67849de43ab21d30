"""Sections under a token budget, document trees, and tables of contents."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load

BLOCKS = "doc_id long, page_no int, block_no int, kind string, text string"
SECTIONS = "doc_id long, seq int, kind string, heading_path array<string>, page_start int, page_end int, tokens long, text string"


def tokens(s: str) -> int:
    return len(s) // 3 + 1 if s else 0


def split_table(md: str, budget: int) -> list[str]:
    """Row groups of a long pipe table, each under the table's own header."""
    rows = md.split("\n")
    if tokens(md) <= budget or not md.startswith("|") or len(rows) < 3:
        return [md]
    head = "\n".join(rows[:2])
    parts: list[list[str]] = []
    held = budget + 1
    for r in rows[2:]:
        if held + tokens(r) > budget or not parts:
            parts.append([])
            held = tokens(head)
        parts[-1].append(r)
        held += tokens(r)
    return ["\n".join([head, *p]) for p in parts]


def heading_level(md: str, kind: str) -> int:
    return 1 if kind == "title" else max(2, len(md) - len(md.lstrip("#")))


def chunk_document(blocks: Iterable[tuple[int, str, str]], budget: int) -> list[tuple]:
    """Sections of one document's blocks (page, kind, text) in order: (kind, heading path, first page, last page, tokens, text)."""
    out: list[tuple] = []
    path: list[tuple[int, str]] = []
    held: list[tuple[str, int, bool]] = []  # text, page, heading

    def close(kind: str = "text") -> None:
        if held:
            body = "\n\n".join(t for t, _, _ in held)
            out.append((kind, [h for _, h in path], held[0][1], held[-1][1], sum(tokens(t) for t, _, _ in held), body))
            held.clear()

    for page, kind, md in blocks:
        body = any(not h for _, _, h in held)
        if not md or kind in ("header", "footer", "page_number"):
            continue
        if kind in ("title", "heading"):
            close()
            level = heading_level(md, kind)
            path[:] = [p for p in path if p[0] < level] + [(level, md.lstrip("# ").strip())]
            held.append((md, page, True))
        elif kind == "table":
            if body:
                close()
            for part in split_table(md, budget):
                held.append((part, page, False))
                close("table")
        else:
            if body and sum(tokens(t) for t, _, _ in held) + tokens(md) > budget:
                close()
            held.append((md, page, False))
    close()
    return out


def sections(blocks: DataFrame, budget: int = 1500) -> DataFrame:
    """A stateful fold over each document's blocks; one shuffle, by document."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_no", "block_no"], kind="stable")
        made = chunk_document(zip(pdf["page_no"], pdf["kind"], pdf["text"]), budget)
        cols = ["kind", "heading_path", "page_start", "page_end", "tokens", "text"]
        out = pd.DataFrame(made, columns=cols)
        out.insert(0, "seq", range(len(made)))
        out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return out

    return blocks.groupBy("doc_id").applyInPandas(fold, SECTIONS)


def sections_of_rows(docs: DataFrame, budget: int = 1500) -> DataFrame:
    """W14, W15 where a row holds its document's blocks in order: no shuffle.
    docs: doc_id, blocks array<struct<page_no, kind, text>>."""

    def fold(batches):
        for b in batches:
            out: list[tuple] = []
            for d, blocks in zip(b.column("doc_id").to_pylist(), b.column("blocks").to_pylist()):
                made = chunk_document(((x["page_no"], x["kind"], x["text"]) for x in blocks), budget)
                out += [(d, seq, *row) for seq, row in enumerate(made)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "seq", "kind", "heading_path", "page_start", "page_end", "tokens", "text"])

    return docs.select("doc_id", "blocks").mapInArrow(fold, SECTIONS)


def tree(nodes: DataFrame, levels: int = 9) -> DataFrame:
    """Headings in order to a tree, by windows instead of a stack.

    nodes: doc_id, ord, level (1 to `levels`), title, tokens (not null). A node's parent is the nearest node
    before it with a lower level (-1, the root, otherwise). Adds parent, depth, the path of ords, short ids in
    breadth-first order, and subtree tokens. One shuffle, by document, of rows without text bodies.
    """
    by = Window.partitionBy("doc_id")
    before = by.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    behind = by.orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    every = range(1, levels + 1)
    rows = nodes.withColumn("_ahead", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("_all", F.sum("tokens").over(by))
    at = {k: F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(before) for k in every}
    rows = rows.select("*", *[c.alias(f"_l{k}") for k, c in at.items()])
    # the next node of a level ends the subtrees of that level and of all below it
    rows = rows.select("*", *[F.last(F.when(F.col("level") == k, F.col("_ahead")), ignorenulls=True).over(behind).alias(f"_n{k}") for k in every])
    # ancestors are the levels whose last node stands later than those of all levels above
    higher: Column = F.lit(-1)
    chain = []
    for k in every:
        last = F.col(f"_l{k}")
        chain.append(F.when((F.col("level") > k) & (last > higher), last))
        higher = F.greatest(higher, F.coalesce(last, F.lit(-1)))
    path = F.array_append(F.array_compact(F.array(*chain)), F.col("ord"))
    end = F.array_min(F.array_compact(F.array(F.col("_all"), *[F.when(F.col("level") >= k, F.col(f"_n{k}")) for k in every])))
    out = rows.select("doc_id", "ord", "title", "tokens", path.alias("path"), (end - F.col("_ahead")).cast("bigint").alias("subtree_tokens"))
    out = out.withColumn("depth", F.size("path")).withColumn("parent", F.coalesce(F.try_element_at("path", F.lit(-2)), F.lit(-1)))
    short_id = F.concat(F.lit("n"), F.row_number().over(by.orderBy("depth", "path")).cast("string"))
    return out.select("doc_id", "ord", "parent", "depth", short_id.alias("short_id"), "title", "tokens", "subtree_tokens", "path")


def deepest(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """For every page the deepest node whose range holds it; ties to the earlier node.
    nodes: doc_id, ord, depth, page_start, page_end."""
    met = pages.join(nodes, "doc_id").where((F.col("page_no") >= F.col("page_start")) & (F.col("page_no") <= F.col("page_end")))
    return met.groupBy("doc_id", "page_no").agg(F.max_by("ord", F.struct("depth", -F.col("ord"))).alias("node"))


def table_of_contents(nodes: DataFrame, budget: int = 4_000) -> DataFrame:
    """An indented outline a document; the deepest levels go until it fits the budget."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.col("short_id"), F.lit(" "), F.col("title"))
    by_depth = nodes.groupBy("doc_id", "depth").agg(F.sum(F.length(line) + 1).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("depth")
    fits = by_depth.withColumn("upto", F.sum("n").over(w)).where((F.floor(F.col("upto") / 3) + 1 <= budget) | (F.col("depth") == 1)).groupBy("doc_id").agg(F.max("depth").alias("shown"))
    kept = nodes.join(fits, "doc_id").where("depth <= shown").withColumn("line", line)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "\n").alias("toc"), F.count(F.lit(1)).alias("nodes"))


def blocks_of_text(docs: DataFrame) -> DataFrame:
    """Lines as blocks, a stand-in where no layout is known: short lines are headings, pipe lines tables."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return rows.select("doc_id", F.lit(1).alias("page_no"), "block_no", block_kind(F.col("text"), F.col("block_no")).alias("kind"), "text")


def block_kind(line: Column, no: Column) -> Column:
    return F.when(F.contains(line, F.lit(" | ")), "table").when((F.length(line) < 40) & (no == 0), "title").when(F.length(line) < 40, "heading").otherwise("paragraph")


_B = "b0 as (select doc_id, unnest(range(0, len(l))) as no, unnest(l) as t from (select doc_id, string_split(text, chr(10)) as l from documents)), b1 as (select *, case when contains(t, ' | ') then 'table' when length(t) < 40 and no = 0 then 'title' when length(t) < 40 then 'heading' else 'paragraph' end as kind, length(t) // 3 + 1 as tok from b0 where t <> ''), b as (select *, row_number() over (partition by doc_id order by no) as i from b1)"


@query(
    f"with recursive {_B}, "
    "f as (select doc_id, i, 0 as seq, tok as held, kind not in ('title', 'heading') as body, kind = 'table' as done, kind = 'title' as titled, kind = 'heading' as headed, kind, t, tok from b where i = 1 "
    "union all select n.doc_id, n.i, f.seq + s.new::int, case when s.new then n.tok else f.held + n.tok end, (not s.new and f.body) or n.kind not in ('title', 'heading'), n.kind = 'table', f.titled or n.kind = 'title', f.headed or n.kind = 'heading', n.kind, n.t, n.tok "
    "from f join b n on n.doc_id = f.doc_id and n.i = f.i + 1, lateral (select f.done or n.kind in ('title', 'heading') or (f.body and (n.kind = 'table' or f.held + n.tok > 400)) as new) s) "
    "select doc_id, seq, case when bool_or(kind = 'table') then 'table' else 'text' end as kind, (max(titled::int) + max(headed::int))::int as depth, sum(tok)::bigint as tokens, md5(string_agg(t, chr(10) || chr(10) order by i)) as digest from f group by doc_id, seq"
)
def sections_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks, folded to sections of at most 400 tokens inside their own row."""
    docs = load(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.lit(1).alias("page_no"), block_kind(t, i).alias("kind"), t.alias("text")))
    made = sections_of_rows(docs.select("doc_id", lines.alias("blocks")), 400)
    return made.select("doc_id", "seq", "kind", F.size("heading_path").alias("depth"), "tokens", F.md5("text").alias("digest"))


def _headings(spark: SparkSession, d: str) -> DataFrame:
    b = blocks_of_text(load(spark, d, "documents")).where("kind in ('title', 'heading') and text <> ''")
    level = F.when(F.col("kind") == "title", 1).otherwise(2 + F.length("text") % 3)
    return b.select("doc_id", F.col("block_no").alias("ord"), level.alias("level"), "text", T.estimate_tokens(F.col("text")).alias("tokens")).withColumnRenamed("text", "title")


_H = "h as (select doc_id, ord, case when ord = 0 then 1 else 2 + length(title) % 3 end as level, title, length(title) // 3 + 1 as tokens from (select doc_id, unnest(range(0, len(l))) as ord, unnest(l) as title from (select doc_id, string_split(text, chr(10)) as l from documents)) where length(title) between 1 and 39 and not contains(title, ' | '))"


_TREE = f"{_H}, p as (select a.*, coalesce((select max(b.ord) from h b where b.doc_id = a.doc_id and b.ord < a.ord and b.level < a.level and not exists (select 1 from h c where c.doc_id = a.doc_id and c.ord < a.ord and c.ord > b.ord and c.level < a.level)), -1) as parent from h a), c as (select doc_id, ord, ord as anc, parent, [ord] as path from p union all select c.doc_id, c.ord, p.ord, p.parent, list_prepend(p.ord, c.path) from c join p on p.doc_id = c.doc_id and p.ord = c.parent), s as (select c.doc_id, c.anc as ord, sum(p.tokens)::bigint as subtree_tokens from c join p on p.doc_id = c.doc_id and p.ord = c.ord group by 1, 2), dp as (select doc_id, ord, count(*)::int as depth, max(path) filter (where parent = -1) as path from c group by 1, 2), tr as (select p.doc_id, p.ord::int as ord, p.parent::int as parent, dp.depth, s.subtree_tokens, p.title, 'n' || row_number() over (partition by p.doc_id order by dp.depth, dp.path) as short_id from p join s using (doc_id, ord) join dp using (doc_id, ord))"


@query(f"with recursive {_TREE} select doc_id, ord, parent, depth, subtree_tokens, short_id from tr")
def doc_tree(spark: SparkSession, d: str) -> DataFrame:
    return tree(_headings(spark, d)).select("doc_id", "ord", "parent", "depth", "subtree_tokens", "short_id")


_LINE = "repeat('  ', depth - 1) || short_id || ' ' || title"


@query(f"with recursive {_TREE}, w as (select doc_id, depth, sum(sum(length({_LINE}) + 1)) over (partition by doc_id order by depth) as upto from tr group by 1, 2), f as (select doc_id, max(depth) as shown from w where upto // 3 + 1 <= 200 or depth = 1 group by 1) select doc_id, string_agg({_LINE}, chr(10) order by ord) as toc, count(*) as nodes from tr join f using (doc_id) where depth <= shown group by doc_id")
def case_toc(spark: SparkSession, d: str) -> DataFrame:
    """Every document's outline within 200 tokens."""
    return table_of_contents(tree(_headings(spark, d)), 200)


def with_ranges(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """page_start, page_end of nodes that know their first page: up to the page before the next node of the
    same or a higher level, their own page at least. nodes: tree rows, level, page_start; pages: doc_id, page_count."""
    levels = range(1, 10)
    behind = Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.array_min(F.array_compact(F.array(*[F.when(F.col("level") >= k, F.last(F.when(F.col("level") == k, F.col("page_start")), ignorenulls=True).over(behind)) for k in levels])))
    return nodes.join(pages, "doc_id").withColumn("page_end", F.greatest(F.col("page_start"), F.coalesce(after - 1, F.col("page_count")))).drop("page_count")


def render(nodes: DataFrame) -> DataFrame:
    """A document's outline, a line a node: [id] title (p. a–b), indented by depth.
    nodes: doc_id, ord, depth, short_id, title, page_start, page_end."""
    pages = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat(F.col("page_start").cast("string"), F.lit("–"), F.col("page_end").cast("string")))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("["), "short_id", F.lit("] "), "title", F.lit(" (p. "), pages, F.lit(")"))
    rows = nodes.select("doc_id", F.struct("ord", line.alias("line")).alias("r"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("outline"))


def node_paths(nodes: DataFrame) -> DataFrame:
    """Titles from the top to each node, joined by ›. nodes: doc_id, ord, title, path."""
    titles = nodes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", "title"))).alias("_t"))
    return nodes.join(titles, "doc_id").withColumn("section", F.array_join(F.transform("path", lambda o: F.col("_t")[o]), " › ")).drop("_t")


def _pages_of_lines(nodes: DataFrame) -> DataFrame:
    """Nodes with pages of eight lines."""
    return nodes.withColumn("page_start", (F.floor(F.col("ord") / 8) + 1).cast("int"))


_RANGES = "pc as (select doc_id, ((len(string_split(text, chr(10))) - 1) // 8 + 1)::int as page_count from documents), lv as (select h.doc_id, h.ord, h.level, (h.ord // 8 + 1)::int as page_start from h), rg as (select a.*, greatest(a.page_start, coalesce((select min_by(b.page_start, b.ord) from lv b where b.doc_id = a.doc_id and b.ord > a.ord and b.level <= a.level) - 1, pc.page_count))::int as page_end from lv a join pc using (doc_id))"


def _ranged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    heads = _headings(spark, d)
    counts = load(spark, d, "documents").select("doc_id", (F.floor((F.size(F.split("text", "\n")) - 1) / 8) + 1).cast("int").alias("page_count"))
    nodes = _pages_of_lines(tree(heads).join(heads.select("doc_id", "ord", "level"), ["doc_id", "ord"]))
    return with_ranges(nodes, counts), counts


@query(f"with recursive {_TREE}, {_RANGES} select doc_id, md5(string_agg(repeat('  ', depth - 1) || '[' || short_id || '] ' || title || ' (p. ' || case when page_start = page_end then page_start::varchar else page_start || '–' || page_end end || ')', chr(10) order by ord)) as digest from tr join rg using (doc_id, ord) group by doc_id")
def tree_render(spark: SparkSession, d: str) -> DataFrame:
    """Outlines with page ranges."""
    return render(_ranged(spark, d)[0]).select("doc_id", F.md5("outline").alias("digest"))


@query(f"with recursive {_TREE}, {_RANGES}, pg as (select doc_id, unnest(range(1, page_count + 1))::int as page_no from pc), m as (select pg.doc_id, page_no, arg_max(tr.ord, (depth, -tr.ord)) as node from pg join rg on rg.doc_id = pg.doc_id and page_no between page_start and page_end join tr on tr.doc_id = rg.doc_id and tr.ord = rg.ord group by 1, 2), nm as (select p.doc_id, p.ord, string_agg(q.title, ' › ' order by q.ord) as section from (select doc_id, ord, unnest(path) as o from dp) p join h q on q.doc_id = p.doc_id and q.ord = p.o group by 1, 2) select m.doc_id, page_no, node::int as node, section from m join nm on nm.doc_id = m.doc_id and nm.ord = m.node")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every page's deepest node and its path."""
    nodes, counts = _ranged(spark, d)
    pages = counts.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
    met = deepest(nodes, pages)
    named = node_paths(nodes).select("doc_id", F.col("ord").alias("node"), "section")
    return met.join(named, ["doc_id", "node"]).select("doc_id", "page_no", "node", "section")
