"""Writes with relational meaning, lookups over versions, codes and citations, and budgeted batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load


def transition(rows: DataFrame, changes: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """A row takes its new status when the generation still holds and the step is allowed.
    rows: key, gen, status; changes: key, gen, next (at most one a key)."""
    ok = F.lit(False)
    for old, new in allowed.items():
        ok |= (F.col("status") == old) & F.col("next").isin(new)
    met = rows.join(changes.select(key, F.col("gen").alias("_g"), "next"), key, "left")
    good = F.coalesce((F.col("gen") == F.col("_g")) & ok, F.lit(False))
    return met.withColumn("changed", good).withColumn("status", F.when(F.col("changed"), F.col("next")).otherwise(F.col("status"))).drop("_g", "next")


def purge(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent is there and not deleted."""
    return children.join(parents.where(F.col("deleted_at").isNull()).select(key), key, "left_semi")


def replace_proposals(segments: DataFrame, proposals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A document's old proposals go for the new ones apart from the user's segments; other documents stay.
    Both: doc, page_start, page_end, source (user or proposal), label."""
    docs = proposals.select(doc).distinct()
    kept = segments.where("source = 'user'").unionByName(segments.where("source <> 'user'").join(docs, doc, "left_anti"))
    u, p = segments.where("source = 'user'").alias("u"), proposals.alias("p")
    meet = (F.col(f"u.{doc}") == F.col(f"p.{doc}")) & (F.col("u.page_end") >= F.col("p.page_start")) & (F.col("u.page_start") <= F.col("p.page_end"))
    return kept.unionByName(p.join(u, meet, "left_anti").select(*segments.columns))


def batches(items: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Greedy fill in order: an item that would pass the budget starts the next batch. One ordered fold
    over a document's own pages."""
    rows = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("x"))
    start = F.struct(F.array().cast(f"array<struct<{order}:bigint,batch:int>>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("held"))

    def step(acc, x):
        new = (acc["held"] > 0) & (acc["held"] + x[size] > budget)
        batch = acc["batch"] + new.cast("int")
        held = F.when(new, x[size].cast("bigint")).otherwise(acc["held"] + x[size])
        return F.struct(F.array_append(acc["out"], F.struct(x[order].cast("bigint").alias(order), batch.alias("batch"))).alias("out"), batch.alias("batch"), held.alias("held"))

    return rows.select(key, F.inline(F.aggregate("x", start, step)["out"]))


def replaced_value(values: DataFrame, slot: list[str], order: str) -> DataFrame:
    """For a slot's current value the last value of the agent before it, and whether they differ by key.
    values: slot..., order, source (agent or user), value."""
    w = Window.partitionBy(*slot).orderBy(order)
    before = F.last(F.when(F.col("source") == "agent", F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = values.withColumn("agent_value", before).withColumn("_n", F.row_number().over(Window.partitionBy(*slot).orderBy(F.desc(order)))).where("_n = 1")
    edited = (F.col("source") == "user") & F.col("agent_value").isNotNull() & (T.value_key(F.col("value")) != T.value_key(F.col("agent_value")))
    return rows.select(*slot, "value", "source", F.when(F.col("source") == "user", F.col("agent_value")).alias("agent_value"), F.coalesce(edited, F.lit(False)).alias("edited"))


def resolve_codes(codes: DataFrame, cases: DataFrame, normalisers: list[tuple[str, object]]) -> DataFrame:
    """F16: a raw code under each case type's way of writing it, in order; the first type with such a case
    of its own wins. codes: raw; cases: case_id, case_type, code, closed."""
    tried = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(t).alias("case_type"), f(F.col("raw")).alias("code")) for i, (t, f) in enumerate(normalisers)])
    wide = codes.select("raw", F.inline(tried))
    met = wide.join(cases, ["case_type", "code"])
    best = met.groupBy("raw").agg(F.min_by(F.struct("case_id", "case_type", "closed"), F.struct("priority", "case_id")).alias("c"))
    return best.select("raw", "c.case_id", "c.case_type", (~F.col("c.closed")).alias("accepts_files"))


def rewrite_citations(text: Column, refs: Column) -> Column:
    """Doc:d<n>[.n<k>]: becomes doc:<id>: by a map from d<n> to ids; unknown ones stay."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"doc:(d\d+)(?:\.n\d+)?:")))
    return F.aggregate(found, text, lambda acc, ref: F.when(F.map_contains_key(refs, ref), F.regexp_replace(acc, F.concat(F.lit("doc:"), ref, F.lit(r"(?:\.n\d+)?:")), F.concat(F.lit("doc:"), F.try_element_at(refs, ref), F.lit(":")))).otherwise(acc))


def effective_dpi(width_pt: Column, height_pt: Column, dpi: int = 300, side: int = 10_000, pixels: int = 40_000_000) -> Column:
    """The resolution after caps on the longer side and the area, 36 at least."""
    longest, area = F.greatest(width_pt, height_pt) / 72, width_pt * height_pt / (72 * 72)
    return F.greatest(F.floor(F.least(F.lit(float(dpi)), side / longest, F.sqrt(pixels / area))), F.lit(36)).cast("int")


def locate(spans: DataFrame, lines: DataFrame, dpi: Column) -> DataFrame:
    """Boxes, in pixels and points, of the lines that a Markdown range touches.
    spans: doc_id, page_no, a, b; lines: doc_id, page_no, line_no, md_start, md_end, x0, y0, x1, y1."""
    met = spans.join(lines, ["doc_id", "page_no"]).where((F.col("md_start") < F.col("b")) & (F.col("md_end") > F.col("a")))
    return met.select("doc_id", "page_no", "line_no", "x0", "y0", "x1", "y1", *[(F.col(c) * 72 / dpi).alias(f"{c}_pt") for c in ("x0", "y0", "x1", "y1")])


@query("with c as (select o_orderkey, case when o_orderpriority = '1-URGENT' then 2 else 1 end as gen, 'F' as next from orders where o_orderstatus <> 'F') select o.o_orderkey, case when c.gen = 1 and o.o_orderstatus = 'O' then 'F' else o.o_orderstatus end as status, coalesce(c.gen = 1 and o.o_orderstatus = 'O', false) as changed from orders o left join c using (o_orderkey)")
def guarded_transition(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", F.lit(1).alias("gen"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    c = o.where("status <> 'F'").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(1).alias("gen"), F.lit("F").alias("next"))
    return transition(o.drop("o_orderpriority"), c, "o_orderkey", {"O": ["F"]}).select("o_orderkey", "status", "changed")


@query("select l_orderkey, l_linenumber from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'F')")
def cascade_purge(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", F.lit("gone")).alias("deleted_at"))
    return purge(o, load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@query("with recursive t as (select conv_id, turn, (strlen(coalesce(text, '')) + 3) // 4 as n, row_number() over (partition by conv_id order by turn) as k from conversations), r as (select conv_id, turn, k, n::bigint as held, 0 as batch from t where k = 1 union all select t.conv_id, t.turn, t.k, case when r.held > 0 and r.held + t.n > 100 then t.n else r.held + t.n end, case when r.held > 0 and r.held + t.n > 100 then r.batch + 1 else r.batch end from r join t on t.conv_id = r.conv_id and t.k = r.k + 1) select conv_id, turn, batch::int as batch from r")
def budgeted_batches(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "conversations").select("conv_id", "turn", T.history_tokens(F.coalesce("text", F.lit(""))).alias("n"))
    return batches(t, "conv_id", "turn", "n", 100)


@query("with v as (select user_id, event_id, ts, case when event_type in ('purchase', 'signup') then 'user' else 'agent' end as source, event_type as value from events), a as (select *, last_value(case when source = 'agent' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as av, row_number() over (partition by user_id order by event_id desc) as n from v) select user_id, value, source, case when source = 'user' then av end as agent_value, source = 'user' and av is not null and av <> value as edited from a where n = 1")
def replaced_agent_value(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("purchase", "signup"), "user").otherwise("agent").alias("source"), F.col("event_type").alias("value"))
    return replaced_value(v, ["user_id"], "event_id")


@query("with c as (select c_custkey as case_id, case when c_mktsegment = 'BUILDING' then 'site' else 'plain' end as case_type, upper(c_name) as code, c_acctbal < 0 as closed from customer) select c_name as raw, c_custkey as case_id, case when c_mktsegment = 'BUILDING' then 'site' else 'plain' end as case_type, c_acctbal >= 0 as accepts_files from customer")
def case_code_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "site").otherwise("plain")
    code = F.when(kind == "site", F.upper("c_name")).otherwise(F.lower("c_name"))
    cases = c.select(F.col("c_custkey").alias("case_id"), kind.alias("case_type"), code.alias("code"), (F.col("c_acctbal") < 0).alias("closed"))
    return resolve_codes(c.select(F.col("c_name").alias("raw")), cases, [("plain", lambda x: F.lower(F.trim(x))), ("site", lambda x: F.upper(F.trim(x)))])


@query("select o_orderkey, 'see doc:' || o_custkey || ':p1:l2 and doc:' || o_custkey || ':p3:l4, not doc:d9:p1:l1' as text from orders")
def citation_rewrite(spark: SparkSession, d: str) -> DataFrame:
    refs = F.create_map(F.lit("d1"), F.col("o_custkey").cast("string"))
    said = F.lit("see doc:d1:p1:l2 and doc:d1.n7:p3:l4, not doc:d9:p1:l1")
    return load(spark, d, "orders").select("o_orderkey", rewrite_citations(said, refs).alias("text"))


@query("select p_partkey, greatest(floor(least(300.0, 10000 / (greatest(p_size * 40.0, p_retailprice) / 72), sqrt(40000000 / ((p_size * 40.0) * p_retailprice / 5184)))), 36)::int as dpi from part")
def effective_dpi_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", effective_dpi(F.col("p_size") * 40.0, F.col("p_retailprice")).alias("dpi"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * 72 / 150, 6) as x1_pt from lineitem where l_linenumber * 10 < 35 and l_linenumber * 10 + 9 > 15")
def locate_markdown_range(spark: SparkSession, d: str) -> DataFrame:
    """Characters 15 to 35 of every order's page; each line takes ten."""
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("line_no"), (F.col("l_linenumber") * 10).alias("md_start"), (F.col("l_linenumber") * 10 + 9).alias("md_end"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("l_extendedprice").alias("x1"), F.lit(1.0).alias("y1"))
    spans = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(15).alias("a"), F.lit(35).alias("b"))
    out = locate(spans, lines, F.lit(150))
    return out.select(F.col("doc_id").alias("l_orderkey"), F.col("line_no").alias("l_linenumber"), F.round("x1_pt", 6).alias("x1_pt"))


@query("with latest as (select o_custkey, max_by(o_orderkey, o_orderdate) as k from orders group by 1) select c_custkey, n.unnest as word from customer, unnest(string_split(lower(c_mktsegment) || ',' || c_nationkey::varchar, ',')) n where c_custkey in (select o_custkey from orders)")
def lateral_unnest(spark: SparkSession, d: str) -> DataFrame:
    """Arrays opened beside their rows, for customers that have orders."""
    c = load(spark, d, "customer")
    some = c.join(load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return some.select("c_custkey", F.explode(F.split(F.concat_ws(",", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")), ",")).alias("word"))
