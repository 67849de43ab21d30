"""Running rulesets: documents linked to anchors, formulas evaluated per anchor, verdicts counted."""

from __future__ import annotations

import json
import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load
from .checks import Scope, compile_check, ruleset


def grouped(docs: DataFrame, anchor: str, fields: list[str], name: str) -> DataFrame:
    """One row an anchor: its documents of a type as an array. Only what formulas read is gathered."""
    made = F.struct(*fields)
    return docs.groupBy(anchor).agg(F.array_sort(F.collect_list(made)).alias(name))


def link(pairs: DataFrame, doc: str, anchor: str, steps: list[Column]) -> DataFrame:
    """Rule-based linkage over candidate pairs: a step keeps the anchors that pass, else the unknown
    ones, else none; a document with one anchor left is settled. Each step is one window pass."""
    w = Window.partitionBy(doc)
    left = pairs
    for step in steps:
        left = left.withColumn("_s", step)
        left = left.withColumn("_pass", F.max(F.coalesce("_s", F.lit(False)).cast("int")).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
        keep = F.when(F.col("_n") == 1, F.coalesce("_s", F.lit(True))).when(F.col("_pass") == 1, F.coalesce("_s", F.lit(False))).otherwise(F.col("_s").isNull())
        left = left.where(keep).drop("_s", "_pass", "_n")
    counted = left.withColumn("_n", F.count(F.lit(1)).over(w))
    return counted.where("_n = 1").drop("_n")


def run(anchors: DataFrame, key: str, scope: Scope, rules: dict[str, str]) -> DataFrame:
    """A row for each anchor and rule: status and missing fields, in one select."""
    made = []
    for name, formula in rules.items():
        made.append(F.struct(F.lit(name).alias("rule"), compile_check(formula, scope)["result"].alias("r")))
    return anchors.select(key, F.inline(F.array(*made))).select(key, "rule", "r.status", "r.missing")


def counts(verdicts: DataFrame) -> DataFrame:
    """A19."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return verdicts.groupBy("rule").agg(n("pass"), n("fail"), n("unknown"), F.count(F.lit(1)).alias("groups"))


def with_overrides(verdicts: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """A user's verdict for an anchor and rule wins over the computed one, which stays beside it.
    overrides: key, rule, status, note."""
    own = overrides.select(key, "rule", F.col("status").alias("_own"), "note")
    return verdicts.join(own, [key, "rule"], "left").select(key, "rule", F.coalesce("_own", "status").alias("status"), F.col("status").alias("computed"), F.col("_own").isNotNull().alias("overridden"), "note")


def compared_rows(anchors: DataFrame, key: str, scope: Scope, formula: str, group: str, field: str, other: Column) -> DataFrame:
    """The formula of each document of a group alone, beside the value it is compared with.
    A row a document: key, label, value_a, value_b, status."""
    one = F.col("_one")
    alone = Scope(scope.types, scope.single, {**scope.groups, group: F.array(one)}, **({"today": scope.today} if scope.today is not None else {}))
    status = compile_check(formula, alone)["status"]
    return anchors.withColumn("_one", F.explode(scope.groups[group])).select(key, one["label"].alias("label"), one[field].cast("string").alias("value_a"), other.cast("string").alias("value_b"), status.alias("status"))


def evidence(compared: DataFrame, key: str) -> DataFrame:
    """Per anchor the failing documents with a note each, and how many documents the verdict rests on."""
    note = F.concat("label", F.lit(": "), F.coalesce("value_a", F.lit("nothing")), F.lit(" against "), F.coalesce("value_b", F.lit("nothing")))
    failing = F.sort_array(F.collect_list(F.when(F.col("status") == "fail", F.struct("label", note.alias("note")))))
    return compared.groupBy(key).agg(failing.alias("failing"), F.count(F.lit(1)).alias("documents"))


def totals(compared: DataFrame, key: str) -> DataFrame:
    """The sum of a rule's left side by anchor."""
    return compared.groupBy(key).agg(F.sum(T.parse_number(F.col("value_a"))).alias("total_a"), F.max("value_b").alias("value_b"))


def hint(status: Column, what: str, operator: str, against: str) -> Column:
    """What to do about a failing rule."""
    return F.when(status == "fail", F.lit(f"{what} of the marked documents: not {operator} {against}. Open the page: correct the value where it was misread, else clear the difference with the customer."))


ORDER_TYPES = {
    "order": {"total": "decimal", "day": "day", "status": "string", "priority": "string"},
    "line": {"price": "decimal", "ship": "day", "flag": "string", "state": "string"},
}


def _orders(spark: SparkSession, d: str, *formulas: str, labels: bool = False) -> tuple[DataFrame, Scope]:
    """Orders as anchors, their lines as the group, with the fields the formulas read, in their own types (money in
    cents); labels only where a formula names the group itself, or they are asked for."""
    fields = {f for x in formulas for f in re.findall(r"\bline\.(\w+)", x)}
    labels = labels or any(re.search(r"\bline\b(?!\.)", x) for x in formulas)
    cents = lambda c: F.col(c).cast("decimal(18,2)")
    lines = load(spark, d, "lineitem").select(
        "l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("label"), cents("l_extendedprice").alias("price"),
        F.col("l_shipdate").cast("date").alias("ship"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
    )
    by = grouped(lines, "l_orderkey", [*["label"][: labels], *(f for f in ("price", "ship", "flag", "state") if f in fields or not (fields or labels) and f == "flag")], "line")
    order = F.struct(
        F.col("o_orderkey").cast("string").alias("label"), cents("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )
    rows = load(spark, d, "orders").select("o_orderkey", order.alias("order")).join(by, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.withColumn("line", F.coalesce("line", F.array().cast(by.schema["line"].dataType)))
    return rows, Scope(ORDER_TYPES, {"order": ("order", F.col("order"))}, {"line": F.col("line")})


_SUMS = "with l as (select l_orderkey, sum(round(l_extendedprice, 2)) as s, count(*) as n, min(l_shipdate::date) as first_ship, max(l_shipdate::date) as last_ship, count(distinct l_linestatus) as states, min(l_linestatus) as state, count(distinct l_returnflag) as flags, bool_or(l_returnflag = 'R') as returned from lineitem group by 1), o as (select o_orderkey, round(o_totalprice, 2) as t, o_orderdate::date as day, o_orderstatus, o_orderpriority, l.* from orders left join l on o_orderkey = l_orderkey) "


def _check(name: str, formula: str, sql: str, today: str | None = None) -> None:
    @query(_SUMS + f"select o_orderkey, {sql} as status from o", name=name)
    def check(spark: SparkSession, d: str) -> DataFrame:
        rows, scope = _orders(spark, d, formula)
        if today:
            scope = replace(scope, today=F.to_date(F.lit(today)))
        return run(rows, "o_orderkey", scope, {name: formula}).select("o_orderkey", "status")


_check("orders_check_sum_le", "SUM(line.price) <= order.total", "case when coalesce(s, 0) < t + 0.005 then 'pass' else 'fail' end")
_check("orders_check_between", 'BETWEEN(line.ship, order.day, DATE_ADD(order.day, 1, "year"))', "case when n is null then 'unknown' when first_ship >= day and last_ship <= day + interval 1 year then 'pass' else 'fail' end")
_check("orders_check_same", "SAME(line.state)", "case when coalesce(n, 0) < 2 then 'unknown' when states = 1 then 'pass' else 'fail' end")
_check("orders_check_kleene", 'line.flag != "R" OR MAX(line.price) > 50000', "case when n is null then 'unknown' when not returned then 'pass' when (select max(round(l_extendedprice, 2)) from lineitem i where i.l_orderkey = o.o_orderkey) > 50000.005 then 'pass' else 'fail' end")
_check("orders_check_if", 'IF(order.status = "F", COUNT(line) > 3)', "case when o_orderstatus <> 'F' then 'pass' when coalesce(n, 0) > 3 then 'pass' else 'fail' end")
_check("orders_check_average", "AVERAGE(line.price) <= order.total / COUNT(line)", "case when n is null then 'unknown' when s / n < t / n + 0.005 then 'pass' else 'fail' end")


_check("orders_check_exists", 'EXISTS(line.ship) AND NOT order.status = "P"', "case when o_orderstatus = 'P' or n is null then 'fail' else 'pass' end")
_check("orders_check_round", "ABS(order.total - SUM(line.price)) <= ROUND(order.total, -3)", "case when abs(t - coalesce(s, 0)) < round(t, -3) + 0.005 then 'pass' else 'fail' end")
_check("orders_check_match", 'MATCH(order.priority, "urgent") OR CONTAINS(order.priority, "low")', "case when o_orderpriority in ('1-URGENT', '5-LOW') then 'pass' else 'fail' end")
_check("orders_check_calls", 'AND(OR(order.status = "O", order.total > 100000), COUNT(line.price) >= 2)', "case when (o_orderstatus = 'O' or t > 100000.005) and coalesce(n, 0) >= 2 then 'pass' else 'fail' end")
_check("orders_check_today", 'DATE_ADD(order.day, 1, "month") <= TODAY()', "case when day + interval 1 month <= date '1995-06-15' then 'pass' else 'fail' end", today="1995-06-15")


_check("orders_check_labels", 'COUNT(line) = COUNT(line.price) AND CONTAINS(order, "1")', "case when contains(o_orderkey::varchar, '1') then 'pass' else 'fail' end")
_check("orders_check_date_text", 'order.day >= "1995-01-01" AND order.day < "31/12/1996"', "case when day >= date '1995-01-01' and day < date '1996-12-31' then 'pass' else 'fail' end")
_check(
    "orders_check_match_modes", 'MATCH(order.priority, "3 x", "number") OR MATCH(order.priority, "cong ty urgent tnhh", "name") OR MATCH(order.priority, "4-NOT SPECIFYED", "fuzzy")',
    "case when o_orderpriority in ('3-MEDIUM', '1-URGENT', '4-NOT SPECIFIED') then 'pass' else 'fail' end",
)


@query(_SUMS + "select 'few' as rule, count(*) filter (where coalesce(n, 0) < 4) as n_pass, count(*) filter (where coalesce(n, 0) >= 4) as n_fail, 0::bigint as n_unknown, count(*) as groups from o union all select 'same', count(*) filter (where n >= 2 and flags = 1), count(*) filter (where n >= 2 and flags > 1), count(*) filter (where coalesce(n, 0) < 2), count(*) from o")
def check_counts(spark: SparkSession, d: str) -> DataFrame:
    """Two rules over all orders in one pass."""
    rows, scope = _orders(spark, d, "COUNT(line) < 4", "SAME(line.flag)")
    return counts(run(rows, "o_orderkey", scope, {"few": "COUNT(line) < 4", "same": "SAME(line.flag)"}))


RULES = """[
  {"id": "sum", "a": "line.price", "op": "sum_le", "b": "order.total"},
  {"id": "later", "a": "line.ship", "op": "after", "b": "order.day"},
  {"id": "state", "a": "line.state", "op": "same", "b": "order.status"},
  {"id": "other", "a": "line.state", "op": "diff", "b": "order.status"},
  {"id": "dear", "a": "order.total", "op": "ge", "b": "order.total", "off": true},
  {"id": "many", "formula": "COUNT(line) > 2"}
]"""
_RULED = {
    "sum": "case when coalesce(s, 0) < t + 0.005 then 'pass' else 'fail' end",
    "later": "case when n is null then 'unknown' when first_ship >= day then 'pass' else 'fail' end",
    "state": "case when n is null then 'unknown' when states = 1 and state = o_orderstatus then 'pass' else 'fail' end",
    "other": "case when n is null then 'unknown' when states = 1 and state = o_orderstatus then 'fail' else 'pass' end",
    "many": "case when coalesce(n, 0) > 2 then 'pass' else 'fail' end",
}


@query(_SUMS + ", v as (" + " union all ".join(f"select '{r}' as rule, {v} as status from o" for r, v in _RULED.items()) + ") select rule, count(*) filter (where status = 'pass') as n_pass, count(*) filter (where status = 'fail') as n_fail, count(*) filter (where status = 'unknown') as n_unknown, count(*) as groups from v group by 1")
def check_ruleset(spark: SparkSession, d: str) -> DataFrame:
    """A ruleset kept as data, validated, then run over all orders in one pass."""
    rules = ruleset(json.loads(RULES), Scope(ORDER_TYPES), "order")
    rows, scope = _orders(spark, d, *rules.values())
    return counts(run(rows, "o_orderkey", scope, rules))


@query("with p as (select s_suppkey, c_custkey, s_nationkey = c_nationkey as same, abs(s_acctbal - c_acctbal) < 100 as near from supplier join customer on s_nationkey = c_nationkey), n as (select *, max(near::int) over (partition by s_suppkey) as any_near, count(*) over (partition by s_suppkey) as k from p), f as (select * from n where case when k = 1 then near when any_near = 1 then near else false end) select s_suppkey, min(c_custkey) as c_custkey from f group by 1 having count(*) = 1")
def link_orders_to_customers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers linked to customers of their nation with about their balance; only sole matches stand.

    Candidates meet by nation and hundreds of the balance, a customer under its own and both neighbours, as balances
    nearer than 100 are at most one apart; one without a balance is no candidate.
    """
    hundreds = lambda c: F.floor(F.col(c) / 100)
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", hundreds("s_acctbal").alias("at"))
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.explode(F.sequence(hundreds("c_acctbal") - 1, hundreds("c_acctbal") + 1)).alias("beside"))
    pairs = s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("at") == F.col("beside")))
    near = F.abs(F.col("s_acctbal") - F.col("c_acctbal")) < 100
    return link(pairs, "s_suppkey", "c_custkey", [near]).select("s_suppkey", "c_custkey")


_LINES = "ln as (select o_orderkey, l_orderkey || '-' || l_linenumber as label, round(l_extendedprice, 2)::decimal(18,2) as a, round(o_totalprice, 2)::decimal(18,2) as b, (round(l_extendedprice, 2) < round(o_totalprice, 2) / 4 + 0.005) as good from lineitem join orders on l_orderkey = o_orderkey)"
_QUARTER = "line.price <= order.total / 4"


def _quarters(spark: SparkSession, d: str) -> tuple[DataFrame, Scope, DataFrame]:
    rows, scope = _orders(spark, d, _QUARTER, labels=True)
    return rows, scope, compared_rows(rows, "o_orderkey", scope, _QUARTER, "line", "price", F.col("order.total"))


@query(f"with {_LINES} select o_orderkey, label, a::varchar as value_a, b::varchar as value_b, case when good then 'pass' else 'fail' end as status from ln")
def check_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every line against a quarter of its order."""
    return _quarters(spark, d)[2]


@query(f"with {_LINES} select o_orderkey, coalesce(string_agg(label || ': ' || a || ' against ' || b, '; ' order by label, label || ': ' || a || ' against ' || b) filter (where not good), '') as notes, count(*) as documents, round(sum(a), 2)::double as total_a, case when count(*) filter (where not good) > 0 then 'fail' else 'pass' end as status, count(*) filter (where not good) > 0 as hinted from ln group by 1")
def check_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Failing lines with notes, totals, and a hint where the rule fails."""
    rows, scope, compared = _quarters(spark, d)
    verdicts = run(rows, "o_orderkey", scope, {"quarter": _QUARTER})
    out = evidence(compared, "o_orderkey").join(totals(compared, "o_orderkey").select("o_orderkey", "total_a"), "o_orderkey").join(verdicts, "o_orderkey")
    notes = F.array_join(F.transform("failing", lambda r: r["note"]), "; ")
    return out.select("o_orderkey", notes.alias("notes"), "documents", F.round("total_a", 2).alias("total_a"), "status", hint(F.col("status"), "Price", "at most", "a quarter of the order").isNotNull().alias("hinted"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'pass' when o_orderstatus = 'F' then 'fail' else 'pass' end as status, case when o_orderstatus = 'F' then 'fail' else 'pass' end as computed, o_orderkey % 5 = 0 as overridden from orders")
def check_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth order is accepted by a user."""
    rows, scope = _orders(spark, d)
    verdicts = run(rows, "o_orderkey", scope, {"open": 'order.status != "F"'})
    own = rows.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("open").alias("rule"), F.lit("pass").alias("status"), F.lit("seen").alias("note"))
    return with_overrides(verdicts, own, "o_orderkey").select("o_orderkey", "status", "computed", "overridden")
