"""Writes as transformations: edits and corrections, split saves, joins that update or delete, sinks of sheets and forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..session import load
from .sheets import pivot_sheet

# -- joins that change rows ------------------------------------------------------------------


def update_from(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of old take the values of new's row with the key; null there counts as given. One row a key in new."""
    given = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    met = old.join(given, F.col(key) == F.col("_k"), "left")
    return met.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def delete_using(old: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """The rows of old that meet no row of gone."""
    return old.join(gone, on, "left_anti")


def with_latest(base: DataFrame, versions: DataFrame, key: str, pinned: str | None = None) -> DataFrame:
    """Each row beside its pinned version, or the greatest where none is pinned; rows without versions stay.
    versions: key, version and other columns; base may hold a column `pinned`."""
    others = [c for c in versions.columns if c != key]
    if pinned is None:
        last = versions.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("v"))
        return base.join(last, key, "left").select(*base.columns, *[F.col(f"v.{c}").alias(c) for c in others])
    newest = versions.groupBy(key).agg(F.max("version").alias("_newest"))
    want = base.join(newest, key, "left").withColumn("_want", F.coalesce(pinned, "_newest"))
    v = versions.withColumnRenamed("version", "_want")
    return want.join(v, [key, "_want"], "left").withColumnRenamed("_want", "version").select(*base.columns, *others)


def keyed_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A later result takes the place of the one with its key and keeps that one's first time.
    Columns: keys, value, created_at."""
    first = old.select(*keys, F.col("created_at").alias("_first"))
    kept = new.join(first, keys, "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
    return old.join(new, keys, "left_anti").unionByName(kept.select(*old.columns))


def save_split(segments: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The segments after a user's split, and their bundles.

    segments: seg_id, case_id, doc_id, page_start, page_end, label, source, status, bundle (code or null);
    asked: case_id, doc_id, bundle_no, page_start, page_end, label. An active segment of the user's with the same
    range and label is used again (the smallest id, one for each row asked), what is new gets no id yet, other
    active segments of the named documents go stale and leave their bundle; segments of other documents keep theirs.
    """
    key = ["case_id", "doc_id", "page_start", "page_end", "label"]
    turn = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    mine = segments.where("source = 'user' and status = 'active'").select(*key, "seg_id").withColumn("_n", turn(["seg_id"]))
    code = F.concat(F.lit("B"), F.lpad(F.col("bundle_no").cast("string"), 2, "0"))
    wanted = asked.withColumn("_n", turn(["bundle_no"])).join(mine, [*key, "_n"], "left")
    made = wanted.select("seg_id", *key, F.lit("user").alias("source"), F.lit("active").alias("status"), code.alias("bundle"))
    named = asked.select("doc_id").distinct().withColumn("_named", F.lit(True))
    rest = segments.join(made.select("seg_id").where("seg_id is not null"), "seg_id", "left_anti").join(named, "doc_id", "left")
    stale = F.coalesce("_named", F.lit(False)) & (F.col("status") == "active")
    rest = rest.withColumns({"status": F.when(stale, "stale").otherwise(F.col("status")), "bundle": F.when(stale, None).otherwise(F.col("bundle"))}).drop("_named")
    out = made.unionByName(rest.select(*made.columns))
    bundles = out.where("bundle is not null and status = 'active'").groupBy("case_id", "bundle").agg(F.count(F.lit(1)).alias("segments"))
    return out, bundles


def backfill(rows: DataFrame, defaults: DataFrame, key: str, column: str) -> DataFrame:
    """Null values of a column are filled from a table of defaults by key; what is still null stays."""
    d = defaults.select(F.col(key).alias("_k"), F.col(column).alias("_d"))
    return rows.join(d, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn(column, F.coalesce(column, "_d")).drop("_k", "_d")


# -- sheets and forms ------------------------------------------------------------------------


def cell_flags(cells: DataFrame, low: float = 0.7) -> DataFrame:
    """Calculated (a note in place of evidence), low (an agent's value below the confidence), edited (another
    value than the agent's, by key). Columns: value, ai_value, source, confidence, value_matched, note."""
    agent = F.col("source") == "agent"
    same = T.value_key(F.coalesce("value", F.lit(""))) == T.value_key(F.coalesce("ai_value", F.lit("")))
    calculated = agent & ~F.coalesce("value_matched", F.lit(False)) & (F.coalesce("note", F.lit("")) != "")
    return cells.withColumns({"calculated": calculated, "low": agent & (F.col("confidence") < low), "edited": ~same})


def apply_edits(fields: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fields after edits, and the corrections they imply.

    fields: field_id, segment_id, key, value, status; edits: segment_id, key, value (null: confirm as it is). An
    edited slot holds the user's value as confirmed; a correction is kept where the value differs by key."""
    e = edits.select("segment_id", "key", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    met = fields.where("status <> 'superseded'").join(e, ["segment_id", "key"], "full")
    value = F.when(F.col("_hit"), F.coalesce("_new", "value")).otherwise(F.col("value"))
    after = met.select("field_id", "segment_id", "key", value.alias("value"), F.when(F.col("_hit"), "confirmed").otherwise(F.col("status")).alias("status"))
    differs = T.value_key(F.coalesce("_new", F.lit(""))) != T.value_key(F.coalesce("value", F.lit("")))
    corrections = met.where(F.col("_hit") & F.col("_new").isNotNull() & differs).select("segment_id", "key", F.col("value").alias("old_value"), F.col("_new").alias("new_value"))
    return after, corrections


def form_fills(placeholders: DataFrame, cells: DataFrame) -> DataFrame:
    """Each placeholder's fixed text, or the first value of its field that isn't blank, in row order.
    placeholders: cell, text, doc_type, key; cells: form_id, doc_type, row_no, key, value."""
    said = cells.where(F.trim("value") != "").groupBy("form_id", "doc_type", "key").agg(F.min(F.struct("row_no", F.trim("value").alias("v"))).alias("m")).select("form_id", "doc_type", "key", F.col("m.v").alias("found"))
    forms = cells.select("form_id").distinct()
    slots = forms.join(F.broadcast(placeholders), how="cross")  # a form's placeholders, written by hand
    met = slots.join(said, ["form_id", "doc_type", "key"], "left")
    return met.select("form_id", "cell", F.coalesce(F.nullif(F.col("text"), F.lit("")), "found").alias("value")).where("value is not null")


def form_rows(records: DataFrame, form: str, order: list[str], first_row: int, columns: dict[str, Column], formulas: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """A form's data rows and its total row with their sheet rows; {r}, {first} and {last} in formulas become rows.
    columns and formulas: sheet column -> value or formula; totals: sheet column -> formula of the total row."""
    row = F.row_number().over(Window.partitionBy(form).orderBy(*order)) + first_row - 1
    numbered = records.withColumn("sheet_row", row)
    put = lambda f, **at: _replaced(F.lit(f), at)
    cells = [F.struct(F.lit(c).alias("col"), v.cast("string").alias("value")) for c, v in columns.items()]
    cells += [F.struct(F.lit(c).alias("col"), put(f, r=F.col("sheet_row")).alias("value")) for c, f in formulas.items()]
    data = numbered.select(form, "sheet_row", F.inline(F.array(*cells)))
    ends = numbered.groupBy(form).agg(F.max("sheet_row").alias("last"))
    sums = [F.struct(F.lit(c).alias("col"), put(f, first=F.lit(first_row), last=F.col("last")).alias("value")) for c, f in totals.items()]
    return data.unionByName(ends.select(form, (F.col("last") + 1).alias("sheet_row"), F.inline(F.array(*sums)))) if sums else data


def _replaced(text: Column, at: dict[str, Column]) -> Column:
    for name, value in at.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def workbook(fields: DataFrame, row: str, types: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A table a document type (fields: row, doc_type, key, value) and 'map', the place of every cell's value."""
    sheets = {t: pivot_sheet(fields.where(F.col("doc_type") == t), row, keys) for t, keys in types.items()}
    place = F.create_map(*[F.lit(x) for t, keys in types.items() for i, k in enumerate(keys) for x in (f"{t}\0{k}", i + 1)])
    at = F.try_element_at(place, F.concat("doc_type", F.lit("\0"), "key"))
    sheets["map"] = fields.select("doc_type", row, "key", at.alias("column_no")).where("column_no is not null")
    return sheets


def save_workbook(sheets: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One folder a sheet."""
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").option("header", "true").format(form).save(f"{path}/{name}")


def misses(truth: DataFrame, output: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells a version got wrong, with the line it cites. truth: doc_id, field, value; output: version, doc_id,
    field, value, page_no, line_no; lines: doc_id, page_no, line_no, line."""
    both = truth.withColumnRenamed("value", "want").join(output.withColumnRenamed("value", "got"), ["doc_id", "field"])
    wrong = both.where(~(T.value_key(F.col("want")) == T.value_key(F.coalesce("got", F.lit("")))))
    return wrong.join(lines, ["doc_id", "page_no", "line_no"], "left").select("version", "doc_id", "field", "want", "got", "line")


def error_patterns(missed: DataFrame, least: int = 2) -> DataFrame:
    """Fields that a version misses repeatedly, in the same way. missed: rows of misses."""
    kind = F.when(F.coalesce("got", F.lit("")) == "", "empty").when(F.contains("want", "got"), "cut").otherwise("other")
    return missed.groupBy("version", "field", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def before_after(truth: DataFrame, output: DataFrame, old: int, new: int) -> DataFrame:
    """Accuracy of two versions by field, and overall (field null), with the cells that regressed."""
    right = lambda v: F.max(F.when(F.col("version") == v, F.coalesce(T.value_key(F.col("want")) == T.value_key(F.col("got")), F.lit(False)).cast("int")))
    both = truth.withColumnRenamed("value", "want").join(output.withColumnRenamed("value", "got").where(F.col("version").isin(old, new)), ["doc_id", "field"])
    cells = both.groupBy("doc_id", "field").agg(F.coalesce(right(old), F.lit(0)).alias("b"), F.coalesce(right(new), F.lit(0)).alias("a"))
    return cells.rollup("field").agg(F.avg("b").alias("before"), F.avg("a").alias("after"), F.count_if((F.col("b") == 1) & (F.col("a") == 0)).alias("regressed"))


def next_attempts(deliveries: DataFrame, schedule: list[int], most: int) -> DataFrame:
    """What becomes of each delivery after its attempt: succeeded, failed, or pending with the next time,
    by a ladder whose last step repeats. Columns: attempts (before this one), ok, at."""
    n = F.col("attempts") + 1
    wait = F.element_at(F.array(*[F.lit(s) for s in schedule]), F.least(n, F.lit(len(schedule))).cast("int"))
    state = F.when(F.col("ok"), "succeeded").when(n >= most, "failed").otherwise("pending")
    due = F.timestamp_seconds(F.unix_seconds(F.col("at").cast("timestamp")) + wait)
    return deliveries.withColumns({"state": state, "due": F.when(state == "pending", due), "attempts": n})


# -- queries ---------------------------------------------------------------------------------


@query("select c_custkey, case when s.n > 20 then 'many' when s.n is not null then null else c_mktsegment end as c_mktsegment from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) s on o_custkey = c_custkey")
def update_from_orders(spark: SparkSession, d: str) -> DataFrame:
    """A null on the given side is written too."""
    by = load(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    new = by.select("c_custkey", F.when(F.col("n") > 20, "many").alias("c_mktsegment"))
    return update_from(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), new, "c_custkey", ["c_mktsegment"])


@query("select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderdate > timestamp '1997-01-01' and l_quantity > 10)")
def delete_using_orders(spark: SparkSession, d: str) -> DataFrame:
    """J17."""
    gone = load(spark, d, "orders").where("o_orderdate > timestamp_ntz '1997-01-01'").select("o_orderkey")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return delete_using(lines, gone, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_quantity") > 10)).select("l_orderkey", "l_linenumber")


@query("with v as (select o_custkey as c_custkey, o_orderkey as version, o_orderstatus as status from orders), b as (select c_custkey, case when c_custkey % 3 = 0 then (select min(version) from v where v.c_custkey = customer.c_custkey) end as pinned from customer), n as (select c_custkey, max(version) as newest from v group by 1) select b.c_custkey, b.pinned, coalesce(pinned, newest) as version, v.status from b left join n using (c_custkey) left join v on v.c_custkey = b.c_custkey and v.version = coalesce(pinned, newest)")
def latest_version_join(spark: SparkSession, d: str) -> DataFrame:
    """A third of the customers pin their first order."""
    v = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    first = v.groupBy("c_custkey").agg(F.min("version").alias("_f"))
    base = load(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("_f")).alias("pinned"))
    return with_latest(base, v, "c_custkey", "pinned")


@query("with o as (select user_id, event_type, max(event_id) as value, min(ts) as created_at from events where day(ts) <= 10 group by 1, 2), n as (select user_id, event_type, max(event_id) as value, min(ts) as created_at from events where day(ts) > 10 and day(ts) <= 15 group by 1, 2) select user_id, event_type, coalesce(n.value, o.value) as value, coalesce(o.created_at, n.created_at) as created_at from o full join n using (user_id, event_type)")
def keyed_results_events(spark: SparkSession, d: str) -> DataFrame:
    """Later results keep the first one's time."""
    e = load(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    made = lambda df: df.groupBy("user_id", "event_type").agg(F.max("event_id").alias("value"), F.min("ts").alias("created_at"))
    return keyed_results(made(e.where("day <= 10")), made(e.where("day > 10 and day <= 15")), ["user_id", "event_type"])


@query("with s as (select l_orderkey, l_linenumber, case when l_linestatus = 'O' then 'user' else 'agent' end as source, case when l_returnflag = 'R' then 'stale' else 'active' end as status, l_linenumber % 3 + 1 as page, row_number() over () as x from (select l_orderkey, l_linenumber, max(l_linestatus) as l_linestatus, max(l_returnflag) as l_returnflag from lineitem group by 1, 2)), a as (select l_orderkey, l_linenumber, page from s where l_orderkey % 2 = 0 and l_linenumber % 2 = 1), k as (select source, status, l_orderkey % 2 = 0 and exists (select 1 from a where a.l_orderkey = s.l_orderkey) as named, exists (select 1 from a where a.l_orderkey = s.l_orderkey and a.l_linenumber = s.l_linenumber) as asked from s) select state, count(*) as n from (select case when asked and source = 'user' and status = 'active' then 'used again' when named and status = 'active' then 'stale' when status = 'active' then 'kept' else 'old' end as state from k union all select 'new' from k where asked and not (source = 'user' and status = 'active')) group by 1")
def split_save(spark: SparkSession, d: str) -> DataFrame:
    """Lines as segments of their order; every second order's odd lines are saved anew."""
    key = F.concat_ws(":", "l_orderkey", "l_linenumber")
    lines = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_linestatus").alias("l_linestatus"), F.max("l_returnflag").alias("l_returnflag"))
    rows = lines.select(key.alias("seg_id"), F.lit(1).alias("case_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_start"), F.col("l_linenumber").alias("page_end"), key.alias("label"), F.when(F.col("l_linestatus") == "O", "user").otherwise("agent").alias("source"), F.when(F.col("l_returnflag") == "R", "stale").otherwise("active").alias("status"), F.when(F.col("l_returnflag") != "R", "B99").alias("bundle"))
    asked = rows.where("doc_id % 2 = 0 and page_start % 2 = 1").select("case_id", "doc_id", (F.col("doc_id") % 7 + 1).alias("bundle_no"), "page_start", "page_end", "label")
    out, _ = save_split(rows, asked)
    state = F.when(F.col("seg_id").isNull(), "new").when((F.col("status") == "active") & (F.col("bundle") != "B99"), "used again").when((F.col("status") == "stale") & (F.col("label").isNotNull()) & F.col("bundle").isNull() & F.col("_fresh"), "stale").when(F.col("status") == "active", "kept").otherwise("old")
    was = rows.where("status = 'active'").select(F.col("seg_id").alias("_s"), F.lit(True).alias("_fresh"))
    return out.join(was, F.col("seg_id") == F.col("_s"), "left").withColumn("_fresh", F.coalesce("_fresh", F.lit(False))).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, coalesce(case when event_type <> 'view' then event_type end, 'user ' || (user_id % 5), null) as label from events where user_id % 5 < 4 union all select event_id, case when event_type <> 'view' then event_type end from events where user_id % 5 = 4")
def backfill_labels(spark: SparkSession, d: str) -> DataFrame:
    """U09."""
    e = load(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("kind"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("label"))
    defaults = spark.range(4).select(F.col("id").alias("kind"), F.concat(F.lit("user "), F.col("id").cast("string")).alias("label"))
    return backfill(e, defaults, "kind", "label").select("event_id", "label")


@query("select o_orderkey, o_orderstatus = 'P' as calculated, o_orderstatus <> 'F' and o_totalprice < 100000 as low, o_orderpriority like '%5%' as edited from orders")
def sheet_flags(spark: SparkSession, d: str) -> DataFrame:
    """Upper case and spaces are no edit."""
    o = load(spark, d, "orders")
    cells = o.select("o_orderkey", F.col("o_orderpriority").alias("ai_value"), F.when(F.col("o_orderpriority").contains("5"), "other").otherwise(F.upper(F.concat(F.lit(" "), "o_orderpriority"))).alias("value"), F.when(F.col("o_orderstatus") == "F", "user").otherwise("agent").alias("source"), F.when(F.col("o_totalprice") < 100000, 0.5).otherwise(0.9).alias("confidence"), (F.col("o_orderstatus") != "P").alias("value_matched"), F.when(F.col("o_orderstatus") != "O", "sum of lines").alias("note"))
    return cell_flags(cells).select("o_orderkey", "calculated", "low", "edited")


@query("with e as (select o_orderkey, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then upper(o_orderpriority) else 'fixed' end as new from orders where o_orderstatus = 'F') select o.o_orderkey as segment_id, case when e.o_orderkey is not null then coalesce(new, o_orderpriority) else o_orderpriority end as value, case when e.o_orderkey is not null then 'confirmed' else 'proposed' end as status, case when new = 'fixed' then o_orderpriority end as old_value from orders o left join e on e.o_orderkey = o.o_orderkey")
def edits_and_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Confirmations, rewritings of the same value, and corrections."""
    o = load(spark, d, "orders")
    fields = o.select(F.col("o_orderkey").alias("field_id"), F.col("o_orderkey").alias("segment_id"), F.lit("priority").alias("key"), F.col("o_orderpriority").alias("value"), F.lit("proposed").alias("status"))
    new = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, F.upper("o_orderpriority")).otherwise("fixed")
    edits = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("segment_id"), F.lit("priority").alias("key"), new.alias("value"))
    after, corrections = apply_edits(fields, edits)
    return after.join(corrections.select("segment_id", "old_value"), "segment_id", "left").select("segment_id", "value", "status", "old_value")


@query("with c as (select l_orderkey, l_linenumber, case when l_returnflag = 'N' then '  ' else l_returnflag || l_linenumber end as v from lineitem), f as (select l_orderkey, arg_min(v, (l_linenumber, v)) as v from c where trim(v) <> '' group by 1) select distinct l_orderkey as form_id, 'A1' as cell, 'Orders' as value from lineitem union all select l_orderkey, 'B2', v from f")
def form_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """P18."""
    cells = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("form_id"), F.lit("line").alias("doc_type"), F.col("l_linenumber").alias("row_no"), F.lit("flag").alias("key"), F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("value"))
    slots = spark.createDataFrame([("A1", "Orders", "line", "flag"), ("B2", "", "line", "flag"), ("C3", "", "line", "none")], "cell string, text string, doc_type string, key string")
    return form_fills(slots, cells)


@query("with r as (select l_orderkey, l_linenumber, l_quantity::int as q, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) + 4 as n from lineitem) select l_orderkey, n::int as sheet_row, 'A' as col, q::varchar as value from r union all select l_orderkey, n::int, 'B', '=A' || n || '*2' from r union all select l_orderkey, max(n)::int + 1, 'A', '=SUM(A5:A' || max(n) || ')' from r group by 1")
def form_sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines as records from row 5 on, a formula in each, and a total."""
    lines = load(spark, d, "lineitem")
    return form_rows(lines.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", ["l_linenumber", "l_quantity"], 5, {"A": F.col("l_quantity").cast("int")}, {"B": "=A{r}*2"}, {"A": "=SUM(A{first}:A{last})"})


@query("select 'order' as sheet, count(*) as n, count(*)::bigint as filled from orders union all select 'line', count(*), sum(flagged::int)::bigint + count(*) from (select bool_or(l_returnflag <> 'N') as flagged from lineitem group by l_orderkey, l_linenumber) union all select 'map', (select count(*) from orders) + (select count(*) + count(*) filter (where l_returnflag <> 'N') from lineitem), null")
def workbook_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of two types and the map of their cells."""
    o = load(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("row"), F.lit("order").alias("doc_type"), F.lit("status").alias("key"), F.col("o_orderstatus").alias("value"))
    key = F.concat_ws(":", "l_orderkey", "l_linenumber")
    cells = F.array(F.struct(F.lit("flag").alias("key"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("value")), F.struct(F.lit("ship").alias("key"), F.col("l_linestatus").alias("value")))
    lines = load(spark, d, "lineitem").select(key.alias("row"), F.lit("line").alias("doc_type"), F.inline(cells)).where("value is not null")
    made = workbook(o.unionByName(lines), "row", {"order": ["status"], "line": ["flag", "ship"]})
    count = lambda name, filled: made[name].select(F.lit(name).alias("sheet"), filled.alias("filled")).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.sum("filled").alias("filled"))
    return count("order", F.col("filled")).unionByName(count("line", F.col("filled"))).unionByName(count("map", F.lit(None).cast("bigint")))


_CELLS = "t as (select o_orderkey as doc_id, 'priority' as field, o_orderpriority as value from orders union all select o_orderkey, 'status', o_orderstatus from orders), g as (select 1 as version, doc_id, field, case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then left(value, 3) else value end as value from t union all select 2, doc_id, field, case when doc_id % 5 = 0 then '?' else lower(value) end from t), w as (select version, doc_id, field, t.value as want, g.value as got, regexp_replace(lower(t.value), '[^a-z0-9]', '', 'g') = regexp_replace(lower(g.value), '[^a-z0-9]', '', 'g') as good from t join g using (doc_id, field))"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = F.array(F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")))
    truth = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.inline(cells))
    one = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.left("value", F.lit(3))).otherwise(F.col("value"))
    two = F.when(F.col("doc_id") % 5 == 0, "?").otherwise(F.lower("value"))
    said = truth.select("doc_id", "field", F.inline(F.array(F.struct(F.lit(1).alias("version"), one.alias("value")), F.struct(F.lit(2).alias("version"), two.alias("value")))))
    return truth, said.withColumns({"page_no": F.lit(1), "line_no": F.lit(1)})


@query(f"with {_CELLS} select version, field, case when got = '' then 'empty' when contains(want, got) then 'cut' else 'other' end as kind, count(*) as n from w where not good group by 1, 2, 3 having count(*) >= 2")
def miss_patterns(spark: SparkSession, d: str) -> DataFrame:
    """How two versions of a prompt fail."""
    truth, said = _versions(spark, d)
    lines = truth.select("doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("line_no"), F.col("value").alias("line")).where("field = 'status'")
    return error_patterns(misses(truth, said, lines.distinct()))


@query(f"with {_CELLS}, c as (select doc_id, field, max(good::int) filter (where version = 1) as b, max(good::int) filter (where version = 2) as a from w group by 1, 2) select field, round(avg(b), 6) as before, round(avg(a), 6) as after, count(*) filter (where b = 1 and a = 0) as regressed from c group by rollup (field)")
def version_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Before and after, by field and overall."""
    out = before_after(*_versions(spark, d), 1, 2)
    return out.select("field", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "regressed")


@query("select event_id, case when event_type = 'purchase' then 'succeeded' when user_id % 4 + 1 >= 4 then 'failed' else 'pending' end as state, case when event_type <> 'purchase' and user_id % 4 + 1 < 4 then date_trunc('second', ts) + to_seconds(case user_id % 4 when 0 then 60 else 300 end) end as due from events")
def delivery_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A ladder of one and five minutes, four attempts."""
    e = load(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("attempts"), (F.col("event_type") == "purchase").alias("ok"), F.col("ts").alias("at"))
    return next_attempts(e, [60, 300], 4).select("event_id", "state", F.col("due").cast("timestamp_ntz").alias("due"))
