"""Joins, aggregates, windows, versions and metering over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..session import load


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that ends with a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new take the place of rows of old with their key; one anti join, no sort."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not there yet are added."""
    return old.unionByName(new.join(old, keys, "left_anti"))


@query("select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def inner_join_chain(spark: SparkSession, d: str) -> DataFrame:
    """The dimension side joins after the facts are summed by its key."""
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    by = load(spark, d, "orders").select("o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    return by.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "orders", F.round("total", 2).alias("total"))


@query("select c_custkey, n_name, r_name, count(o_orderkey) as orders from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join orders on o_custkey = c_custkey group by 1, 2, 3")
def left_chain(spark: SparkSession, d: str) -> DataFrame:
    """Outer chain with the facts counted first."""
    orders = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    out = load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    big = load(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    return load(spark, d, "customer").select("c_custkey").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def not_exists_anti(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return load(spark, d, "customer").select("c_custkey").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return latest(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version, max(o_orderkey) over (partition by o_custkey) as newest from orders")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    """Versions numbered within their owner."""
    w = Window.partitionBy("o_custkey")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("version"), F.max("o_orderkey").over(w).alias("newest"))


@query("with v as (select user_id, event_type, event_id, value, case when event_type = 'purchase' then 0 else 1 end as conf, ts from events) select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id order by conf, ts desc, event_id desc) as n from v) where n = 1")
def current_value_per_slot(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed first (purchases stand for them), then the newest."""
    e = load(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return latest(e, ["user_id"], [F.asc(F.col("event_type") != "purchase"), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("select event_id, lead(event_id) over w as superseded_by, case when lead(event_id) over w is null then 'current' else 'superseded' end as state from events window w as (partition by user_id, event_type order by ts, event_id)")
def supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    after = F.lead("event_id").over(w)
    return load(spark, d, "events").select("event_id", after.alias("superseded_by"), F.when(after.isNull(), "current").otherwise("superseded").alias("state"))


def three_way(edited: DataFrame, base: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What an edited copy changes against what it started from and what is there now."""
    side = lambda df, name: df.select(*keys, F.struct(F.col(value).alias("v")).alias(name))
    rows = side(edited, "e").join(side(base, "b"), keys, "full").join(side(current, "c"), keys, "full")
    e, b, c = F.col("e.v"), F.col("b.v"), F.col("c.v")
    kind = F.when(e.eqNullSafe(b), "unchanged").when(c.eqNullSafe(b), "edit").when(e.eqNullSafe(c), "same_edit").otherwise("conflict")
    return rows.select(*keys, kind.alias("kind"))


@query("with b as (select o_orderkey as k, o_orderpriority as v, o_orderstatus as s from orders), e as (select k, case when v = '1-URGENT' then 'X' else v end as v from b where v <> '5-LOW'), c as (select k, case when s = 'F' then 'Y' when s = 'P' then 'X' else v end as v from b), j as (select coalesce(e.k, b.k, c.k) as k, e.v as ev, b.v as bv, c.v as cv from e full join b on e.k = b.k full join c on coalesce(e.k, b.k) = c.k) select k, case when ev is not distinct from bv then 'unchanged' when cv is not distinct from bv then 'edit' when ev is not distinct from cv then 'same_edit' else 'conflict' end as kind from j")
def three_way_diff(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderstatus").alias("s"))
    e = b.where("v <> '5-LOW'").withColumn("v", F.when(F.col("v") == "1-URGENT", "X").otherwise(F.col("v")))
    c = b.withColumn("v", F.when(F.col("s") == "F", "Y").when(F.col("s") == "P", "X").otherwise(F.col("v")))
    return three_way(e, b, c, ["k"], "v")


@query("select strftime(date_trunc('month', ts + interval 7 hour), '%Y-%m') as month, event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by 1, 2")
def events_by_month_tz(spark: SparkSession, d: str) -> DataFrame:
    """Months of a named time zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Ho_Chi_Minh"), "ts")
    return load(spark, d, "events").groupBy(F.date_format(local, "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("select date_trunc('hour', ts) as hour, count(*) as n, count(*) filter (where event_type = 'error') as errors from events group by 1")
def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """A03, A12."""
    return load(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


# Cost of a thousand units by kind of event, a stand-in for a price list.
PRICES = {"click": 0.1, "view": 0.05, "signup": 2.0, "purchase": 1.5, "error": 0.0}


def cost(kind: Column, units: Column) -> Column:
    """The price list is a literal map, so the lookup stays in the scan's stage."""
    prices = F.create_map(*[F.lit(x) for kv in PRICES.items() for x in kv])
    return F.coalesce(prices[kind], F.lit(0.0)) * units / 1000


@query("select event_type, round(sum(value * case event_type when 'click' then 0.1 when 'view' then 0.05 when 'signup' then 2.0 when 'purchase' then 1.5 else 0 end / 1000), 6) as cost from events group by 1")
def usage_cost_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.coalesce(F.sum(cost(F.col("event_type"), F.col("value"))), F.lit(0.0)), 6).alias("cost"))


@query("with s as (select user_id, sum(value * case event_type when 'click' then 0.1 when 'view' then 0.05 when 'signup' then 2.0 when 'purchase' then 1.5 else 0 end / 1000) as spent from events group by 1) select user_id, round(spent, 4) as spent from s where (case when user_id < 50 then 0.02 else 0.05 end) > 0 and spent >= (case when user_id < 50 then 0.02 else 0.05 end)")
def budget_exceeded_users(spark: SparkSession, d: str) -> DataFrame:
    """Spent at least the limit, where there is a limit."""
    s = load(spark, d, "events").groupBy("user_id").agg(F.sum(cost(F.col("event_type"), F.col("value"))).alias("spent"))
    limit = F.when(F.col("user_id") < 50, 0.02).otherwise(0.05)
    return s.where((limit > 0) & (F.col("spent") >= limit)).select("user_id", F.round("spent", 4).alias("spent"))


@query("select c_custkey, coalesce((select sum(o_totalprice) from orders where o_custkey = c_custkey), 0)::decimal(18,2)::double as spent, (select count(*) from orders where o_custkey = c_custkey) as orders, (select max(o_orderdate) from orders where o_custkey = c_custkey) as last_order from customer")
def user_usage_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """Correlated aggregates as one pre-aggregation."""
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").alias("last_order"))
    out = load(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"), F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"), "last_order")


@query("with l as (select user_id, max(ts) as last_ts from events group by 1) select user_id, last_ts from l where last_ts < timestamp '2024-01-30 00:00:00' order by last_ts, user_id limit 100")
def stale_events(spark: SparkSession, d: str) -> DataFrame:
    """A27, R07."""
    l = load(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))  # noqa: E741
    return l.where(F.col("last_ts") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).orderBy("last_ts", "user_id").limit(100)


@query("select event_type, round(avg(epoch(ts) - epoch(prev)), 3) as mean_gap from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events) where prev is not null group by 1")
def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    """Mean time since the user's event before."""
    prev = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    e = load(spark, d, "events").withColumn("prev", prev).where("prev is not null")
    return e.groupBy("event_type").agg(F.round(F.avg(seconds("ts") - seconds("prev")), 3).alias("mean_gap"))


@query("select conv_id, count(*) as turns, md5(string_agg(role || ':' || coalesce(text, ''), chr(10) order by turn)) as digest from conversations group by conv_id")
def conv_messages_nested(spark: SparkSession, d: str) -> DataFrame:
    """Messages nested in order, then read back in one line."""
    nested = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["text"], F.lit("")))), "\n")
    return nested.select("conv_id", F.size("messages").cast("bigint").alias("turns"), F.md5(joined).alias("digest"))


@query("with t as (select *, (strlen(coalesce(text, '')) + 3) // 4 as tokens from conversations), s as (select *, sum(tokens) over (partition by conv_id order by turn desc) as tail from t), c as (select conv_id, min(turn) filter (where role = 'user' and tail <= 120) as first_turn from s group by 1) select s.conv_id, turn from s join c using (conv_id) where turn >= first_turn")
def conv_history_trim(spark: SparkSession, d: str) -> DataFrame:
    """The longest tail within the token budget that begins with a user's message."""
    w = Window.partitionBy("conv_id")
    tokens = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4)
    rows = load(spark, d, "conversations").withColumn("tail", F.sum(tokens).over(w.orderBy(F.desc("turn"))))
    start = F.min(F.when((F.col("role") == "user") & (F.col("tail") <= 120), F.col("turn"))).over(w)
    return rows.withColumn("start", start).where("turn >= start").select("conv_id", "turn")


@query("select l.quality, count(*) as cells, round(avg(case when (d.n_chars > 900) = (l.quality = 1) then 1.0 else 0.0 end), 6) as accuracy from labels l join documents d using (doc_id) group by 1")
def accuracy_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Share of right cells by label; a length rule stands for the extraction."""
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    right = ((F.col("n_chars") > 900) == (F.col("quality") == 1)).cast("double")
    return rows.groupBy("quality").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg(right), 6).alias("accuracy"))


@query("with c as (select doc_id, (n_chars > 900) = (quality = 1) as before, (n_chars > 1500) = (quality = 1) as after from labels join documents using (doc_id)) select doc_id from c where before and not after")
def regression_cells(spark: SparkSession, d: str) -> DataFrame:
    """Right under the old version, wrong under the new one."""
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    good = F.col("quality") == 1
    return rows.where(((F.col("n_chars") > 900) == good) & ~((F.col("n_chars") > 1500) == good)).select("doc_id")


@query("select vec_id, label, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings where vec_id <> 0 order by score desc, vec_id limit 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Cosine top-k of one vector; the query side is one row."""
    e = load(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    q = e.where("vec_id = 0").agg(F.min("v").alias("q")).where("q is not null")  # one row, or none
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = e.where("vec_id <> 0").crossJoin(F.broadcast(q))
    score = F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 6)
    return both.select("vec_id", "label", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("select user_id, count(*) as n, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by 1")
def json_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A11, N09."""
    return load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("with new as (select o_orderkey, 'X' as o_orderstatus from orders where o_orderpriority = '5-LOW' union all select -1, 'N'), u as (select o_orderkey, o_orderstatus from orders where o_orderkey not in (select o_orderkey from new) union all select * from new) select o_orderkey, o_orderstatus from u")
def upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    """U01."""
    old = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = old.where("o_orderpriority = '5-LOW'").select("o_orderkey", F.lit("X").alias("o_orderstatus")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return upsert(old.drop("o_orderpriority"), new, ["o_orderkey"])


@query("with old as (select c_custkey from customer where c_acctbal < 0), new as (select distinct o_custkey as c_custkey from orders) select * from old union all select c_custkey from new where c_custkey not in (select c_custkey from old)")
def insert_ignore_customers(spark: SparkSession, d: str) -> DataFrame:
    """U02."""
    old = load(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return insert_ignore(old, load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"])


@query("select md5(text) as sha, min(doc_id) as doc_id, source from documents group by source, md5(text)")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One document per case (source) and content."""
    return load(spark, d, "documents").groupBy("source", F.md5("text").alias("sha")).agg(F.min("doc_id").alias("doc_id"))


@query("with cache as (select md5(text) as k, min(length(text)) as answer from documents where lang = 'fr' group by 1) select doc_id, answer is not null as hit, coalesce(answer, -1)::bigint as answer from documents left join cache on md5(text) = k")
def content_cache_join(spark: SparkSession, d: str) -> DataFrame:
    """Answers stored under the digest of their input."""
    docs = load(spark, d, "documents")
    key = F.sha2("text", 256)
    cache = docs.where("lang = 'fr'").groupBy(key.alias("k")).agg(F.min(F.length("text")).alias("answer"))
    return docs.select("doc_id", key.alias("k")).join(cache, "k", "left").select("doc_id", F.col("answer").isNotNull().alias("hit"), F.coalesce("answer", F.lit(-1)).cast("bigint").alias("answer"))


@query("select l_orderkey, min(l_extendedprice) as x0, max(l_extendedprice) as x1, min(l_quantity) as y0, max(l_quantity) as y1 from lineitem where l_discount > 0 group by 1")
def box_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of boxes; unset ones (here: without discount) don't count."""
    return load(spark, d, "lineitem").where("l_discount > 0").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("x0"), F.max("l_extendedprice").alias("x1"), F.min("l_quantity").alias("y0"), F.max("l_quantity").alias("y1"))


def point(df: DataFrame, key: str, *values) -> DataFrame:
    """The rows of one or a few keys; the predicate reaches the scan."""
    return df.where(F.col(key).isin(*values))


def keep_order_distinct(c: Column) -> Column:
    """An array's items once each, in the order they are first met; nulls and blanks are left out."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey in (1, 7, 32)")
def orders_by_key(spark: SparkSession, d: str) -> DataFrame:
    return point(load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", 1, 7, 32)


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderstatus = 'P' desc, case when o_orderpriority <> '5-LOW' then o_orderpriority end asc nulls last, o_orderkey) as rank from orders")
def ranked_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """A yes/no key first, then one whose nulls come last."""
    urgent = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "P"), urgent.asc_nulls_last(), "o_orderkey")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rank"))


@query("with w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as place from documents), f as (select doc_id, word, min(place) as place from w where word <> '' group by 1, 2), a as (select doc_id, string_agg(word, ' ' order by place) as words, count(*) as n from f group by 1) select doc_id, coalesce(n, 0)::int as n, md5(coalesce(words, '')) as words_md5 from documents left join a using (doc_id)")
def distinct_words_in_order(spark: SparkSession, d: str) -> DataFrame:
    """L09 on the words of whole texts."""
    words = keep_order_distinct(F.split(F.coalesce("text", F.lit("")), " "))
    return load(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))
