"""The metadata filter language and metadata validation, compiled to expressions over a MAP<STRING, STRING>.

A value's text form is what JSON holds: a number's digits, true or false, or the string itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..registry import query
from ..session import load

KEY = re.compile(r"^[A-Za-z0-9_.\-]{1,64}$")
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
RANGE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


class FilterError(ValueError):
    pass


def text_of(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def _kind(arg, declared: str | None) -> str:
    if declared in ("number", "date"):
        return declared
    if declared:
        return "string"
    if isinstance(arg, (int, float)) and not isinstance(arg, bool):
        return "number"
    return "date" if re.match(r"^\d{4}-\d{2}-\d{2}", str(arg)) else "string"


def _number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("decimal(38,10)"))


def _date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def clause(meta: Column, key: str, op: str, arg, declared: str | None = None) -> Column:
    """One operator on one key. A missing key is null, so only ne (and exists false) hold for it."""
    if not KEY.match(key):
        raise FilterError(f"bad key {key!r}")
    v = F.try_element_at(meta, F.lit(key))
    if op == "eq":
        # a string that is a number written the usual way also equals that number, and the reverse
        return F.coalesce(v == F.lit(text_of(arg)), F.lit(False))
    if op == "ne":
        return ~v.eqNullSafe(F.lit(text_of(arg)))
    if op == "in":
        if not isinstance(arg, (list, tuple)):
            raise FilterError("in takes a list")
        return F.coalesce(v.isin([text_of(a) for a in arg]), F.lit(False))
    if op == "prefix":
        return F.coalesce(F.startswith(v, F.lit(str(arg))), F.lit(False))
    if op == "exists":
        has = F.map_contains_key(meta, F.lit(key))
        return has if arg else ~has
    if op in RANGE:
        kind = _kind(arg, declared)
        if kind == "number":
            a, b = _number(v), F.lit(text_of(arg)).cast("decimal(38,10)")
        elif kind == "date":
            a, b = _date(v), F.lit(str(arg)[:10]).cast("date")
        else:
            a, b = v, F.lit(str(arg))
        return F.coalesce(RANGE[op](a, b), F.lit(False))
    raise FilterError(f"unknown operator {op!r}")


def compile_filter(meta: Column, spec: dict, schema: dict[str, str] | None = None) -> Column:
    """All clauses of {key: literal or {operator: argument}}."""
    out = F.lit(True)
    for key, want in spec.items():
        ops = want if isinstance(want, dict) else {"eq": want}
        for op, arg in ops.items():
            out &= clause(meta, key, op, arg, (schema or {}).get(key))
    return out


def json_contains(document: Column, key: str, arg) -> Column:
    """Whether a JSON document's value at a key is the argument, or an array with it among its members. Types
    count: true is no text, though a whole number and its digits as text are taken for each other."""
    if not KEY.match(key):
        raise FilterError(f"bad key {key!r}")
    v = F.try_variant_get(F.try_parse_json(document), f"$['{key}']", "variant")
    kind = F.schema_of_variant(v)
    text, many = v.cast("string"), F.startswith(kind, F.lit("ARRAY"))
    members = F.try_variant_get(v, "$", "array<variant>")
    named = lambda k: (k == "STRING") if isinstance(arg, str) else (k == "BOOLEAN") if isinstance(arg, bool) else k.isin("BIGINT", "DOUBLE") | F.startswith(k, F.lit("DECIMAL"))
    also = re.fullmatch(r"-?(0|[1-9][0-9]*)", text_of(arg)) and not isinstance(arg, bool)

    def same(value: Column) -> Column:
        k = F.schema_of_variant(value)
        fits = named(k) | (k.isin("STRING", "BIGINT") if also else F.lit(False))
        return fits & (value.cast("string") == F.lit(text_of(arg)))

    one = (named(kind) | (kind.isin("STRING", "BIGINT") if also else F.lit(False))) & (text == F.lit(text_of(arg)))
    return F.coalesce(F.when(many, F.exists(members, same)).otherwise(one), F.lit(False))


def has_any_key(meta: Column, keys: list[str]) -> Column:
    """at least one of the keys is there, with null or another value."""
    return F.arrays_overlap(F.map_keys(meta), F.array(*[F.lit(k) for k in keys]))


def normalise_filter(spec: dict, schema: dict[str, dict]) -> dict:
    """A filter's texts in the form the schema stores: trimmed, cased, dates as yyyy-MM-dd, numbers as numbers."""

    def one(x, field: dict | None):
        if not isinstance(x, str):
            return x
        t = x.strip()
        if field is None:
            return t
        if field.get("type") == "date":
            day = re.fullmatch(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", t)
            return f"{day[3]}-{int(day[2]):02d}-{int(day[1]):02d}" if day else t
        if field.get("type") == "number" and re.fullmatch(r"-?\d+(\.\d+)?", t):
            return float(t)
        return {"upper_trim": t.upper, "lower_trim": t.lower}.get(field.get("normalize", ""), t.__str__)()

    each = lambda arg, f: [one(x, f) for x in arg] if isinstance(arg, (list, tuple)) else one(arg, f)
    return {k: {op: each(arg, schema.get(k)) for op, arg in want.items()} if isinstance(want, dict) else each(want, schema.get(k)) for k, want in spec.items()}


# -- validation ---------------------------------------------------------------------------

# Fixed words of the schema language.
TYPES, FORMS = ("string", "number", "bool", "date", "enum"), ("none", "upper_trim", "lower_trim")


def schema_problems(fields: list[dict]) -> list[str]:
    """What is wrong with a declared schema."""
    out, seen = [], set()
    for f in fields:
        key = f.get("key", "")
        if not re.fullmatch(r"[a-z][a-z0-9_]*", key):
            out.append(f"{key!r}: keys are lower-case words joined by _")
        if key in seen:
            out.append(f"{key!r}: declared twice")
        seen.add(key)
        if f.get("type", "string") not in TYPES:
            out.append(f"{key!r}: no type {f['type']!r}")
        if f.get("type") == "enum" and not f.get("values"):
            out.append(f"{key!r}: an enum needs values")
        if f.get("normalize", "none") not in FORMS:
            out.append(f"{key!r}: no form {f['normalize']!r}")
    return out


def free_value_problem(document: Column, key: str) -> Column:
    """Null for a value that may stand under a key without a declaration: a string, number or boolean, or an array of those."""
    v = F.try_variant_get(F.try_parse_json(document), f"$['{key}']", "variant")
    plain = lambda k: k.isin("STRING", "BOOLEAN", "BIGINT", "DOUBLE") | F.startswith(k, F.lit("DECIMAL"))
    kind = F.schema_of_variant(v)
    members = F.try_variant_get(v, "$", "array<variant>")
    good_list = F.forall(members, lambda x: plain(F.schema_of_variant(x)))
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.when(~good_list, "arrays hold strings, numbers or booleans")).when(~plain(kind), "a string, number, boolean or an array of those")


def code_problem(code: Column, pattern: str = r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,63}$") -> Column:
    """why a code, label or document type can't be used."""
    return F.when(code.isNull() | (F.trim(code) == ""), "empty").when(~code.rlike(pattern), "characters")


BOOLS = {"true": "true", "1": "true", "yes": "true", "false": "false", "0": "false", "no": "false"}


def coerce(c: Column, spec: dict) -> Column:
    """A value in its declared type's text form; null when it doesn't fit."""
    kind, t = spec.get("type", "string"), F.trim(c)
    t = {"upper_trim": F.upper, "lower_trim": F.lower}.get(spec.get("normalize", ""), lambda x: x)(t)
    if kind == "number":
        return F.when(t.rlike(NUMBER), t)
    if kind == "bool":
        return F.create_map(*[F.lit(x) for kv in BOOLS.items() for x in kv])[F.lower(t)]
    if kind == "date":
        return F.date_format(dates.parse_date(t), "yyyy-MM-dd")
    if kind == "enum":
        return F.when(t.isin(list(spec.get("values", ()))), t)
    return t


def validate(meta: Column, schema: dict[str, dict], strict: bool = False) -> tuple[Column, Column]:
    """(clean map, errors): coerced values of known keys; unknown keys stay unless strict."""
    clean, errors = [], []
    for key, spec in schema.items():
        raw = F.try_element_at(meta, F.lit(key))
        good = coerce(raw, spec)
        clean.append(F.when(good.isNotNull(), F.struct(F.lit(key).alias("key"), good.alias("value"))))
        errors.append(F.when(raw.isNotNull() & good.isNull(), F.lit(f"{key}: not a {spec.get('type', 'string')}")))
        if spec.get("required"):
            errors.append(F.when(raw.isNull(), F.lit(f"{key}: required")))
    other = F.map_filter(meta, lambda k, _: ~k.isin(list(schema)))
    if strict:
        extra = F.transform(F.array_sort(F.map_keys(other)), lambda k: F.concat(k, F.lit(": unknown key")))
        return F.map_from_entries(F.array_compact(F.array(*clean))), F.concat(F.array_compact(F.array(*errors)), extra)
    return F.map_concat(F.map_from_entries(F.array_compact(F.array(*clean))), other), F.array_compact(F.array(*errors))


def merge(base: Column, own: Column) -> Column:
    """Own values win; a null among them removes the key."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, F.map_filter(own, lambda _, v: v.isNotNull()))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("meta", F.from_json("props", "map<string,string>"))


def _meta_query(name: str, spec: dict, sql: str) -> None:
    @query(f"select event_id from events where {sql}", name=name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _events(spark, d).where(compile_filter(F.col("meta"), spec)).select("event_id")


_K = "(props->>'k')"
_meta_query("meta_eq", {"k": 7}, f"{_K} = '7'")
_meta_query("meta_eq_text", {"k": "07"}, f"{_K} = '07'")
_meta_query("meta_ne_missing", {"nothing": {"ne": "x"}, "k": {"ne": 3}}, f"(props->>'nothing') is distinct from 'x' and {_K} is distinct from '3'")
_meta_query("meta_in", {"k": {"in": [1, 2, "3"]}}, f"{_K} in ('1', '2', '3')")
_meta_query("meta_prefix", {"k": {"prefix": "4"}}, f"starts_with({_K}, '4')")
_meta_query("meta_exists", {"k": {"exists": True}, "z": {"exists": False}}, f"{_K} is not null and (props->>'z') is null")
_meta_query("meta_range", {"k": {"gte": 10, "lt": 55.5}}, f"{_K}::double >= 10 and {_K}::double < 55.5")
_meta_query("meta_range_text", {"k": {"gt": "5"}}, f"{_K} > '5'")


@query(f"select event_id, case when ts >= timestamp '2024-01-02' then strftime(ts, '%Y-%m-%d') end as day, case when {_K}::int > 90 then 1 else 0 end as big from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'")
def meta_range_date(spark: SparkSession, d: str) -> DataFrame:
    """Dates compared by their first ten characters."""
    e = _events(spark, d).withColumn("meta", F.map_concat("meta", F.create_map(F.lit("day"), F.date_format("ts", "yyyy-MM-dd HH:mm"))))
    hit = e.where(compile_filter(F.col("meta"), {"day": {"gte": "2024-01-10", "lt": "2024-01-20"}}))
    return hit.select("event_id", F.substring(F.col("meta")["day"], 1, 10).alias("day"), (F.col("meta")["k"].cast("int") > 90).cast("int").alias("big"))


@query(f"select event_id, upper(event_type) as kind, case when {_K}::int in (1, 2, 3) then {_K} end as k, (case when {_K}::int in (1, 2, 3) then 0 else 1 end)::bigint as errors from events")
def meta_validate(spark: SparkSession, d: str) -> DataFrame:
    """A declared schema over every event's metadata."""
    e = _events(spark, d).withColumn("meta", F.map_concat("meta", F.create_map(F.lit("kind"), F.concat(F.lit(" "), "event_type"))))
    clean, errors = validate(F.col("meta"), {"k": {"type": "enum", "values": ["1", "2", "3"], "required": True}, "kind": {"type": "string", "normalize": "upper_trim", "required": True}}, strict=True)
    return e.select("event_id", F.try_element_at(clean, F.lit("kind")).alias("kind"), F.try_element_at(clean, F.lit("k")).alias("k"), F.size(errors).cast("bigint").alias("errors"))


@query(f"select event_id, case when event_type = 'error' then null when event_type = 'view' then 'seen' else {_K} end as k, event_type as t from events")
def meta_merge(spark: SparkSession, d: str) -> DataFrame:
    """Set and unset keys."""
    own = F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit(None).cast("string"))).when(F.col("event_type") == "view", F.create_map(F.lit("k"), F.lit("seen"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    own = F.map_concat(own, F.create_map(F.lit("t"), F.col("event_type")))
    e = _events(spark, d).withColumn("m", merge(F.col("meta"), own))
    return e.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("t")).alias("t"))


@query(f"select {_K} as value, count(*) as n from events group by 1 order by n desc, value limit 10")
def meta_value_facet(spark: SparkSession, d: str) -> DataFrame:
    """A10 on a metadata key."""
    from .documents import facet

    return facet(_events(spark, d), F.try_element_at("meta", F.lit("k")), top=10)


def _documents_json(spark: SparkSession, d: str) -> DataFrame:
    """Events' metadata with an array, a boolean and a nested object beside k."""
    k = F.get_json_object("props", "$.k")
    made = F.concat(F.lit('{"k": '), k, F.lit(', "tags": ["'), "event_type", F.lit('", '), k, F.lit("], \"flag\": "), F.when(F.col("event_id") % 2 == 0, "true").otherwise('"true"'), F.lit(', "deep": {"k": 1}, "bad": [{"x": 1}]}'))
    return load(spark, d, "events").select("event_id", made.alias("doc"))


@query(f"select event_id, event_type = 'view' as tag, {_K} = '7' as member, {_K} = '9' as number, event_id % 2 = 0 as yes, event_id % 2 = 1 as text from events")
def meta_containment(spark: SparkSession, d: str) -> DataFrame:
    """Members of arrays, numbers as text, booleans apart from text."""
    has = lambda k, a: json_contains(F.col("doc"), k, a)
    return _documents_json(spark, d).select("event_id", has("tags", "view").alias("tag"), has("tags", 7).alias("member"), has("k", "9").alias("number"), has("flag", True).alias("yes"), has("flag", "true").alias("text"))


@query("select event_id, null::varchar as k, null::varchar as tags, 'a string, number, boolean or an array of those' as deep, 'arrays hold strings, numbers or booleans' as bad, true as any_key from events")
def meta_free_values(spark: SparkSession, d: str) -> DataFrame:
    """V03, F10."""
    rows = _documents_json(spark, d)
    meta = F.from_json("doc", "map<string,string>")
    return rows.select("event_id", *[free_value_problem(F.col("doc"), k).alias(k) for k in ("k", "tags", "deep", "bad")], (has_any_key(meta, ["nothing", "flag"]) & ~has_any_key(meta, ["nothing"])).alias("any_key"))


@query(f"select event_id from events where {_K}::int >= 50 and event_type in ('VIEW', 'view') and ts >= timestamp '2024-01-10'")
def meta_normalised_filter(spark: SparkSession, d: str) -> DataFrame:
    """Arguments as a user writes them."""
    schema = {"k": {"type": "number"}, "kind": {"type": "string", "normalize": "lower_trim"}, "day": {"type": "date"}}
    spec = normalise_filter({"k": {"gte": " 50 "}, "kind": {"in": [" VIEW "]}, "day": {"gte": "10/1/2024"}}, schema)
    more = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("day"), F.date_format("ts", "yyyy-MM-dd"))
    e = _events(spark, d).withColumn("meta", F.map_concat("meta", more))
    return e.where(compile_filter(F.col("meta"), spec, {k: f["type"] for k, f in schema.items()})).select("event_id")


@query(f"select event_id, {_K} as number, case when event_id % 3 = 0 then 'true' when event_id % 3 = 1 then 'false' end as yes, case when event_id % 2 = 0 then strftime(ts, '%Y-%m-%d') end as day from events")
def meta_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, booleans and dates from text."""
    e = _events(spark, d)
    yes = F.element_at(F.array(F.lit(" Yes"), F.lit("0"), F.lit("maybe")), (F.col("event_id") % 3 + 1).cast("int"))
    day = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyy")).otherwise("31/31/2024")
    return e.select("event_id", coerce(F.col("meta")["k"], {"type": "number"}).alias("number"), coerce(yes, {"type": "bool"}).alias("yes"), coerce(day, {"type": "date"}).alias("day"))


@query("select p_partkey, case when p_partkey % 4 = 0 then 'empty' when p_partkey % 4 = 1 then 'characters' end as problem, p_name ilike '%PART%' as found from part")
def code_rules(spark: SparkSession, d: str) -> DataFrame:
    """F14, F08."""
    code = F.when(F.col("p_partkey") % 4 == 0, " ").when(F.col("p_partkey") % 4 == 1, "a b").otherwise(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")))
    return load(spark, d, "part").select("p_partkey", code_problem(code).alias("problem"), F.col("p_name").ilike("%PART%").alias("found"))
