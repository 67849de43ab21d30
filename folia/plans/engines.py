"""Functions of a user's own, looked up by name: engines on texts, a completer with a fallback, tools.

An engine takes the texts of a batch and gives one result each (null: none). It runs on executors in
Arrow batches, so a model is loaded once a worker if the engine keeps it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.scalars import calculate, json_problem
from ..registry import query
from ..session import load

Engine = Callable[[list[str | None]], list[str | None]]


class Engines:
    """Engines by name; the empty name is the default one."""

    def __init__(self, default: str):
        self.default = default
        self._named: dict[str, Engine] = {}

    def register(self, name: str, engine: Engine) -> None:
        self._named[name] = engine

    def names(self) -> list[str]:
        return sorted(self._named)

    def get(self, name: str = "") -> Engine:
        name = name or self.default
        if name not in self._named:
            raise KeyError(f"engine {name!r} is not registered")
        return self._named[name]


def applied(df: DataFrame, column: str, engine: Engine, out: str) -> DataFrame:
    """Df with an engine's result for each row's text. An engine that gives another number of results fails the job."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            made = engine([None if pd.isna(t) else t for t in b])
            if len(made) != len(b):
                raise ValueError(f"the engine gave {len(made)} results for {len(b)} texts")
            yield pd.Series(made, dtype=object)

    return df.withColumn(out, run(column))


def completed(df: DataFrame, column: str, engine: Engine | None, fallback: Column, out: str) -> DataFrame:
    """The completer's non-blank result, and the fallback where it gives none or there is no completer."""
    if engine is None:
        return df.withColumn(out, fallback)
    made = applied(df, column, engine, "_made")
    return made.withColumn(out, F.coalesce(F.nullif(F.trim("_made"), F.lit("")), fallback)).drop("_made")


def _fault(c: Column) -> Column:
    p = json_problem(c)
    return F.when(p["reason"].isNull(), "valid").otherwise(F.format_string("line %d, column %d", p["line"], p["col"]))


#: Name -> a builder from the argument's column to the result's.
TOOLS: dict[str, Callable[[Column], Column]] = {
    "calculate": lambda a: calculate(a),
    "json_validate": _fault,
    "number": lambda a: F.coalesce(T.parse_number(a).cast("string"), F.lit("error: no number")),
    "tokens": lambda a: T.estimate_tokens(a).cast("string"),
    "citation": lambda a: F.coalesce(F.to_json(T.parse_citation(a)), F.lit("error: no citation")),
}


def call_tools(calls: DataFrame, tools: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Calls (tool, argument and other columns) with their result; each tool sees its own arguments only,
    a name that isn't known gives an error text."""
    out: Column = F.concat(F.lit("error: no tool "), F.coalesce("tool", F.lit("")))
    for name, made in (TOOLS if tools is None else tools).items():
        mine = F.col("tool") == name
        out = F.when(mine, made(F.when(mine, F.col("argument")))).otherwise(out)
    return calls.withColumn("result", out)


def _first_line(texts: list[str | None]) -> list[str | None]:
    return [None if t is None else next((s.strip() for s in t.split("\n") if s.strip()), None) for t in texts]


BUILT_IN = Engines("first_line")
BUILT_IN.register("first_line", _first_line)
BUILT_IN.register("silent", lambda texts: [None] * len(texts))


@query("select doc_id, md5(trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], ''))) as title_md5, upper(source) as summary, upper(source) as plain from documents")
def engine_results(spark: SparkSession, d: str) -> DataFrame:
    """A named engine on whole texts, a completer that gives nothing, and none at all."""
    docs = load(spark, d, "documents").select("doc_id", "text", "source")
    titled = completed(docs, "text", BUILT_IN.get(), F.lit(""), "title")
    quiet = completed(titled, "text", BUILT_IN.get("silent"), F.upper("source"), "summary")
    return completed(quiet, "text", None, F.upper("source"), "plain").select("doc_id", F.md5("title").alias("title_md5"), "summary", "plain")


@query("select o_orderkey, case o_orderkey % 5 when 0 then (o_orderkey * 2 + 1)::varchar when 1 then case when o_orderstatus = 'F' then 'line 1, column ' || (length(o_orderkey::varchar) + 6) else 'valid' end when 2 then '{\"doc\":\"' || o_orderkey || '\",\"page\":2,\"first\":3,\"last\":5}' when 3 then (length(o_orderpriority) // 3 + 1)::varchar else 'error: no tool weather' end as result from orders")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """A call an order, by turns."""
    key, turn = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    pick = lambda *of: F.element_at(F.array(*of), (turn + 1).cast("int"))
    broken = F.concat(F.lit('{"k":'), key, F.when(F.col("o_orderstatus") == "F", "]").otherwise("}"))
    tool = pick(*[F.lit(t) for t in ("calculate", "json_validate", "citation", "tokens", "weather")])
    argument = pick(F.concat(key, F.lit(" * 2 + 1")), broken, F.concat(F.lit("doc:"), key, F.lit(":p2:l3-l5")), F.col("o_orderpriority"), key)
    return call_tools(load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", tool.alias("tool"), argument.alias("argument"))).select("o_orderkey", "result")
