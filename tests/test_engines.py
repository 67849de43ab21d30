import pytest

from folia.plans.engines import BUILT_IN, TOOLS, Engines, applied, call_tools, completed
from pyspark.sql import functions as F


def test_engines_by_name(spark):
    mine = Engines("loud")
    mine.register("loud", lambda texts: [t and t.upper() for t in texts])
    assert mine.get() is mine.get("loud") and mine.names() == ["loud"]
    with pytest.raises(KeyError, match="quiet"):
        mine.get("quiet")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert [tuple(r) for r in applied(df, "t", mine.get(), "u").orderBy("id").collect()] == [(1, "a", "A"), (2, None, None)]
    with pytest.raises(Exception, match="gave 0 results"):
        applied(df, "t", lambda texts: [], "u").collect()


def test_the_fallback_stands_in(spark):
    df = spark.createDataFrame([(1, "\n head \nrest"), (2, " \n"), (3, None)], "id int, t string")
    got = completed(df, "t", BUILT_IN.get(), F.lit("none"), "title").orderBy("id").collect()
    assert [r.title for r in got] == ["head", "none", "none"]
    assert {r.title for r in completed(df, "t", None, F.lit("none"), "title").collect()} == {"none"}


def test_tools(spark):
    calls = [("calculate", "2^10"), ("calculate", "1/0"), ("json_validate", "[1, 2]"), ("number", "1.250,5"), ("number", "?"), ("citation", "x"), ("tokens", ""), (None, "x"), ("calculate", None)]
    got = call_tools(spark.createDataFrame(calls, "tool string, argument string").coalesce(1)).collect()
    assert [r.result for r in got] == ["1024", "error: division by zero", "valid", "1250.5", "error: no number", "error: no citation", "0", "error: no tool ", None]
    assert set(TOOLS) >= {"calculate", "json_validate"}
