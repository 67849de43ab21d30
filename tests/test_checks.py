import pytest
from pyspark.sql import functions as F

from folia.plans.checks import CheckError, Scope, compile_check, parse, rule_formula, ruleset, used_fields

# A fishing trip (the anchor), its landings, the permits it carries and its repairs.
TYPES = {
    "trip": {"code": "string", "skipper": "string", "leaves": "date", "returns": "date", "budget": "money", "harbour": "string"},
    "landing": {"day": "date", "worth": "money", "harbour": "string", "crates": "number"},
    "permit": {"issued": "date", "holder": "string"},
    "repair": {"cost": "money", "done": "date"},
}
TRIP = {"label": "T", "code": "NORTH-7", "skipper": "Ola Nordmann", "leaves": "2025-05-02", "returns": "2025-05-20", "budget": "9.000", "harbour": "Pier 4"}
LANDINGS = [
    {"label": "first", "day": "2025-05-06", "worth": "2.500", "harbour": "pier 4", "crates": "12"},
    {"label": "second", "day": "2025-05-11", "worth": "4.250", "harbour": "PIER-4", "crates": "30"},
    {"label": "third", "day": "2025-05-19", "worth": "1.000", "harbour": "Pier 4", "crates": "5"},
]


def documents(kind, *rows):
    fields = ["label", *TYPES[kind]]
    made = [F.struct(*[F.lit(r.get(f)).cast("string").alias(f) for f in fields]) for r in rows]
    return F.array(*made).cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")


def scope(landings=LANDINGS, permits=({"label": "p", "issued": "2025-04-30", "holder": "Nordmann, Ola"},)):
    return Scope(TYPES, {"trip": ("trip", documents("trip", TRIP)[0])}, {"landing": documents("landing", *landings), "permit": documents("permit", *permits), "repair": documents("repair")})


def status(spark, formula, sc=None):
    c = compile_check(formula, sc or scope())
    return spark.range(1).select(c["status"].alias("s"), c["missing"].alias("m")).collect()[0]


@pytest.mark.parametrize(
    "want,formulas",
    [
        ("pass", ["SUM(landing.worth) <= trip.budget", "SUM(repair.cost) = 0", "COUNT(landing) = 3", "MAX(landing.crates) = 30", "AVERAGE(landing.crates) > 15", "BETWEEN(landing.day, trip.leaves, trip.returns)", "SAME(trip.harbour, landing.harbour)", "EXISTS(permit.issued)", "IF(COUNT(repair) > 0, trip.budget > 50000)", 'DATE_ADD(trip.leaves, 18, "day") = trip.returns', 'CONTAINS("log of north-7, spring", trip.code)', "NOT (trip.budget < 8000)", "MIN(landing.worth) = 1000 OR 1 > 2"]),
        ("fail", ["SUM(landing.worth) > trip.budget", "landing.crates >= 12", "trip.returns < trip.leaves", "EXISTS(repair.cost)", 'trip.harbour = "Pier 5"', "BETWEEN(permit.issued, trip.leaves, trip.returns)", "COUNT(landing) = 3 AND COUNT(permit) = 2"]),
        ("unknown", ["MAX(repair.cost) = 0", "trip.budget / COUNT(repair) > 1", "SAME(repair.cost)", "BETWEEN(repair.done, trip.leaves, trip.returns)"]),
        ("error", ["SUM(landing.worth)", "trip.nothing = 1"]),
    ],
)
def test_verdicts(spark, want, formulas):
    made = [compile_check(f, scope())["status"].alias(f"c{i}") for i, f in enumerate(formulas)]
    got = spark.range(1).select(*made).collect()[0]
    assert {f: got[i] for i, f in enumerate(formulas)} == dict.fromkeys(formulas, want)


def test_an_unread_value_leaves_the_rule_open(spark):
    sc = scope(landings=[LANDINGS[0], {"label": "wet", "day": "2025-05-12", "worth": "illegible", "harbour": "Pier 4", "crates": "3"}])
    r = status(spark, "SUM(landing.worth) < trip.budget", sc)
    assert (r.s, r.m) == ("unknown", ["landing.worth"])
    # what is known already decides
    assert status(spark, "trip.budget < 10 AND SUM(landing.worth) > 0", sc).s == "fail"
    assert status(spark, "COUNT(landing) = 2 OR SUM(landing.worth) > 0", sc).s == "pass"


@pytest.mark.parametrize("formula,part", [("MAX(landing.colour)", "no field"), ("MAX(whale.worth)", "no document type"), ("MEDIAN(landing.worth)", "no function"), ("SUM(landing.worth", "is missing"), ("trip.budget > 5 6", "extra"), ("trip.budget ? 5", "not part"), ('trip.code = "x', "unclosed"), ("  ", "empty")])
def test_faults_before_the_run(formula, part):
    with pytest.raises(CheckError, match=part):
        used_fields(formula, scope())


def test_rules_by_kind():
    assert rule_formula("landing.worth", "sum_le", "trip.budget", "money") == "SUM(landing.worth) <= SUM(trip.budget)"
    assert rule_formula("landing.day", "before", "trip.returns", "date") == "landing.day <= trip.returns"
    with pytest.raises(CheckError):
        rule_formula("trip.code", "sum_le", "trip.code", "text")
    assert parse("spring-trip.code = 1").args[0].args[0].text == "spring-trip"


def test_rules_against_the_anchor():
    assert rule_formula("landing.worth", "sum_le", "trip.budget", "money", "trip") == "SUM(landing.worth) <= trip.budget"
    assert rule_formula("landing.harbour", "diff", "trip.harbour", "text", "trip") == "NOT(SAME(landing.harbour, trip.harbour))"


def test_rulesets_as_data():
    sc = Scope(TYPES)
    good = [{"id": "home", "a": "landing.harbour", "op": "same", "b": "trip.harbour"}, {"id": "left", "a": "trip.gone", "op": "same", "b": "trip.code", "off": True}, {"id": "own", "formula": "COUNT(permit) > 0"}]
    assert ruleset(good, sc, "trip") == {"home": "SAME(landing.harbour, trip.harbour)", "own": "COUNT(permit) > 0"}
    bad = [{"id": "kind", "a": "landing.day", "op": "before", "b": "trip.budget"}, {"id": "op", "a": "trip.code", "op": "le", "b": "permit.holder"}, {"id": "gone", "formula": "SUM(landing.depth) > 1"}, {"id": "own", "formula": "1 = 1"}, {"id": "own", "formula": "1 = 1"}]
    with pytest.raises(CheckError) as e:
        ruleset(bad, sc, "trip")
    assert [part.split(":")[0] for part in str(e.value).split("; ")] == ["kind", "op", "gone", "own"]


def test_rounding_by_a_computed_number_of_digits(spark):
    good = ["ROUND(1234.5) = 1235", "ROUND(0 - 2.5) = 0 - 3", "ROUND(1267, 0 - 2) = 1300", "ROUND(2.345, COUNT(landing) - 1) = 2.35"]
    assert {f: status(spark, f).s for f in good} == dict.fromkeys(good, "pass")
