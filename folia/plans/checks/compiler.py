"""Check formulas to Catalyst expressions.

A value is a Column with a kind known when compiling: num, str, date or bool, alone or as an array
with one item per document. Null is the unknown of the three-valued logic, for a value or an item.
A scope maps names to documents: single ones are struct columns, groups are array-of-struct
columns, with the fields' texts in them; declared field types decide how texts are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import dates, text
from .parser import CheckError, Node, parse

TOLERANCE = 0.005


@dataclass(frozen=True)
class Scope:
    """types: name -> field -> string, number, money, date or bool; single, groups: name -> (type, column)."""

    types: dict[str, dict[str, str]]
    single: dict[str, tuple[str, Column]] = field(default_factory=dict)
    groups: dict[str, Column] = field(default_factory=dict)
    today: Column | None = None

    def type_of(self, name: str) -> str | None:
        return self.single[name][0] if name in self.single else name if name in self.types else None


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column
    many: bool = False

    def map(self, kind: str, f: Callable[[Column], Column]) -> "Value":
        return Value(kind, F.transform(self.col, f) if self.many else f(self.col), self.many)


SQL_TYPE = {"num": "double", "str": "string", "date": "date", "bool": "boolean"}


def nothing(kind: str) -> Column:
    return F.lit(None).cast(SQL_TYPE[kind])


def typed(c: Column, declared: str) -> tuple[str, Column]:
    """A field's text as its declared type; empty or unreadable is unknown. decimal and day are of their type already."""
    if declared == "decimal":
        return "num", c.cast("double")
    if declared == "day":
        return "date", c.cast("date")
    t = F.nullif(F.trim(c), F.lit(""))
    if declared in ("money", "number"):
        return "num", text.parse_number(t)
    if declared == "date":
        return "date", dates.parse_date(t)
    if declared == "bool":
        n = text.normalize(t)
        # accepted words, fixed values
        return "bool", F.when(n.isin("co", "yes", "true", "dung", "x", "v"), True).when(n.isin("khong", "no", "false", "sai"), False)
    return "str", t


def as_text(kind: str, c: Column) -> Column:
    if kind == "num":
        return F.when(c == F.floor(c), c.cast("decimal(30,0)").cast("string")).otherwise(c.cast("string"))
    return c if kind == "str" else c.cast("string")


def key_of(kind: str, c: Column) -> Column:
    return text.value_key(as_text(kind, c))


def verdict(v: Value) -> Column:
    """true, false or unknown of a yes/no value: any false item decides, then any unknown one; no items are unknown."""
    if v.kind != "bool":
        raise CheckError("the formula must give yes or no")
    if not v.many:
        return v.col
    return F.when(F.size(v.col) == 0, F.lit(None).cast("boolean")).when(F.exists(v.col, lambda x: F.coalesce(~x, F.lit(False))), False).when(F.exists(v.col, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(True)


def both(a: Value, b: Value, kind: str, f: Callable[[Column, Column], Column]) -> Value:
    """Item by item: one list with a single value, or two lists of one length; other lengths are unknown."""
    if a.many and b.many:
        return Value(kind, F.when(F.size(a.col) == F.size(b.col), F.zip_with(a.col, b.col, f)).otherwise(F.array(nothing(kind))), True)
    if a.many:
        return Value(kind, F.transform(a.col, lambda x: f(x, b.col)), True)
    if b.many:
        return Value(kind, F.transform(b.col, lambda y: f(a.col, y)), True)
    return Value(kind, f(a.col, b.col))


def compare(op: str, a: Value, b: Value) -> Value:
    if a.kind == b.kind == "num":
        near = lambda x, y: F.abs(x - y) < TOLERANCE
        table = {"=": near, "!=": lambda x, y: ~near(x, y), "<": lambda x, y: ~near(x, y) & (x < y), ">": lambda x, y: ~near(x, y) & (x > y), "<=": lambda x, y: near(x, y) | (x < y), ">=": lambda x, y: near(x, y) | (x > y)}
        return both(a, b, "bool", table[op])
    if a.kind == b.kind and a.kind in ("date", "bool"):
        return both(a, b, "bool", {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op])
    if op not in ("=", "!="):
        return both(a, b, "bool", lambda x, y: nothing("bool"))
    same = lambda x, y: key_of(a.kind, x) == key_of(b.kind, y)
    return both(a, b, "bool", same if op == "=" else lambda x, y: ~same(x, y))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.kind != "num" or b.kind != "num":
        return both(a, b, "num", lambda x, y: nothing("num"))
    return both(a, b, "num", {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y)}[op])


def flat(args: list[Value], as_kind: str | None = None) -> Column:
    """All items of the arguments in one array."""
    kind = as_kind or args[0].kind
    turn = (lambda v: v.map("str", lambda x: key_of(v.kind, x))) if as_kind == "key" else (lambda v: v)
    parts = [turn(v).col if v.many else F.array(turn(v).col) for v in args]
    if as_kind is None and any(v.kind != kind for v in args):
        raise CheckError("values of different kinds")
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _aggregate(name: str, args: list[Value]) -> Value:
    if any(v.kind != "num" for v in args):
        return Value("num", nothing("num"))
    items = flat(args)
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(items)
    none = F.lit(0.0) if name == "SUM" else nothing("num")
    result = {"SUM": total, "MIN": F.array_min(items), "MAX": F.array_max(items), "AVERAGE": F.try_divide(total, n)}[name]
    return Value("num", F.when(F.exists(items, lambda x: x.isNull()), nothing("num")).when(n == 0, none).otherwise(result))


def _known(args: list[Value]) -> Column:
    parts = [F.size(F.filter(v.col, lambda x: x.isNotNull())) if v.many else v.col.isNotNull().cast("int") for v in args]
    return sum(parts[1:], parts[0])


# Words dropped from company names, fixed values.
COMPANY_WORDS = ("cong ty", "trach nhiem huu han", "tnhh", "co phan", "cp", "mot thanh vien", "mtv", "chi nhanh", "tap doan", "doanh nghiep tu nhan", "dntn")
MODES = {"so": "number", "number": "number", "digits": "number", "ten": "name", "name": "name", "chua": "contains", "contains": "contains"}


def company_key(c: Column) -> Column:
    s = F.concat(F.lit(" "), text.normalize(c), F.lit(" "))
    for w in COMPANY_WORDS:
        s = F.replace(s, F.lit(f" {w} "), F.lit(" "))
    return text.value_key(s)


def matches(a: Column, b: Column, mode: str) -> Column:
    if mode == "number":
        x, y = F.regexp_replace(a, "[^0-9]", ""), F.regexp_replace(b, "[^0-9]", "")
        return (x != "") & (x == y)
    if mode == "contains":
        return text.value_in(b, a)
    key = company_key if mode == "name" else text.value_key
    x, y = key(a), key(b)
    inside = F.contains(x, y) | F.contains(y, x)
    if mode == "name":
        return (x != "") & inside
    return (x != "") & (y != "") & (inside | (text.similarity(x, y) >= 0.8))


def _match(a: Value, b: Value, mode: str) -> Value:
    """Any pair that matches; unknown when every pair is unknown."""
    xs, ys = (F.transform(v.col, lambda x: as_text(v.kind, x)) if v.many else F.array(as_text(v.kind, v.col)) for v in (a, b))
    hit = F.exists(xs, lambda x: F.exists(ys, lambda y: F.coalesce(matches(x, y, mode), F.lit(False))))
    open_ = F.exists(xs, lambda x: x.isNotNull()) & F.exists(ys, lambda y: y.isNotNull())
    some = (F.size(xs) > 0) & (F.size(ys) > 0)
    return Value("bool", F.when(hit, True).when(some & ~open_, nothing("bool")).otherwise(False))


def _literal(n: Node, what: str) -> str:
    if n.op != "str":
        raise CheckError(f"{what} must be a text")
    return n.text


@dataclass(frozen=True)
class Function:
    """A function of the language: how many arguments it takes (most: None for any number), and what makes its value.

    build gets the call's argument nodes, a function that gives a node's value, and the scope.
    """

    name: str
    least: int
    most: int | None
    build: Callable[[tuple[Node, ...], Callable[[Node], Value], Scope], Value]

    def takes(self) -> str:
        more = "" if self.most == self.least else " or more" if self.most is None else f" to {self.most}"
        return f"{self.name} takes {self.least}{more} arguments"


FUNCTIONS: dict[str, Function] = {}


def function(name: str, least: int, most: int | None = None) -> Callable:
    """Adds a function to the table that the static check and the compiler read; the same name replaces it."""

    def add(build: Callable) -> Callable:
        FUNCTIONS[name.upper()] = Function(name.upper(), least, most, build)
        return build

    return add


def used_fields(formula: str | Node, scope: Scope) -> list[tuple[str, str]]:
    """Static check: every (type, field) a formula reads; raises on unknown names, functions and arity."""
    node = parse(formula) if isinstance(formula, str) else formula
    if node.op in ("name", "field"):
        name = node.args[0].text if node.op == "field" else node.text
        kind = scope.type_of(name)
        if kind is None:
            raise CheckError(f"no document type {name!r}")
        if node.op == "name":
            return []
        if node.text not in scope.types[kind]:
            raise CheckError(f"type {kind} has no field {node.text!r}")
        return [(kind, node.text)]
    if node.op == "call":
        known = FUNCTIONS.get(node.text)
        if known is None:
            raise CheckError(f"no function {node.text}")
        if len(node.args) < known.least or (known.most is not None and len(node.args) > known.most):
            raise CheckError(known.takes())
    return [u for a in node.args for u in used_fields(a, scope)]


def value(n: Node, scope: Scope) -> Value:
    go = lambda x: value(x, scope)
    if n.op == "num":
        return Value("num", F.lit(float(n.text)))
    if n.op == "bool":
        return Value("bool", F.lit(n.text == "true"))
    if n.op == "str":
        import re

        if any(re.match(shape, n.text.strip()) for _, shape in dates.LAYOUTS):
            return Value("date", dates.parse_date(F.lit(n.text)))
        return Value("str", F.lit(n.text))
    if n.op == "name":
        if n.text in scope.single:
            return Value("str", scope.single[n.text][1]["label"])
        docs = scope.groups.get(n.text)
        return Value("str", F.transform(docs, lambda d: d["label"]) if docs is not None else F.array().cast("array<string>"), True)
    if n.op == "field":
        name = n.args[0].text
        declared = scope.types[scope.type_of(name)][n.text]
        if name in scope.single:
            kind, col = typed(scope.single[name][1][n.text], declared)
            return Value(kind, col)
        kind = typed(F.lit(None).cast("string"), declared)[0]
        docs = scope.groups.get(name)
        return Value(kind, F.transform(docs, lambda d: typed(d[n.text], declared)[1]) if docs is not None else F.array().cast(f"array<{SQL_TYPE[kind]}>"), True)
    if n.op == "neg":
        return arithmetic("-", Value("num", F.lit(0.0)), go(n.args[0]))
    if n.op == "not":
        v = go(n.args[0])
        return v.map("bool", lambda x: ~x) if v.kind == "bool" else v
    if n.op in ("and", "or"):
        a, b = (verdict(go(x)) for x in n.args)
        return Value("bool", a & b if n.op == "and" else a | b)
    if n.op in "+-*/":
        return arithmetic(n.op, *map(go, n.args))
    if n.op != "call":
        return compare(n.op, *map(go, n.args))
    return FUNCTIONS[n.text].build(n.args, go, scope)


# -- the functions ---------------------------------------------------------------------------

# Words for units of time, fixed values.
UNITS = {"ngay": "day", "day": "day", "days": "day", "thang": "month", "month": "month", "months": "month", "nam": "year", "year": "year", "years": "year"}


for _name in ("SUM", "MIN", "MAX", "AVERAGE"):
    function(_name, 1)(lambda args, go, scope, name=_name: _aggregate(name, [go(a) for a in args]))


@function("COUNT", 1)
def _count(args, go, scope):
    return Value("num", _known([go(a) for a in args]).cast("double"))


@function("EXISTS", 1, 1)
def _exists(args, go, scope):
    return Value("bool", _known([go(args[0])]) > 0)


def _one_number(v: Value, f: Callable[[Column], Column]) -> Value:
    return Value("num", nothing("num") if v.kind != "num" or v.many else f(v.col))


@function("ABS", 1, 1)
def _abs(args, go, scope):
    return _one_number(go(args[0]), F.abs)


@function("ROUND", 1, 2)
def _round(args, go, scope):
    if len(args) < 2:
        return _one_number(go(args[0]), lambda x: F.round(x, 0))
    digits = go(args[1])
    # digits that are no number count as none
    scale = F.pow(F.lit(10.0), F.coalesce(digits.col, F.lit(0.0))) if digits.kind == "num" and not digits.many else F.lit(1.0)
    return _one_number(go(args[0]), lambda x: F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale)


@function("BETWEEN", 3, 3)
def _between(args, go, scope):
    x, low, high = (go(a) for a in args)
    return both(compare(">=", x, low), compare("<=", x, high), "bool", lambda a, b: F.when(a.isNull() | b.isNull(), nothing("bool")).otherwise(a & b))


@function("SAME", 1)
def _same(args, go, scope):
    keys = F.filter(flat([go(a) for a in args], "key"), lambda x: x.isNotNull())
    return Value("bool", F.when(F.size(keys) < 2, nothing("bool")).otherwise(F.size(F.array_distinct(keys)) == 1))


@function("MATCH", 2, 3)
def _matching(args, go, scope):
    mode = MODES.get(_fold(_literal(args[2], "the mode")), "fuzzy") if len(args) > 2 else "fuzzy"
    return _match(go(args[0]), go(args[1]), mode)


@function("CONTAINS", 2, 2)
def _contains(args, go, scope):
    return _match(go(args[0]), go(args[1]), "contains")


@function("IF", 2, 3)
def _if(args, go, scope):
    test, yes = verdict(go(args[0])), go(args[1])
    no = go(args[2]) if len(args) > 2 else Value("bool", F.lit(True))
    if yes.many or no.many:
        if yes.kind != "bool" or no.kind != "bool":
            raise CheckError("IF over lists must give yes or no")
        yes, no = Value("bool", verdict(yes)), Value("bool", verdict(no))
    if yes.kind != no.kind:
        raise CheckError("both results of IF must be of one kind")
    return Value(yes.kind, F.when(test, yes.col).when(~test, no.col))


@function("AND", 2)
def _and(args, go, scope):
    return Value("bool", reduce(lambda a, b: a & b, [verdict(go(a)) for a in args]))


@function("OR", 2)
def _or(args, go, scope):
    return Value("bool", reduce(lambda a, b: a | b, [verdict(go(a)) for a in args]))


@function("TODAY", 0, 0)
def _today(args, go, scope):
    return Value("date", scope.today if scope.today is not None else F.current_date())


@function("DATE_ADD", 3, 3)
def _date_add(args, go, scope):
    unit = UNITS.get(_fold(_literal(args[2], "the unit")))
    when, count = go(args[0]), go(args[1])
    if unit is None or when.kind != "date" or count.kind != "num":
        return both(when, count, "date", lambda x, y: nothing("date"))
    return both(when, count, "date", lambda x, y: dates.add_overflowing(x, y, unit))


def _fold(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s.strip().lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")


def compile_check(formula: str, scope: Scope) -> dict[str, Column]:
    """status (pass, fail, unknown, error) and, for unknown, the fields that are missing."""
    try:
        tree = parse(formula)
        used = sorted(set(used_fields(tree, scope)))
        v = verdict(value(tree, scope))
    except CheckError as e:
        both_ = F.struct(F.lit("error").alias("status"), F.array(F.lit(str(e))).alias("missing"))
        return {"status": both_["status"], "missing": both_["missing"], "result": both_}
    gaps = []
    for kind, key in used:
        for name, (t, doc) in scope.single.items():
            if t == kind:
                gaps.append(F.when(typed(doc[key], scope.types[kind][key])[1].isNull(), F.lit(f"{name}.{key}")))
        if kind in scope.groups:
            docs, declared = scope.groups[kind], scope.types[kind][key]
            gaps.append(F.when(F.exists(docs, lambda d: typed(d[key], declared)[1].isNull()), F.lit(f"{kind}.{key}")))
    missing = F.array_distinct(F.array_compact(F.array(*gaps))) if gaps else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    # the verdict is evaluated once for both columns
    both_ = text.let(v, lambda x: F.struct(F.when(x, "pass").when(~x, "fail").otherwise("unknown").alias("status"), F.when(x.isNull(), missing).otherwise(none).alias("missing")))
    return {"status": both_["status"], "missing": both_["missing"], "result": both_}


# Operators of rules by the kind of their fields, fixed values.
KINDS = {"text": ("same", "diff", "contains"), "money": ("eq", "le", "ge", "sum_le"), "date": ("before", "after", "same_day")}
SIGN = {"eq": "=", "same_day": "=", "le": "<=", "before": "<=", "ge": ">=", "after": ">="}


def rule_formula(a: str, op: str, b: str, kind: str, anchor: str | None = None) -> str:
    """The formula of a rule; the operator must suit the kind of both sides. A field of the
    anchor is one value, any other the list of its documents' values."""
    if op not in KINDS.get(kind, ()):
        raise CheckError(f"operator {op!r} is not for {kind}")
    if op == "sum_le":
        return f"SUM({a}) <= {b}" if b.split(".")[0] == anchor else f"SUM({a}) <= SUM({b})"
    if op in SIGN:
        return f"{a} {SIGN[op]} {b}"
    return {"same": f"SAME({a}, {b})", "diff": f"NOT(SAME({a}, {b}))", "contains": f"CONTAINS({a}, {b})"}[op]


def rule_kind(ref: str, scope: Scope) -> str:
    """How rules compare a field: as text, money or date."""
    [(of, key)] = used_fields(ref, scope)
    return {"money": "money", "number": "money", "decimal": "money", "date": "date", "day": "date"}.get(scope.types[of][key], "text")


def ruleset(rules: list[dict], scope: Scope, anchor: str) -> dict[str, str]:
    """Rules kept as data (id, a, op, b or id, formula; off leaves one out) to id -> formula.
    Fields must exist and be of one kind, operators suit it, formulas pass the static check, ids be
    unique; the error lists every fault."""
    made: dict[str, str] = {}
    faults = []
    for r in rules:
        name = r["id"]
        if r.get("off"):
            continue
        try:
            if name in made:
                raise CheckError("the id is taken")
            formula = r.get("formula")
            if formula is None:
                kinds = [rule_kind(r[side], scope) for side in ("a", "b")]
                if kinds[0] != kinds[1]:
                    raise CheckError(f"{r['a']} is {kinds[0]}, {r['b']} is {kinds[1]}")
                formula = rule_formula(r["a"], r["op"], r["b"], kinds[0], anchor)
            used_fields(formula, scope)
            made[name] = formula
        except CheckError as e:
            faults.append(f"{name}: {e}")
    if faults:
        raise CheckError("; ".join(faults))
    return made
