"""Case types as data: codes, metadata schemas, labels and what opens a bundle, checked once and applied as columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.meta import FORMS, schema_problems, validate
from ..registry import query
from ..session import load


class CaseTypeError(ValueError):
    pass


@dataclass(frozen=True)
class CaseType:
    """A kind of case. from_json() reads and checks one; every fault of it is named."""

    name: str
    title: str
    pattern: str | None = None
    normalize: str = "none"
    case_schema: dict[str, dict] = field(default_factory=dict)
    file_schema: dict[str, dict] = field(default_factory=dict)
    labels: tuple[str, ...] = ()
    least: float = 0.0
    opens: tuple[str, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> CaseType:
        try:
            d = json.loads(text)
        except ValueError as e:
            raise CaseTypeError(f"not JSON: {e}") from e
        fields = {side: d.get(side, {}).get("fields", []) for side in ("case_metadata_schema", "metadata_schema")}
        code, sorting = d.get("code", {}), d.get("classification", {})
        labels = tuple(x.get("name", "") for x in sorting.get("labels", ()))
        opens = tuple(d.get("bundles", {}).get("opens_with", ()))
        faults = [f"{side}: {p}" for side, fs in fields.items() for p in schema_problems(fs)]
        if not re.fullmatch(r"[a-z][a-z0-9_]*", d.get("name", "")):
            faults.append("name: lower-case words joined by _")
        if code.get("normalize", "none") not in FORMS:
            faults.append(f"code: no form {code['normalize']!r}")
        try:
            re.compile(code.get("pattern") or "")
        except re.error as e:
            faults.append(f"code: {e}")
        if len(set(labels)) < len(labels) or "" in labels:
            faults.append("labels: empty or named twice")
        if not 0 <= sorting.get("min_confidence", 0) <= 1:
            faults.append("min_confidence: from 0 to 1")
        faults += [f"opens_with: no label {x!r}" for x in opens if x not in labels]
        if faults:
            raise CaseTypeError("; ".join(faults))
        schemas = [{f["key"]: f for f in fs} for fs in fields.values()]
        return cls(d["name"], d.get("title", d["name"]), code.get("pattern"), code.get("normalize", "none"), *schemas, labels, sorting.get("min_confidence", 0.0), opens)

    def code(self, raw: Column) -> Column:
        """The code in its normal form; null where it doesn't fit the pattern."""
        c = {"upper_trim": lambda x: F.upper(F.trim(x)), "lower_trim": lambda x: F.lower(F.trim(x))}.get(self.normalize, lambda x: x)(raw)
        return c if self.pattern is None else F.when(c.rlike(self.pattern), c)

    def label(self, said: Column, confidence: Column) -> Column:
        """A known label that is sure enough, else unknown."""
        return F.when(said.isin(list(self.labels)) & (confidence >= self.least), said).otherwise("unknown")

    def opens_bundle(self, label: Column) -> Column:
        return label.isin(list(self.opens))


ORDER_CASE = """{
  "name": "orders", "title": "Orders",
  "code": {"pattern": "^[1-5]-[A-Z ]+$", "normalize": "upper_trim"},
  "metadata_schema": {"fields": [{"key": "amount", "type": "number", "required": true}, {"key": "day", "type": "date"}]},
  "classification": {"labels": [{"name": "F"}, {"name": "O"}], "min_confidence": 0.5},
  "bundles": {"opens_with": ["O"]}
}"""


@query(
    """select o_orderkey, case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end as code,
      case when o_orderstatus in ('F', 'O') and o_totalprice >= 50000 then o_orderstatus else 'unknown' end as label, o_orderstatus = 'O' and o_totalprice >= 50000 as opens,
      strftime(o_orderdate, '%Y-%m-%d') as day, case when o_orderkey % 10 = 0 then 'amount: not a number' end as problem from orders"""
)
def case_type_as_data(spark: SparkSession, d: str) -> DataFrame:
    """Codes, labels and metadata of orders under a case type that is kept as data."""
    kind = CaseType.from_json(ORDER_CASE)
    o = load(spark, d, "orders")
    raw = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("4_?")).otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority")))
    amount = F.when(F.col("o_orderkey") % 10 == 0, "many").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    meta = F.create_map(F.lit("amount"), amount, F.lit("day"), F.date_format("o_orderdate", "dd/MM/yyyy"))
    clean, errors = validate(meta, kind.file_schema, strict=True)
    label = kind.label(F.col("o_orderstatus"), F.col("o_totalprice") / 100_000)
    return o.select(
        "o_orderkey", kind.code(raw).alias("code"), label.alias("label"), kind.opens_bundle(label).alias("opens"),
        F.try_element_at(clean, F.lit("day")).alias("day"), F.try_element_at(errors, F.lit(1)).alias("problem"),
    )
