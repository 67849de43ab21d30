"""All queries of the library outside the training-data subpackage, with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLES, QUERIES, Query

MODULES = (
    "sources.readers", "operators.documents", "operators.headings", "operators.cards", "operators.pages", "operators.layout", "operators.layers", "operators.edits",
    "operators.relational", "operators.meta", "operators.sequences", "operators.search", "operators.postings", "operators.trees", "operators.toc", "operators.scalars",
    "operators.sheets", "operators.forms", "operators.changes", "plans.case_checks", "plans.engines", "plans.case_types", "streaming.streams", "streaming.stateful", "streaming.delivery", "sources.partitions", "operators.projections",
)
for _m in MODULES:
    importlib.import_module(f"folia.{_m}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["orders_check_sum_le"](spark, sf_dir)
