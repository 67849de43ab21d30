"""Dates in the accepted layouts, and calendar arithmetic that overflows into the next month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts, fixed values; earlier ones win.
LAYOUTS = (("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"), ("dd.MM.yyyy", r"^\d{2}\.\d{2}\.\d{4}$"), ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"))


def parse_date(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_date(t, layout)) for layout, shape in LAYOUTS])


def add_overflowing(d: Column, n: Column, unit: str) -> Column:
    """Days, months or years; 31 January and one month is 2 or 3 March."""
    if unit == "day":
        return F.date_add(d, n.cast("int"))
    months = n.cast("int") * (12 if unit == "year" else 1)
    return F.date_add(F.add_months(F.trunc(d, "month"), months), F.dayofmonth(d) - 1)
