"""Calendar parts of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendmend.functions.ratios import ColumnOrName, _c


def date_parts(d: ColumnOrName, prefix: str = "") -> list[Column]:
    """year, quarter, month, weekday (Monday = 0)."""
    d = _c(d)
    return [
        F.year(d).alias(f"{prefix}year"),
        F.quarter(d).alias(f"{prefix}quarter"),
        F.month(d).alias(f"{prefix}month"),
        F.weekday(d).alias(f"{prefix}weekday"),
    ]


def month_text(d: ColumnOrName) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def month_index(d: ColumnOrName) -> Column:
    """Months since year 0; differences of it are whole calendar months."""
    d = _c(d)
    return F.year(d) * 12 + F.month(d) - 1
