"""Half-open bands: a boundary value belongs to the band it opens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendmend.functions.ratios import ColumnOrName, _c
from lendmend.schema import (
    AGE_FLOORS,
    AREA_POLICY,
    GRADE_FLOORS,
    GRADE_LOWEST,
    GRADE_POLICY,
)


def _banded(x: Column, floors, below: str | None = None) -> Column:
    out = None
    for name, floor in floors:
        test = x >= F.lit(floor)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.when(x.isNotNull(), F.lit(below)) if below is not None else out


def age_group(age: ColumnOrName) -> Column:
    return _banded(_c(age), AGE_FLOORS)


def grade(score: ColumnOrName) -> Column:
    return _banded(_c(score), GRADE_FLOORS, GRADE_LOWEST)


def heat(rate: ColumnOrName, red: float = 0.10, yellow: float = 0.05) -> Column:
    return _banded(_c(rate), (("red", red), ("yellow", yellow)), "green")


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def policy(grade_col: ColumnOrName, table: dict[str, str] | None = None) -> Column:
    return _lookup(_c(grade_col), table or GRADE_POLICY)


def area_action(heat_col: ColumnOrName, table: dict[str, str] | None = None) -> Column:
    return _lookup(_c(heat_col), table or AREA_POLICY)


def edge_band(x: ColumnOrName, edges: list[float]) -> Column:
    """Number of edges at or below ``x``: 0 below the first, len(edges) from the last up."""
    x = _c(x)
    hits = [F.when(x >= F.lit(e), 1).otherwise(0) for e in edges]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.when(x.isNotNull(), total)
