"""``attr:value`` items of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(cols: list[str]) -> Column:
    cells = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string")))
        for c in cols
    ]
    return F.array_compact(F.array(*cells))


def item_attr(item: Column) -> Column:
    return F.substring_index(item, ":", 1)


def item_value(item: Column) -> Column:
    """Everything after the first colon, so values may hold colons themselves."""
    return F.substring(item, F.locate(":", item) + 1, F.length(item))
