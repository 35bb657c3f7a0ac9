"""JSON payloads and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendmend.functions.ratios import ColumnOrName, _c


def encode(*cols: ColumnOrName) -> Column:
    return F.to_json(F.struct(*cols))


def decode(text: ColumnOrName, schema: T.StructType | str) -> Column:
    """A malformed message decodes to null fields rather than failing the query."""
    return F.from_json(_c(text), schema, {"mode": "PERMISSIVE"})
