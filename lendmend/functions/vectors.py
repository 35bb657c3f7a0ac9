"""Array algebra on ``array<double>`` columns and the radar polygon."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendmend.functions.ratios import ColumnOrName, _c


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: ColumnOrName) -> Column:
    """Vector of length one; a zero vector stays zero."""
    n = norm(a)
    return F.when(
        n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)
    ).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def radar_area(radii: list[Column]) -> Column:
    """Polygon area on equally spaced axes."""
    n = len(radii)
    ring = radii[0] * radii[-1]
    for a, b in zip(radii, radii[1:]):
        ring = ring + a * b
    return F.lit(0.5 * math.sin(2 * math.pi / n)) * ring


def roundness(radii: list[Column]) -> Column:
    return F.try_divide(F.least(*radii), F.greatest(*radii))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
