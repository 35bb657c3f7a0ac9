"""Points from a default probability: 600 at even odds, +50 per halving of the odds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendmend.functions.ratios import ColumnOrName, _c

# Fixed values of the scorecard.
CENTRE, STEP = 600.0, 50.0
LOWEST, HIGHEST = 300.0, 850.0
P_FLOOR = 1e-9


def score(p: ColumnOrName, base: float = 2.0, weight: float = 1.0) -> Column:
    """``weight`` is the class weight of the model that gave ``p``; its odds are divided by it."""
    p = F.greatest(F.lit(P_FLOOR), F.least(F.lit(1.0 - P_FLOOR), _c(p).cast("double")))
    odds = p / (F.lit(1.0) - p) / F.lit(float(weight))
    points = F.lit(CENTRE) - F.lit(STEP / math.log(base)) * F.log(odds)
    return F.when(
        _c(p).isNotNull(), F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), points))
    )


def unweighted(p: ColumnOrName, weight: float) -> Column:
    """The probability that a model trained with odds multiplied by ``weight`` stands for."""
    p = _c(p).cast("double")
    return p / (p + (F.lit(1.0) - p) * F.lit(float(weight)))
