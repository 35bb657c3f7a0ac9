"""Error measures as aggregate Columns, each one pass with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendmend.functions.ratios import ColumnOrName, _c


def rmse(y: ColumnOrName, yhat: ColumnOrName) -> Column:
    d = _c(y).cast("double") - _c(yhat).cast("double")
    return F.sqrt(F.avg(d * d))


def mape(y: ColumnOrName, yhat: ColumnOrName) -> Column:
    """Mean of |error| / |truth| over cells whose truth is not zero."""
    y, yhat = _c(y).cast("double"), _c(yhat).cast("double")
    return F.avg(F.when(y != 0, F.abs((y - yhat) / y)))


def zero_truth(y: ColumnOrName, yhat: ColumnOrName) -> Column:
    """How many predicted cells ``mape`` leaves out."""
    return F.count_if((_c(y) == 0) & _c(yhat).isNotNull())


def coverage(yhat: ColumnOrName) -> Column:
    return F.avg(F.when(_c(yhat).isNotNull(), 1.0).otherwise(0.0))


def accuracy(y: ColumnOrName, yhat: ColumnOrName) -> Column:
    """Share of predicted cells equal to the truth."""
    return F.avg(
        F.when(_c(yhat).isNotNull(), F.when(_c(y) == _c(yhat), 1.0).otherwise(0.0))
    )


def precision(label: ColumnOrName, predicted: ColumnOrName) -> Column:
    hit = F.count_if((_c(label) == 1) & (_c(predicted) == 1))
    return F.try_divide(hit.cast("double"), F.count_if(_c(predicted) == 1))


def recall(label: ColumnOrName, predicted: ColumnOrName) -> Column:
    hit = F.count_if((_c(label) == 1) & (_c(predicted) == 1))
    return F.try_divide(hit.cast("double"), F.count_if(_c(label) == 1))


def f1(label: ColumnOrName, predicted: ColumnOrName) -> Column:
    hit = F.count_if((_c(label) == 1) & (_c(predicted) == 1))
    return F.try_divide(
        2.0 * hit, F.count_if(_c(label) == 1) + F.count_if(_c(predicted) == 1)
    )


def pearson(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Correlation; null where either side is constant (``corr`` raises there under ANSI mode)."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
