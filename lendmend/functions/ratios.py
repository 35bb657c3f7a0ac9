"""Ratios. A zero denominator gives null, never an error, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def debt_ratio(outstanding: ColumnOrName, disbursed: ColumnOrName) -> Column:
    return ratio(outstanding, disbursed)


def overdue_rate(overdue: ColumnOrName, loans: ColumnOrName) -> Column:
    return ratio(overdue, loans)


def account_util(active: ColumnOrName, loans: ColumnOrName) -> Column:
    return ratio(active, loans)


def inferred_income(approved: ColumnOrName, share: float = 0.3) -> Column:
    """Placeholder income model: a constant share of the approved amount.

    No method is given for inferring income; pass your own Column to
    ``repay_pressure`` where a better one exists.
    """
    return _c(approved).cast("double") * F.lit(float(share))


def repay_pressure(installment: ColumnOrName, income: ColumnOrName) -> Column:
    return ratio(installment, income)


def ltv(disbursed: ColumnOrName, asset_cost: ColumnOrName) -> Column:
    return ratio(disbursed, asset_cost)


def log_amount(x: ColumnOrName) -> Column:
    return F.log1p(_c(x).cast("double"))
