"""Derived and time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.functions import ratios as R
from lendmend.functions.dates import date_parts
from lendmend.operators.keyed import trailing

KEY = "customer_id"
WINDOWS = (3, 6, 12)


def derive(df: DataFrame, income: Column | None = None) -> DataFrame:
    """Ratio features from (total) account columns."""
    income = income if income is not None else R.inferred_income("approved")
    return df.withColumns(
        {
            "debt_ratio": R.debt_ratio("outstanding", "disbursed"),
            "overdue_rate": R.overdue_rate("overdue_cnt", "loan_cnt"),
            "account_util": R.account_util("active_cnt", "loan_cnt"),
            "repay_pressure": R.repay_pressure(F.col("installment"), income),
            "disbursed_approved": R.ratio("disbursed", "approved"),
            "active_inactive": R.ratio(
                F.col("active_cnt"), F.col("loan_cnt") - F.col("active_cnt")
            ),
        }
    )


def trailing_loans(loans: DataFrame, months: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Number and amount of the customer's loans in the last 3, 6 and 12 months."""
    spans = {f"{m}m": f"{m} MONTH" for m in months}
    return trailing(loans, KEY, "disbursed_date", spans, "disbursed_amount")


def first_loan_age(loans: DataFrame, as_of: str) -> DataFrame:
    """Days since the customer's first loan, one row per customer."""
    return loans.groupBy(KEY).agg(
        F.datediff(F.lit(as_of).cast("date"), F.to_date(F.min("disbursed_date"))).alias(
            "first_loan_days"
        )
    )


def application_burst(
    apps: DataFrame, ts: str = "apply_time", n: int = 3, days: int = 7, key: str = KEY
) -> DataFrame:
    """At least ``n`` applications within ``days`` up to now; with the gap to the one before."""
    seen = trailing(apps, key, ts, {"burst": f"{days} DAY"}, include_current=True, previous="_prev")
    return seen.withColumns(
        {
            "burst": F.col("cnt_burst") >= n,
            "gap_seconds": (F.unix_micros(ts) - F.unix_micros("_prev")) / F.lit(1e6),
        }
    ).drop("_prev")


def time_features(loans: DataFrame, as_of: str) -> DataFrame:
    """Calendar parts, trailing windows and customer age for every loan."""
    first = first_loan_age(loans, as_of)
    windows = trailing_loans(loans)
    return windows.select("*", *date_parts("disbursed_date")).join(first, KEY, "left")


def account_totals(accounts: DataFrame) -> DataFrame:
    """Total account = primary + secondary; a missing part counts as nothing."""
    names = [c[4:] for c in accounts.columns if c.startswith("pri_")]
    return accounts.withColumns(
        {
            f"total_{n}": F.coalesce(f"pri_{n}", F.lit(0)) + F.coalesce(f"sec_{n}", F.lit(0))
            for n in names
        }
    )
