"""Joins of the customer tables.

No join side is broadcast by hand: Spark broadcasts what its own size check allows and splits
skewed partitions of the rest (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmend.functions.dates import month_index
from lendmend.operators.keyed import latest_per_key, trailing

KEY = "customer_id"


def loans_by_customer(loans: DataFrame) -> DataFrame:
    """Loan history at customer grain, so the customer view does not fan out."""
    return loans.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("loan_rows"),
        F.sum("disbursed_amount").alias("loan_amount"),
        F.min("disbursed_date").alias("first_loan"),
        F.max("disbursed_date").alias("last_loan"),
    )


def customer_view(
    base: DataFrame,
    loans: DataFrame | None = None,
    accounts: DataFrame | None = None,
    repay: DataFrame | None = None,
    bureau: DataFrame | None = None,
) -> DataFrame:
    """Every customer with whatever the other tables know of them. One row each."""
    out = base
    sides = [loans_by_customer(loans) if loans is not None else None, accounts, repay, bureau]
    for side in sides:
        if side is not None:
            out = out.join(side, KEY, "left")
    return out


def profile(view: DataFrame, customer_ids: DataFrame | list) -> DataFrame:
    """Full information of the asked customers."""
    if isinstance(customer_ids, list):
        return view.where(F.col(KEY).isin(customer_ids))
    return view.join(customer_ids.select(KEY).distinct(), KEY, "left_semi")


def with_area(df: DataFrame, areas: DataFrame) -> DataFrame:
    return df.join(areas, "area_id", "left")


def near_events(
    df: DataFrame, ts: str, events: DataFrame, before: int, after: int, key: str | None = None
) -> DataFrame:
    """Rows within ``before`` months before to ``after`` months after an event.

    The range test runs behind an equality on the calendar month: an event is listed under each
    month it reaches (before + after + 1 of them). Adds ``event_ts``, ``event_type`` and
    ``phase``. With ``key`` only events of the same key count.
    """
    left = df.withColumn("_m", month_index(ts))
    reach = events.withColumn(
        "_m",
        F.explode(
            F.sequence(month_index("event_ts") - before, month_index("event_ts") + after)
        ),
    )
    on = ["_m"] + ([key] if key else [])
    lo = F.add_months(F.to_date("event_ts"), -before)
    hi = F.add_months(F.to_date("event_ts"), after)
    day = F.to_date(ts)
    return (
        left.join(reach, on)
        .where((day >= lo) & (day < hi))
        .withColumn(
            "phase", F.when(day < F.to_date("event_ts"), "before").otherwise("after")
        )
        .drop("_m")
    )


def prior_loans(loans: DataFrame, months: int) -> DataFrame:
    """Per loan: how many earlier loans of the customer fall in the last ``months``, and their
    sum. Pairs are never formed."""
    name = f"{months}m"
    return trailing(
        loans, KEY, "disbursed_date", {name: f"{months} MONTH"}, "disbursed_amount"
    ).withColumnsRenamed({f"cnt_{name}": "prior_cnt", f"amt_{name}": "prior_amount"})


def snapshot_at(table: DataFrame, ts: datetime | str) -> DataFrame:
    """The rows of the latest snapshot taken at or before ``ts``."""
    asked = F.lit(ts).cast("timestamp")
    seen = table.where(F.col("snapshot_ts") <= asked)
    newest = seen.agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return seen.join(newest, "snapshot_ts", "left_semi")


def latest_snapshot_per_key(
    table: DataFrame, keys: list[str], ts: datetime | str, ties: tuple[Column, ...] = ()
) -> DataFrame:
    """As-of lookup per key: its newest row at or before ``ts``; ``ties`` orders rows of one instant."""
    seen = table.where(F.col("snapshot_ts") <= F.lit(ts).cast("timestamp"))
    return latest_per_key(seen, keys, [F.col("snapshot_ts").desc(), *ties])


def members(df: DataFrame, selected: DataFrame, on: str | list[str]) -> DataFrame:
    """Drill-down: the rows behind selected clusters, tiers or areas."""
    return df.join(selected, on, "left_semi")


def new_keys(df: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(known, key, "left_anti")


def masked_truth(
    repaired: DataFrame, truth: DataFrame, mask: DataFrame, key: str = KEY
) -> DataFrame:
    """(key, feature, truth, repaired, confidence) of every masked cell; unrepaired is null."""
    on = [key, "feature"]
    extra = [c for c in ("method", "confidence") if c in repaired.columns]
    return (
        mask.select(*on)
        .join(truth.select(*on, F.col("value").alias("truth")), on)
        .join(repaired.select(*on, F.col("value").alias("repaired"), *extra), on, "left")
    )


def combined(batch_df: DataFrame, live_df: DataFrame) -> DataFrame:
    """History and live rows in one view; columns of only one side are null on the other."""
    return batch_df.withColumn("origin", F.lit("batch")).unionByName(
        live_df.withColumn("origin", F.lit("live")), allowMissingColumns=True
    )
