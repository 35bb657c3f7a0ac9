"""The data sets behind the risk, customer and monitoring panels.

Inputs are DataFrames, outputs small DataFrames; every report is one aggregation with map-side
combine, so a hot area, product or month does not pile up in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendmend.functions.bands import area_action, edge_band, heat
from lendmend.functions.dates import month_index, month_text

KEY = "customer_id"


def _n() -> Column:
    return F.count(F.lit(1))


def filtered(
    df: DataFrame,
    area: list | None = None,
    product: list | None = None,
    period: tuple[str, str] | None = None,
    date_col: str = "disbursed_date",
) -> DataFrame:
    """Rows of the asked areas, products and period [start, end); filter before a report."""
    if area is not None:
        df = df.where(F.col("area_id").isin(area))
    if product is not None:
        df = df.where(F.col("product").isin(product))
    if period is not None:
        start, end = (F.lit(d).cast("timestamp") for d in period)
        df = df.where((F.col(date_col) >= start) & (F.col(date_col) < end))
    return df


def area_default_rate(customers: DataFrame, red: float = 0.10, yellow: float = 0.05) -> DataFrame:
    """Defaulted customers / customers per area, with the area's colour.

    ``customers`` has one row per customer.
    """
    rates = customers.groupBy("area_id").agg(
        _n().alias("customers"),
        F.count_if(F.col("loan_default") == 1).alias("defaulted"),
    )
    return rates.withColumn(
        "default_rate", F.try_divide(F.col("defaulted").cast("double"), F.col("customers"))
    ).withColumn("heat", heat("default_rate", red, yellow))


def area_stats(customers: DataFrame, loans: DataFrame) -> DataFrame:
    """Customers, loan amount, defaulted customers, their amount and mean score per area."""
    amounts = loans.groupBy(KEY).agg(F.sum("disbursed_amount").alias("amount"))
    joined = customers.join(amounts, KEY, "left")
    bad = F.col("loan_default") == 1
    return joined.groupBy("area_id").agg(
        _n().alias("customers"),
        F.sum("amount").alias("loan_amount"),
        F.count_if(bad).alias("defaulted"),
        F.coalesce(F.sum(F.when(bad, F.col("amount"))), F.lit(0.0)).alias("default_amount"),
        F.avg("credit_score").alias("mean_score"),
    )


def drill(df: DataFrame, dims: tuple[str, ...] = ("area_id", "product", "customer_type")) -> DataFrame:
    """Loans, amount and default rate at every level of the roll-up; ``level`` counts the
    dimensions still open (0 = grand total)."""
    # Combine to the finest level first, so the roll-up multiplies groups and not rows.
    finest = df.groupBy(*dims).agg(
        _n().alias("loans"),
        F.sum("disbursed_amount").alias("loan_amount"),
        F.sum("loan_default").alias("bad"),
        F.count("loan_default").alias("known"),
    )
    out = finest.rollup(*dims).agg(
        F.sum("loans").alias("loans"),
        F.sum("loan_amount").alias("loan_amount"),
        F.try_divide(F.sum("bad").cast("double"), F.sum("known")).alias("default_rate"),
        F.grouping_id().alias("_gid"),
    )
    return out.withColumn("level", F.lit(len(dims)) - F.bit_count("_gid")).drop("_gid")


def monthly_overdue_rate(loans: DataFrame, ts: str = "disbursed_date") -> DataFrame:
    """Overdue share of the loans disbursed in each month."""
    return overdue_rate_by(loans, [], ts)


def overdue_rate_by(loans: DataFrame, dims: list[str], ts: str = "disbursed_date") -> DataFrame:
    """The same by month and the given dimensions."""
    bad = F.col("overdue_cnt") > 0
    return loans.groupBy(month_text(ts).alias("month"), *dims).agg(
        _n().alias("loans"),
        F.count_if(bad).alias("overdue_loans"),
        F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("overdue_rate"),
    )


def overdue_rate_wide(
    loans: DataFrame, dim: str, values: list[str], ts: str = "disbursed_date"
) -> DataFrame:
    """One column per value of ``dim``, one row per month."""
    bad = F.when(F.col("overdue_cnt") > 0, 1.0).otherwise(0.0)
    return loans.groupBy(month_text(ts).alias("month")).pivot(dim, values).agg(F.avg(bad))


def event_effect(loans: DataFrame, events: DataFrame, n: int, ts: str = "disbursed_date") -> DataFrame:
    """Overdue rate of the cohorts in the n months before and the n months from each event on.

    Loans are combined per month before they meet the events.
    """
    months = loans.groupBy(month_index(ts).alias("_m")).agg(
        _n().alias("n"), F.count_if(F.col("overdue_cnt") > 0).alias("bad")
    )
    at = month_index("event_ts")
    reach = events.withColumn("_at", at).withColumn(
        "_m", F.explode(F.sequence(F.col("_at") - n, F.col("_at") + n - 1))
    )
    joined = reach.join(months, "_m")
    before = F.col("_m") < F.col("_at")

    def rate(phase):
        return F.try_divide(
            F.sum(F.when(phase, F.col("bad"))).cast("double"), F.sum(F.when(phase, F.col("n")))
        )

    return joined.groupBy("event_type", month_text("event_ts").alias("event_month")).agg(
        rate(before).alias("rate_before"), rate(~before).alias("rate_after")
    )


def tier_distribution(scored: DataFrame) -> DataFrame:
    """Customers and their share per tier."""
    w = W.partitionBy()  # a window over one row per tier
    return scored.groupBy("tier").agg(_n().alias("customers")).withColumn(
        "share", F.col("customers").cast("double") / F.sum("customers").over(w)
    )


def tier_exposure(scored: DataFrame, amount_col: str) -> DataFrame:
    """Amount and its share per tier."""
    w = W.partitionBy()  # a window over one row per tier
    return scored.groupBy("tier").agg(F.sum(amount_col).alias("amount")).withColumn(
        "amount_share", F.try_divide(F.col("amount"), F.sum("amount").over(w))
    )


def new_customer_tiers(scored: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    """Tier shares among customers whose first loan is in the last ``months``, against all."""
    start = F.add_months(F.lit(as_of).cast("date"), -months)
    fresh = (F.to_date("first_loan") > start) & (F.to_date("first_loan") <= F.lit(as_of).cast("date"))
    w = W.partitionBy()  # a window over one row per tier
    per = scored.groupBy("tier").agg(
        _n().alias("customers"), F.count_if(fresh).alias("new_customers")
    )
    share = F.col("customers").cast("double") / F.sum("customers").over(w)
    new_share = F.try_divide(F.col("new_customers").cast("double"), F.sum("new_customers").over(w))
    return per.withColumns(
        {"share": share, "new_share": new_share, "difference": new_share - share}
    )


def kpis(loans: DataFrame, as_of: str, ts: str = "disbursed_date") -> DataFrame:
    """Customers, loan amount, overdue rate and customers new in the month of ``as_of``.

    Two-step aggregation: per customer, then over all. No distinct count is needed.
    """
    day = F.to_date(ts)
    per = loans.where(day <= F.lit(as_of).cast("date")).groupBy(KEY).agg(
        _n().alias("n"),
        F.sum("disbursed_amount").alias("amount"),
        F.count_if(F.col("overdue_cnt") > 0).alias("bad"),
        F.min(day).alias("first"),
    )
    month = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    return per.agg(
        _n().alias("customers"),
        F.sum("amount").alias("loan_amount"),
        F.try_divide(F.sum("bad").cast("double"), F.sum("n")).alias("overdue_rate"),
        F.count_if(F.col("first") >= month.cast("date")).alias("new_customers"),
    )


def histogram(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Rows per bin [edge, next edge); bin 0 is below the first edge, the last is open."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(edge_band(col, edges).alias("bin"))
        .agg(_n().alias("n"))
    )


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Size, share, mean score, mean amount and overdue rate per cluster."""
    w = W.partitionBy()  # a window over one row per cluster
    return (
        clustered.groupBy("cluster")
        .agg(
            _n().alias("customers"),
            F.avg("score").alias("mean_score"),
            F.avg("amount").alias("mean_amount"),
            F.avg("overdue_rate").alias("overdue_rate"),
        )
        .withColumn("share", F.col("customers").cast("double") / F.sum("customers").over(w))
    )


def segment_counts(clustered: DataFrame, opportunity: Column | None = None) -> DataFrame:
    """Customers per segment and how many of them are on the opportunity list."""
    hit = opportunity if opportunity is not None else F.lit(False)
    return clustered.groupBy("cluster").agg(
        _n().alias("customers"), F.count_if(hit).alias("opportunities")
    )


def model_monitor(predictions_log: DataFrame, repair_log: DataFrame) -> DataFrame:
    """Per day: predictions, their accuracy, repairs asked for and the share that succeeded.

    ``predictions_log``: ts, predicted, label. ``repair_log``: ts, repaired (boolean).
    """
    pred = predictions_log.groupBy(F.to_date("ts").alias("day")).agg(
        _n().alias("predictions"),
        F.avg(F.when(F.col("predicted") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    rep = repair_log.groupBy(F.to_date("ts").alias("day")).agg(
        _n().alias("repairs"),
        F.avg(F.col("repaired").cast("int").cast("double")).alias("repair_success"),
    )
    return pred.join(rep, "day", "full_outer")


def area_policy(area_rates: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """What the area's colour means for approval and limits."""
    return area_rates.withColumn("action", area_action("heat", policy))


def alert_rate_jump(
    series: DataFrame, rate: str, order: str, threshold: float | None = None, n: int = 6,
    factor: float = 1.5,
) -> DataFrame:
    """Alert where the rate exceeds ``threshold`` or, without one, ``factor`` times the mean of
    the ``n`` points before. ``series`` is one row per batch or month."""
    w = W.orderBy(order).rowsBetween(-n, -1)
    out = series.withColumn("trailing_mean", F.avg(rate).over(w))
    limit = F.lit(float(threshold)) if threshold is not None else F.col("trailing_mean") * factor
    return out.withColumn("alert", F.coalesce(F.col(rate) > limit, F.lit(False)))


def trend_alerts(series: DataFrame, limit: float, rate: str = "overdue_rate") -> DataFrame:
    """Alert rows: months whose overdue rate is above ``limit``. Delivery is not done here."""
    return series.where(F.col(rate) > limit).withColumn("limit", F.lit(float(limit)))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON payload per row."""
    return df.select(F.to_json(F.struct("*")).alias("payload"))


# Which panels a role sees first; the panels themselves are the same for all.
ROLE_PANELS = {
    "business": ("customers", "kpis"),
    "risk": ("risk", "kpis"),
    "technical": ("monitor",),
}


def dashboard(
    customers: DataFrame, loans: DataFrame, scored: DataFrame, predictions_log: DataFrame,
    repair_log: DataFrame, as_of: str, role: str | None = None,
    clustered: DataFrame | None = None,
    score_edges: tuple[float, ...] = (550, 650, 750),
    amount_edges: tuple[float, ...] = (10_000, 20_000, 50_000, 100_000, 200_000),
) -> dict[str, DataFrame]:
    """Name -> report of the four panels (kpis, risk, customers, monitor)."""
    panels = {
        "kpis": {"kpis": lambda: kpis(loans, as_of)},
        "risk": {
            "overdue_trend": lambda: monthly_overdue_rate(loans),
            "tiers": lambda: tier_distribution(scored),
            "area_heat": lambda: area_default_rate(customers),
        },
        "customers": {
            "score_histogram": lambda: histogram(customers, "credit_score", list(score_edges)),
            "amount_histogram": lambda: histogram(loans, "disbursed_amount", list(amount_edges)),
        },
        "monitor": {"model_monitor": lambda: model_monitor(predictions_log, repair_log)},
    }
    if clustered is not None:
        panels["customers"]["clusters"] = lambda: cluster_profile(clustered)
    wanted = ROLE_PANELS.get(role, tuple(panels)) if role else tuple(panels)
    return {name: make() for p in wanted for name, make in panels[p].items()}


def snapshot(reports: dict[str, DataFrame], root: str, ts: datetime | str) -> None:
    """Write every report under its name with ``snapshot_ts``; a repeated instant replaces its own rows."""
    for name, df in reports.items():
        (
            df.withColumn("snapshot_ts", F.lit(str(ts)).cast("timestamp"))
            .repartition(1)  # moves the finished rows only; reports are small
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("snapshot_ts")
            .parquet(f"{root}/{name}")
        )


def dashboard_at(spark, root: str, names: list[str], ts: datetime | str) -> dict[str, DataFrame]:
    """The reports as they stood at ``ts``; only the partition of that snapshot is read."""
    from lendmend.operators.combine import snapshot_at

    return {n: snapshot_at(spark.read.parquet(f"{root}/{n}"), ts) for n in names}


def refresh_heat(customers: DataFrame, hour: datetime | str) -> DataFrame:
    """The area heat map as of one hour, ready to append to the snapshots."""
    return area_default_rate(customers).withColumn(
        "refreshed_at", F.date_trunc("hour", F.lit(str(hour)).cast("timestamp"))
    )


def hourly_events(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events per hour of event time; works on a stream as well."""
    return events.groupBy(F.window(ts, "1 hour").alias("w")).agg(_n().alias("events")).select(
        F.col("w.start").alias("hour"), "events"
    )
