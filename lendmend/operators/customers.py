"""Radar, segments, timeline, similar cases."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendmend.functions.dates import month_index
from lendmend.functions.vectors import radar_area as _area
from lendmend.functions.vectors import roundness as _roundness
from lendmend.operators.combine import near_events
from lendmend.operators.similar import near_centroid, similar
from lendmend.schema import EVENT_COLOURS, SEGMENT_POLICY

KEY = "customer_id"
AXES = ("axis_score", "axis_capacity", "axis_assets", "axis_history", "axis_stability")


def _clip(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def radar(df: DataFrame, formulas: dict[str, Column] | None = None) -> DataFrame:
    """Five axes: score 0-850, capacity, assets, history and stability 0-100.

    Expects score, debt_ratio, ltv, overdue_rate, loan_cnt and first_loan_days. The formulas of
    the last four axes are plain linear clips; override any of them with ``formulas``.
    """
    axes = {
        "axis_score": _clip(F.col("score").cast("double"), 0.0, 850.0),
        "axis_capacity": _clip(100.0 * (1.0 - F.col("debt_ratio"))),
        "axis_assets": _clip(100.0 * (1.0 - F.col("ltv"))),
        "axis_history": _clip(
            100.0 * (1.0 - F.col("overdue_rate")) * F.least(F.lit(1.0), F.col("loan_cnt") / 5.0)
        ),
        "axis_stability": _clip(F.col("first_loan_days") / 36.5),
    }
    return df.withColumns({**axes, **(formulas or {})})


def radar_area(radar_df: DataFrame) -> DataFrame:
    """Polygon area and roundness on axes scaled to 0..1."""
    radii = [F.col("axis_score") / 850.0] + [F.col(a) / 100.0 for a in AXES[1:]]
    return radar_df.withColumns({"radar_area": _area(radii), "roundness": _roundness(radii)})


def radar_over_time(history: DataFrame, as_of_year: int, years: int = 3) -> DataFrame:
    """Radar per customer and year for the last ``years``, with changes to the year before.

    ``history`` holds the radar inputs per customer and ``period`` (a year).
    """
    recent = history.where(
        (F.col("period") > as_of_year - years) & (F.col("period") <= as_of_year)
    )
    return score_evolution(radar_area(radar(recent)), ("axis_score", "axis_capacity", "radar_area"))


def score_evolution(
    df: DataFrame, measures: tuple[str, ...], period: str = "period", years: int | None = None
) -> DataFrame:
    """Change of each measure to the customer's period before.

    Input is one row per customer and period, so a frame never holds more than the periods.
    """
    if years is not None:
        last = df.agg(F.max(period)).first()[0]
        df = df.where(F.col(period) > last - years)
    w = W.partitionBy(KEY).orderBy(period)
    return df.withColumns({f"{m}_change": F.col(m) - F.lag(m).over(w) for m in measures})


def segment(k: int = 5, cols: tuple[str, ...] = ("score", "amount", "overdue_rate"), seed: int = 7):
    """Unfitted pipeline: assemble, standardise, K-Means. Use ``fit_segments`` for named clusters."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="error"),
            StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
            KMeans(featuresCol="_std", predictionCol="_cluster", k=k, seed=seed),
        ]
    )


class SegmentModel:
    """Clusters numbered by mean score, then mean amount, best first."""

    def __init__(self, pipeline: PipelineModel, cols: tuple[str, ...]):
        self.pipeline, self.cols = pipeline, cols
        scale = pipeline.stages[1]
        centres = [
            [c * s + m for c, s, m in zip(centre, scale.std, scale.mean)]
            for centre in pipeline.stages[2].clusterCenters()
        ]
        order = sorted(range(len(centres)), key=lambda i: [-v for v in centres[i][:2]])
        self.rank = {old: new + 1 for new, old in enumerate(order)}

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``cluster``; customers that lack one of the columns stay, with a null cluster."""
        held = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.cols])
        # A stand-in lets incomplete rows through the assembler; their cluster is then blanked.
        safe = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.cols}
        out = self.pipeline.transform(
            df.withColumns({f"_was_{c}": F.col(c) for c in self.cols}).withColumns(safe)
        )
        out = out.withColumns({c: F.col(f"_was_{c}") for c in self.cols})
        names = F.create_map(*[F.lit(x) for kv in self.rank.items() for x in kv])
        out = out.withColumn("cluster", F.when(held, names[F.col("_cluster")]))
        return out.drop("_raw", "_std", "_cluster", *[f"_was_{c}" for c in self.cols])


def fit_segments(
    df: DataFrame, k: int = 5, cols: tuple[str, ...] = ("score", "amount", "overdue_rate"),
    seed: int = 7,
) -> SegmentModel:
    from lendmend.sources.zones import written

    points = written(df.select(*cols).dropna(), "segment-points")  # scanned once per iteration
    return SegmentModel(segment(k, cols, seed).fit(points), cols)


def scatter_points(clustered: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    """A drawn share of each cluster's (score, amount) points for plotting; sampling is the feature.

    The draw depends on the customer alone, so any partitioning gives the same points; of every
    cluster at least the customer with the least draw is shown.
    """
    draw = F.pmod(F.xxhash64(F.col(KEY), F.lit(seed)), F.lit(1_000_000))
    drawn = clustered.withColumn("_draw", draw)
    least = drawn.groupBy(F.col("cluster").alias("_of")).agg(F.min(F.struct("_draw", KEY)).alias("_least"))
    points = drawn.join(F.broadcast(least), F.col("cluster").eqNullSafe(F.col("_of"))).where(  # a row per cluster
        (F.col("_draw") < fraction * 1_000_000) | (F.col(KEY) == F.col(f"_least.{KEY}"))
    )
    return points.select(KEY, "score", "amount", "cluster")


def segment_members(clustered: DataFrame, cluster) -> DataFrame:
    return clustered.where(F.col("cluster") == cluster)


def segment_policy(clustered: DataFrame, policy: dict | None = None) -> DataFrame:
    table = policy or SEGMENT_POLICY
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return clustered.withColumn(
        "segment_policy", F.try_element_at(F.create_map(*pairs), F.col("cluster"))
    )


def timeline(
    applications: DataFrame, disbursements: DataFrame, repayments: DataFrame, settled: DataFrame,
    severe: int = 3, extra: tuple[str, ...] = ("amount", "term", "rate"),
) -> DataFrame:
    """Typed union of a customer's credit events.

    Each input: customer_id, ts, and what it has of ``extra``. ``repayments`` also carries
    ``overdue_cnt``, which makes a repayment on time, overdue, or a severe default.
    """
    state = (
        F.when(F.col("overdue_cnt") >= severe, "severe_default")
        .when(F.col("overdue_cnt") > 0, "overdue")
        .otherwise("repaid_on_time")
    )
    parts = [
        applications.withColumn("event", F.lit("application")),
        disbursements.withColumn("event", F.lit("disbursement")),
        repayments.withColumn("event", state),
        settled.withColumn("event", F.lit("settled")),
    ]
    cols = [KEY, "ts", "event", *extra]
    parts = [
        p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("double").alias(c) for c in cols])
        for p in parts
    ]
    colour = F.create_map(*[F.lit(x) for kv in EVENT_COLOURS.items() for x in kv])
    return reduce(DataFrame.unionByName, parts).withColumn("colour", colour[F.col("event")])


def timeline_order(events: DataFrame) -> DataFrame:
    """Global order by customer, time, event: a range shuffle, no per-customer collection."""
    return events.orderBy(KEY, "ts", "event")


def customer_timeline(events: DataFrame, customer_ids: DataFrame) -> DataFrame:
    return timeline_order(events.join(customer_ids, KEY, "left_semi"))


def improvement_trend(loans: DataFrame, ts: str, overdue: Column) -> DataFrame:
    """Overdue share in the first and second half of each customer's history, and the trend.

    Loans are combined per customer and month first, so a customer is a few hundred rows at
    most. The halves meet in the middle between the first and the last month.
    """
    monthly = (
        loans.withColumn("_m", month_index(ts))
        .groupBy(KEY, "_m")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(overdue).alias("bad"))
    )
    w = W.partitionBy(KEY)
    halved = monthly.withColumn(
        "late", F.col("_m") * 2 > F.min("_m").over(w) + F.max("_m").over(w)
    )

    def share(late):
        part = F.col("late") if late else ~F.col("late")
        return F.try_divide(
            F.sum(F.when(part, F.col("bad"))).cast("double"), F.sum(F.when(part, F.col("n")))
        )

    out = halved.groupBy(KEY).agg(
        F.sum("n").alias("loans"), share(False).alias("first_half"), share(True).alias("last_half")
    )
    change = F.col("last_half") - F.col("first_half")
    return out.withColumn(
        "trend",
        F.when(change < 0, "improving").when(change > 0, "worsening").when(change == 0, "stable"),
    )


def timeline_patterns(
    loans: DataFrame, ts: str, overdue: Column, n: int = 3, days: int = 30, **kw
) -> DataFrame:
    """Per customer: the trend, and whether applications ever came in a burst."""
    from lendmend.operators.features import application_burst

    bursts = (
        application_burst(loans, ts, n, days, **kw)
        .groupBy(KEY)
        .agg(F.some("burst").alias("ever_burst"), F.max("cnt_burst").alias("max_in_window"))
    )
    return improvement_trend(loans, ts, overdue).join(bursts, KEY, "left")


def life_event_effect(
    loans: DataFrame, life_events: DataFrame, ts: str, overdue: Column, before: int, after: int
) -> DataFrame:
    """Loans and overdue share before and after each kind of life event of the same customer."""
    near = near_events(loans, ts, life_events, before, after, key=KEY)
    return near.groupBy("event_type", "phase").agg(
        F.count(F.lit(1)).alias("loans"),
        F.avg(F.when(overdue, 1.0).otherwise(0.0)).alias("overdue_rate"),
    )


def similar_cases(
    targets: DataFrame, history: DataFrame, vec_col: str, outcomes: DataFrame, k: int = 5, **kw
) -> DataFrame:
    """The k most similar customers of each target, with their key features and outcomes."""
    near = similar(targets, history, vec_col, k, **kw)
    return near.join(outcomes.withColumnRenamed(KEY, "neighbour"), "neighbour", "left")


def case_vote(cases: DataFrame, default_col: str = "loan_default") -> DataFrame:
    """Share of good outcomes among the cases and what it suggests.

    Of five: four good ones hint at approval, three bad ones call for caution.
    """
    votes = cases.groupBy(KEY).agg(
        F.count(default_col).alias("cases"), F.sum(default_col).cast("bigint").alias("bad")
    )
    good = F.col("cases") - F.col("bad")
    return votes.withColumns(
        {
            "good_share": F.try_divide(good.cast("double"), F.col("cases")),
            "advice": F.when(good * 5 >= F.col("cases") * 4, "approve")
            .when(F.col("bad") * 5 >= F.col("cases") * 3, "caution")
            .otherwise("review"),
        }
    )


def lookalike(
    df: DataFrame, good: DataFrame, vec_col: str, dim: int, k: int
) -> DataFrame:
    """The k customers outside ``good`` closest to its mean vector (k is the report's length).

    Ordering with a limit keeps k rows per task and merges those.
    """
    rest = df.join(good.select(KEY), KEY, "left_anti")
    scored = near_centroid(rest, good, vec_col, dim)
    return scored.orderBy(F.col("similarity").desc(), F.col(KEY)).limit(k)
