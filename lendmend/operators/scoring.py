"""Scorecard, score validation and risk tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendmend.functions.bands import edge_band, grade, policy
from lendmend.functions.scorecard import score
from lendmend.operators.ranked import share_cuts


def scorecard(df: DataFrame, p_col: str = "p", base: float = 2.0, weight: float = 1.0) -> DataFrame:
    """Points, grade and policy from a default probability."""
    return (
        df.withColumn("score", score(p_col, base, weight))
        .withColumn("grade", grade("score"))
        .withColumn("policy", policy("grade"))
    )


def score_band_default_rate(
    scored: DataFrame,
    edges: list[float],
    score_col: str = "score",
    label: str = "loan_default",
) -> DataFrame:
    """Default rate per score band, and whether it is no higher than in the band below."""
    bands = (
        scored.withColumn("band", edge_band(score_col, edges))
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg(F.col(label).cast("double")).alias("default_rate"),
        )
    )
    below = F.lag("default_rate").over(W.orderBy("band"))  # one row per band
    return bands.withColumn(
        "monotone", below.isNull() | (F.col("default_rate") <= below)
    )


def validate_scores(
    scored: DataFrame, edges: list[float], score_col: str = "score", label: str = "loan_default"
) -> DataFrame:
    """One row: number of bands, whether the default rate falls with every band, AUC."""
    from lendmend.operators.models import auc

    bands = score_band_default_rate(scored, edges, score_col, label)
    # A high score means low risk, so the AUC is taken on the negated score.
    area = auc(scored.withColumn("_risk", -F.col(score_col)), label, "_risk").first()["auc"]
    return bands.agg(
        F.count(F.lit(1)).alias("bands"), F.every("monotone").alias("monotone")
    ).withColumn("auc", F.lit(area).cast("double"))


def risk_tier(
    df: DataFrame, p: str = "p", shares: tuple[float, float] = (0.7, 0.9)
) -> DataFrame:
    """low / mid / high by population share: the safest 70 %, the next 20 %, the rest."""
    low, mid = share_cuts(df, p, list(shares))
    return df.withColumn("tier", tier_by_cut(F.col(p), low, mid))


def tier_by_cut(p: Column, low: float | None, mid: float | None) -> Column:
    """Tier by fixed thresholds (upper ends, inclusive)."""
    out = None
    for name, end in (("low", low), ("mid", mid)):
        if end is not None:
            out = F.when(p <= end, name) if out is None else out.when(p <= end, name)
    out = F.when(p.isNotNull(), "high") if out is None else out.when(p.isNotNull(), "high")
    return out
