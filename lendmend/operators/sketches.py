"""Risk tiers from mergeable quantile sketches of the scores.

A day or batch keeps one small sketch of its probabilities; sketches of any period are merged without
looking at the scores again, and give the cut-offs that a live decision is put into its tier by. The
exact way is ``scoring.risk_tier``, which sorts all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.operators.scoring import tier_by_cut

SIZE = 800  # parameter k of the sketches
GRID = 1000  # ranks at which a sketch is read


def rank_error(size: int = SIZE) -> float:
    """Bound of the error in rank, as a share of all rows, of a sketch or a merged one and of reading it on the
    grid. A single rank stays within 2.3 / k^0.9 with a probability of 99 %."""
    return 2.3 / size**0.9 + 1.0 / GRID


def score_sketches(scored: DataFrame, by: str | Column, p: str = "p", size: int = SIZE) -> DataFrame:
    """(part, rows, sketch): one row for each day or batch; null and nan scores do not count.

    Sketches are built inside the map tasks and merged, so the scores are not shuffled.
    """
    part = F.col(by) if isinstance(by, str) else by
    known = scored.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))
    return known.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double(F.col(p).cast("double"), F.lit(size)).alias("sketch")
    )


def merged(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """(rows, sketch) of the given parts together: one row."""
    return sketches.agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketched_cuts(sketches: DataFrame, shares: tuple[float, ...] = (0.7, 0.9)) -> list[float | None]:
    """For each share the largest value seen on the grid that no more than this share of the rows reaches;
    null if even the smallest value is too frequent, or there are no rows. As ``share_cuts``, but for the rank error."""
    row = merged(sketches).first()  # some ten kilobytes, whatever the number of rows
    if row is None or not row["rows"]:
        return [None] * len(shares)
    one = sketches.sparkSession.createDataFrame([(row["sketch"],)], "sketch binary")
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    values = sorted(set(one.select(F.kll_sketch_get_quantile_double("sketch", grid)).first()[0]))
    ranks = one.select(F.kll_sketch_get_rank_double("sketch", F.array(*map(F.lit, values)))).first()[0]
    return [max((v for v, r in zip(values, ranks, strict=True) if r <= s + 1e-12), default=None) for s in shares]


def sketched_tier(df: DataFrame, sketches: DataFrame, p: str = "p", shares: tuple[float, float] = (0.7, 0.9)) -> DataFrame:
    """``df`` with the tier low, mid or high by the cut-offs of the sketched scores."""
    low, mid = sketched_cuts(sketches, shares)
    return df.withColumn("tier", tier_by_cut(F.col(p), low, mid))
