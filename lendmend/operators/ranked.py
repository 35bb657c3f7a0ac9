"""Running counts over a whole table in value order, without sending it to one task.

Rows are first combined per distinct value, then cut into value ranges of about equal numbers
of distinct values; ranges run in parallel and are tied together by their totals.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_RANGES = 4096


def default_ranges(spark: SparkSession) -> int:
    return min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_edges(df: DataFrame, col: str, ranges: int) -> list[float]:
    """Edges that cut ``df`` into about equal parts by ``col`` (a double).

    They only steer the split: any increasing edges give the same results.
    """
    cuts = df.approxQuantile(col, [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    return [float("-inf"), *sorted(set(cuts)), float("inf")]


def in_ranges(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Adds ``_range``, the number of the part that ``col`` falls into."""
    return Bucketizer(splits=edges, inputCol=col, outputCol="_range").transform(df)


def running_by_value(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """One row per distinct value: its measures, ``cum_<m>`` up to and with it, ``all_<m>``.

    ``measures`` are sum-like aggregates.
    """
    from lendmend.sources.zones import written

    signed = -F.col(value).cast("double") if descending else F.col(value).cast("double")
    per_value = (
        df.where(F.col(value).isNotNull())
        .groupBy(signed.alias("_v"))
        .agg(*[m.alias(name) for name, m in measures.items()])
    )
    # Read twice below: for the edges and for the counts.
    per_value = written(per_value, "per-value")
    edges = range_edges(per_value, "_v", ranges or default_ranges(df.sparkSession))
    cut = in_ranges(per_value, "_v", edges)
    totals = cut.groupBy("_range").agg(*[F.sum(m).alias(m) for m in measures])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # <= MAX_RANGES rows
    whole = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
    )
    within = W.partitionBy("_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(F.broadcast(offsets), "_range")  # bounded by MAX_RANGES
    back = -F.col("_v") if descending else F.col("_v")
    return out.select(
        back.alias(value),
        *measures,
        *[(F.sum(m).over(within) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def share_cuts(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact cut-offs: the largest value whose cumulative share of rows is <= each share."""
    cum = running_by_value(df, value, {"n": F.count(F.lit(1))})
    share = F.col("cum_n") / F.col("all_n")
    row = cum.agg(*[F.max(F.when(share <= s, F.col(value))) for s in shares]).first()
    return list(row)
