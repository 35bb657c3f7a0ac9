from pyspark.sql import functions as F

from lendmend.operators import scoring, sketches
from lendmend.operators.ranked import share_cuts


def shares_at(df, cuts):
    n = df.where("p is not null").count()
    return [df.where(F.col("p") <= c).count() / n for c in cuts]


def test_merged_parts_stay_within_the_rank_error(spark):
    df = spark.range(0, 60_000, 1, 8).select("id", F.pow(F.rand(1), 3).alias("p")).cache()
    whole = sketches.score_sketches(df, F.lit(0))
    days = sketches.score_sketches(df, F.col("id") % 31)
    assert days.count() == 31 and days.agg(F.sum("rows")).first()[0] == 60_000
    for parts in (whole, days, days.where("part < 7")):
        seen = df if parts is not days else df
        rows = seen if parts in (whole, days) else df.where("id % 31 < 7")
        for got, want in zip(shares_at(rows, sketches.sketched_cuts(parts)), (0.7, 0.9), strict=True):
            assert abs(got - want) <= sketches.rank_error()
    assert sketches.rank_error() < 0.01
    both = sketches.sketched_tier(df, days).select("id", F.col("tier").alias("t")).join(scoring.risk_tier(df), "id")
    assert both.where("t <> tier").count() <= 2 * sketches.rank_error() * 60_000


def test_ties_nulls_and_no_rows(spark):
    rows = [(1, 0.5)] * 50 + [(1, None), (2, float("nan"))] + [(2, 0.2)] * 10
    df = spark.createDataFrame(rows, "day int, p double")
    parts = sketches.score_sketches(df, "day")
    assert {r["part"]: r["rows"] for r in parts.collect()} == {1: 50, 2: 10}
    exact = share_cuts(df.where("not isnan(p)"), "p", [0.7, 0.9])
    assert sketches.sketched_cuts(parts) == exact == [0.2, 0.2]
    assert sketches.sketched_cuts(parts.where("part = 1")) == [None, None]
    assert sketches.sketched_cuts(parts.where("part = 9")) == [None, None]
    small = spark.range(10).select((F.col("id") / 10).alias("p"))
    assert sketches.sketched_cuts(sketches.score_sketches(small, F.lit(1))) == share_cuts(small, "p", [0.7, 0.9])
