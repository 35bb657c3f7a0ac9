"""Column functions against hand-computed values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendmend.functions import bands, dates, metrics, payload, ratios, vectors
from lendmend.functions.items import item_attr, item_value, items
from lendmend.functions.scorecard import score
from lendmend.operators.scoring import scorecard


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_ratios_give_null_on_zero(spark):
    lit = F.lit
    assert one(spark, ratios.debt_ratio(lit(50), lit(200))) == 0.25
    for f in (ratios.debt_ratio, ratios.overdue_rate, ratios.account_util, ratios.ltv, ratios.repay_pressure):
        assert one(spark, f(lit(1), lit(0))) is None


def test_weekday_of_a_sunday(spark):
    row = spark.sql("SELECT DATE '2024-01-07' AS d").select(*dates.date_parts("d")).first()
    assert tuple(row) == (2024, 1, 1, 6)


@pytest.mark.parametrize(
    "p, points",
    [(1 / 2, 600), (1 / 3, 650), (1 / 9, 750), (1 / 33, 850), (0.01, 850), (2 / 3, 550), (0.99, 300)],
)
def test_score_points(spark, p, points):
    assert one(spark, score(F.lit(p))) == pytest.approx(points)


def test_score_undoes_class_weight(spark):
    assert one(spark, score(F.lit(0.9), weight=9)) == pytest.approx(600)


def test_natural_log_base(spark):
    assert one(spark, score(F.lit(1 / 3), base=math.e)) == pytest.approx(634.657, abs=1e-3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=2, max_size=30))
def test_score_is_monotone_and_bounded(spark, ps):
    df = spark.createDataFrame([(float(p),) for p in ps], "p double")
    got = [tuple(r) for r in scorecard(df).select("p", "score").orderBy("p").collect()]
    assert all(300 <= s <= 850 for _, s in got)
    assert all(a[1] >= b[1] for a, b in zip(got, got[1:]))


def test_bands(spark):
    ages = [one(spark, bands.age_group(F.lit(a))) for a in (18, 29, 30, 49, 50)]
    assert ages == ["young", "young", "middle", "middle", "old"]
    grades = [one(spark, bands.grade(F.lit(s))) for s in (549, 550, 649, 650, 749, 750)]
    assert grades == ["poor", "fair", "fair", "good", "good", "excellent"]
    heats = [one(spark, bands.heat(F.lit(r))) for r in (0.10, 0.0999, 0.05, 0.0499)]
    assert heats == ["red", "yellow", "yellow", "green"]
    assert one(spark, bands.heat(F.lit(None).cast("double"))) is None
    assert one(spark, bands.grade(F.lit(None).cast("int"))) is None
    assert one(spark, bands.policy(F.lit("poor"))) == "guarantee required or reject"


def test_edge_band(spark):
    got = [one(spark, bands.edge_band(F.lit(x), [1, 2, 5])) for x in (0, 1, 1.5, 2, 4.9, 5, 9)]
    assert got == [0, 1, 1, 2, 2, 3, 3]


def test_items_skip_missing_values(spark):
    df = spark.createDataFrame([("a:b", None, 3)], "x string, y string, z int")
    got = df.select(items(["x", "y", "z"]).alias("i")).first()["i"]
    assert got == ["x:a:b", "z:3"]
    assert one(spark, item_attr(F.lit("x:a:b"))) == "x"
    assert one(spark, item_value(F.lit("x:a:b"))) == "a:b"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vectors.dot(a, b)) == 24
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vectors.unit(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.radar_area([F.lit(1.0)] * 5)) == pytest.approx(2.37764, abs=1e-5)
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_error_measures(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 11.0), (20.0, None)], "y double, yhat double")
    row = df.agg(
        metrics.rmse("y", "yhat").alias("rmse"), metrics.mape("y", "yhat").alias("mape"),
        metrics.zero_truth("y", "yhat").alias("zero"), metrics.coverage("yhat").alias("coverage"),
    ).first()
    assert (row["rmse"], row["mape"], row["zero"]) == (1.0, pytest.approx(0.1), 1)
    assert row["coverage"] == pytest.approx(2 / 3)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 2.0, 4.0), (1.0, 3.0, 6.0)], "c double, x double, y double")
    row = df.agg(metrics.pearson("c", "y").alias("c"), metrics.pearson("x", "y").alias("x")).first()
    assert row["c"] is None and row["x"] == pytest.approx(1.0)


def test_malformed_message_decodes_to_null(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("{broken",)], "v string")
    got = df.select(payload.decode("v", "k int")["k"].alias("k")).collect()
    assert [r["k"] for r in got] == [3, None]
