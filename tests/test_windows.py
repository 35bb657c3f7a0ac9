import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendmend.operators import features
from lendmend.operators.keyed import previous_instant, trailing
from lendmend.operators.ranked import running_by_value, share_cuts
from lendmend.operators.scoring import risk_tier

LOANS = "customer_id string, disbursed_date timestamp, disbursed_amount double"


def day(text):
    return dt.datetime.fromisoformat(text)


def loans(spark, dates):
    return spark.createDataFrame([("c", day(d), 10.0) for d in dates], LOANS)


def test_trailing_three_months(spark):
    df = loans(spark, ["2024-01-01", "2024-03-31", "2024-04-01", "2024-04-01", "2024-07-01"])
    out = features.trailing_loans(df, (3,))
    got = sorted((r["disbursed_date"], r["cnt_3m"], r["amt_3m"]) for r in out.collect())
    assert [c for _, c, _ in got] == [0, 1, 2, 2, 2]
    assert [a for _, _, a in got] == [0.0, 10.0, 20.0, 20.0, 20.0]


def plain_frames(df, spans, current):
    """The definition, by Spark's own sliding frames."""
    for name, span in spans.items():
        w = "PARTITION BY customer_id ORDER BY disbursed_date RANGE BETWEEN"
        own = f"({w} CURRENT ROW AND CURRENT ROW)"
        all_ = f"({w} INTERVAL {span} PRECEDING AND CURRENT ROW)"
        less = lambda f: "" if current else f" - {f} OVER {own}"  # noqa: B023, E731
        df = df.withColumn(f"cnt_{name}", F.expr(f"count(1) OVER {all_}{less('count(1)')}"))
        df = df.withColumn(f"amt_{name}", F.expr(f"sum(disbursed_amount) OVER {all_}{less('sum(disbursed_amount)')}"))
    return df


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400), st.integers(0, 3)), min_size=1, max_size=40))
def test_trailing_equals_sliding_frames(spark, rows, picks):
    start = day("2023-01-29")
    data = [(f"c{c}", start + dt.timedelta(days=d, hours=6 * h), float(d)) for c, d, h in picks]
    df = spark.createDataFrame(data, LOANS)
    spans = {"2m": "2 MONTH", "9d": "9 DAY"}
    args = ("customer_id", "disbursed_date", spans, "disbursed_amount")
    for current in (False, True):
        plain = plain_frames(df, spans, current)
        assert rows(plain) == rows(trailing(df, *args, include_current=current).select(plain.columns))
    got = {(r[0], r[1]): r[3] for r in previous_instant(df, "customer_id", "disbursed_date").collect()}
    for c, t in got:
        assert got[c, t] == max((u for k, u, _ in data if k == c and u < t), default=None)


def test_null_keys_and_times_stay(spark):
    rows = [("a", day("2024-01-01"), 1.0), ("a", None, 2.0), (None, day("2024-01-02"), 3.0), (None, None, 4.0),
            ("a", day("2024-01-05"), None), (None, day("2024-01-02"), 3.0)]
    df = spark.createDataFrame(rows, LOANS)
    out = trailing(df, "customer_id", "disbursed_date", {"9d": "9 DAY"}, "disbursed_amount", previous="before")
    got = [(r[0], r[1], r[3], r[4], r[5]) for r in out.collect()]
    assert len(got) == 6 and ("a", day("2024-01-05"), 1, 1.0, day("2024-01-01")) in got
    assert all((n, a, b) == (0, 0.0, None) for k, t, n, a, b in got if k is None or t is None)


def test_one_key_with_a_third_of_all_rows(spark):
    """Every row's window holds most of the key: sliding frames would be quadratic here."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("customer_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("disbursed_date"),
        F.lit(0.1).alias("disbursed_amount"),
    )
    out = features.trailing_loans(df, (12,)).where("customer_id = 'hot'")
    got = out.agg(F.count("*"), F.max("cnt_12m"), F.sum("cnt_12m"), F.max("amt_12m")).first()
    assert tuple(got) == (20_000, 19_999, 19_999 * 10_000, 1999.9)


def test_burst(spark):
    df = spark.createDataFrame(
        [("c", day(f"2024-01-0{d}")) for d in (1, 3, 4, 9)], "customer_id string, apply_time timestamp"
    )
    out = features.application_burst(df, n=3, days=5).orderBy("apply_time").collect()
    assert [r["burst"] for r in out] == [False, False, True, False]
    assert [r["gap_seconds"] for r in out] == [None, 172800.0, 86400.0, 432000.0]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.booleans())
def test_running_counts(spark, values, down):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = running_by_value(df, "v", {"n": F.count(F.lit(1))}, descending=down, ranges=5)
    for r in out.collect():
        before = [x for x in values if (x >= r["v"] if down else x <= r["v"])]
        assert (r["cum_n"], r["all_n"]) == (len(before), len(values))
        assert r["n"] == values.count(int(r["v"]))


def test_tiers_hold_their_shares(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") / 1000).alias("p"))
    got = {r["tier"]: r["count"] for r in risk_tier(df).groupBy("tier").count().collect()}
    assert got == {"low": 700, "mid": 200, "high": 100}
    low, mid = share_cuts(df, "p", [0.7, 0.9])
    assert (low, mid) == (0.699, 0.899)


def test_tiers_when_one_value_holds_everything(spark):
    df = spark.range(50).select(F.lit(0.2).alias("p"))
    assert {r["tier"] for r in risk_tier(df).collect()} == {"high"}
