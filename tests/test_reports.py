import datetime as dt

from pyspark.sql import functions as F

from lendmend.operators import combine, customers
from lendmend.plans import reports

D = dt.datetime


def test_area_colours_count_customers(spark):
    rows = [(i, "r", 1 if i < 1 else 0) for i in range(10)] + [(i, "y", 1 if i < 1 else 0) for i in range(20)]
    rows += [(i, "g", 0) for i in range(3)]
    df = spark.createDataFrame(rows, "customer_id int, area_id string, loan_default int")
    got = {r["area_id"]: (r["heat"], r["action"]) for r in reports.area_policy(reports.area_default_rate(df)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"r": "red", "y": "yellow", "g": "green"}
    assert got["g"][1] == "expand"


def test_snapshots_look_back(spark, tmp_path):
    root = str(tmp_path)
    for ts, n in (("2024-01-01 08:00:00", 1), ("2024-01-01 08:05:00", 2)):
        reports.snapshot({"k": spark.createDataFrame([(n,)], "n int")}, root, ts)
    reports.snapshot({"k": spark.createDataFrame([(5,)], "n int")}, root, "2024-01-01 08:05:00")  # repeated
    at = lambda ts: [r["n"] for r in reports.dashboard_at(spark, root, ["k"], ts)["k"].collect()]
    assert at("2024-01-01 08:04:59") == [1] and at("2024-01-01 09:00:00") == [5]
    assert at("2023-01-01") == []


def test_roles_see_their_panels(spark):
    loans = spark.createDataFrame(
        [("c", 1.0, D(2024, 1, 1), 0)], "customer_id string, disbursed_amount double, disbursed_date timestamp, overdue_cnt int"
    )
    people = spark.createDataFrame([("c", "a", 1, 600)], "customer_id string, area_id string, loan_default int, credit_score int")
    scored = people.withColumn("tier", F.lit("low"))
    pred = spark.createDataFrame([(D(2024, 1, 1), 1, 1)], "ts timestamp, predicted int, label int")
    rep = spark.createDataFrame([(D(2024, 1, 1), True)], "ts timestamp, repaired boolean")
    args = (people, loans, scored, pred, rep, "2024-01-31")
    assert set(reports.dashboard(*args, role="technical")) == {"model_monitor"}
    every = reports.dashboard(*args)
    assert {"kpis", "tiers", "area_heat", "score_histogram"} <= set(every)
    assert every["kpis"].first()["new_customers"] == 1


def test_alert_by_threshold_and_by_jump(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([0.1, 0.1, 0.1, 0.3])], "m int, rate double")
    fixed = reports.alert_rate_jump(df, "rate", "m", threshold=0.2).orderBy("m").collect()
    jump = reports.alert_rate_jump(df, "rate", "m", n=3, factor=2.0).orderBy("m").collect()
    assert [r["alert"] for r in fixed] == [r["alert"] for r in jump] == [False, False, False, True]


def test_near_events_by_key(spark):
    loans = spark.createDataFrame(
        [("a", D(2024, 1, 15)), ("a", D(2024, 6, 1)), ("b", D(2024, 1, 15)), ("a", D(2023, 12, 31))],
        "customer_id string, ts timestamp",
    )
    events = spark.createDataFrame([("a", D(2024, 1, 15), "move")], "customer_id string, event_ts timestamp, event_type string")
    got = combine.near_events(loans, "ts", events, 1, 1, key="customer_id")
    assert {(r["customer_id"], r["ts"].date().isoformat(), r["phase"]) for r in got.collect()} == {
        ("a", "2024-01-15", "after"), ("a", "2023-12-31", "before")
    }


def test_timeline_colours_and_order(spark):
    t = D(2024, 1, 1)
    df = spark.createDataFrame([("c", t, 5.0, 12, 0.1)], "customer_id string, ts timestamp, amount double, term int, rate double")
    pay = spark.createDataFrame(
        [("c", t + dt.timedelta(i), 5.0, n) for i, n in enumerate((0, 1, 3))], "customer_id string, ts timestamp, amount double, overdue_cnt int"
    )
    out = customers.timeline_order(customers.timeline(df, df, pay, df.limit(0))).collect()
    assert [(r["event"], r["colour"]) for r in out] == [
        ("application", "grey"), ("disbursement", "grey"), ("repaid_on_time", "green"), ("overdue", "yellow"), ("severe_default", "red")
    ]


def test_improvement(spark):
    rows = [("a", D(2023, 1, 1), 1), ("a", D(2023, 2, 1), 0), ("a", D(2024, 1, 1), 0), ("b", D(2023, 1, 1), 0), ("b", D(2023, 9, 1), 2)]
    df = spark.createDataFrame(rows, "customer_id string, ts timestamp, overdue_cnt int")
    got = {r["customer_id"]: r["trend"] for r in customers.improvement_trend(df, "ts", F.col("overdue_cnt") > 0).collect()}
    assert got == {"a": "improving", "b": "worsening"}


def test_segments_are_named_by_score(spark):
    df = spark.range(300).select(
        F.col("id").alias("customer_id"),
        (F.pmod("id", F.lit(3)) * 200 + 300 + F.rand(1)).alias("score"),
        (F.pmod("id", F.lit(3)) * 1000 + F.rand(2)).alias("amount"), F.rand(3).alias("overdue_rate"),
    )
    model = customers.fit_segments(df, k=3, cols=("score", "amount"))
    got = model.transform(df).groupBy("cluster").agg(F.avg("score").alias("s"), F.count("*").alias("n")).orderBy("cluster").collect()
    assert [r["n"] for r in got] == [100, 100, 100] and [r["s"] for r in got] == sorted((r["s"] for r in got), reverse=True)
