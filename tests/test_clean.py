import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendmend.operators import clean
from lendmend.schema import CUSTOMER_BASE, Rules, dictionary_of

T0 = dt.datetime(2024, 1, 1)


def test_typed_marks_failed_casts(spark, rows):
    df = spark.createDataFrame([("abc", "1"), ("", "2"), ("40", "x")], "age string, amount string")
    out = clean.typed(df, {"age": "int", "amount": "double"})
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "double", "array<string>"]
    assert rows(out) == sorted(
        [(None, 1.0, ["age"]), (None, 2.0, []), (40, None, ["amount"])], key=str
    )


def test_typed_takes_a_domain_dictionary(spark):
    df = spark.createDataFrame([tuple("1" for _ in CUSTOMER_BASE)], [f.name for f in CUSTOMER_BASE])
    out = clean.typed(df, dictionary_of(CUSTOMER_BASE))
    assert dict(out.dtypes)["has_mobile"] == "boolean" and out.first()["cast_errors"] == []


def test_age_rule(spark):
    df = spark.createDataFrame([(17,), (18,), (100,), (101,), (None,)], "age int")
    assert [r["bad_age"] for r in clean.flag_age(df).collect()] == [True, False, False, True, False]


def test_amount_rule(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.01,), (None,)], "a double")
    assert [r["a"] for r in clean.drop_nonpositive_amount(df, "a").collect()] == [0.01, None]


def test_rate_rule(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (36.0,), (36.1,), (None,)], "rate double")
    assert [r["bad_rate"] for r in clean.flag_rate(df).collect()] == [True, False, False, True, False]


@pytest.mark.parametrize("policy, fixed", [("null", None), ("abs", 2), ("zero", 0)])
def test_overdue_policies(spark, policy, fixed):
    df = spark.createDataFrame([(-2,), (3,)], "overdue_cnt int")
    assert [r[0] for r in clean.fix_overdue(df, policy=policy).collect()] == [fixed, 3]


LOAN = "customer_id string, loan_id string, apply_time timestamp, disbursed_amount double, term int, ingest_ts timestamp"


def test_dedup_keeps_newest_and_distinct_loans(spark):
    df = spark.createDataFrame(
        [
            ("c", "l1", T0, 100.0, 12, T0),
            ("c", "l2", T0, 100.0, 12, T0 + dt.timedelta(1)),
            ("c", "l3", T0, 200.0, 12, T0),
        ],
        LOAN,
    )
    assert sorted(r["loan_id"] for r in clean.dedup_latest(df).collect()) == ["l2", "l3"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 3)), min_size=1, max_size=25))
def test_dedup_is_idempotent(spark, rows, picks):
    data = [
        (f"c{c}", f"l{i}", T0 + dt.timedelta(t), 100.0, 12, T0 + dt.timedelta(n))
        for i, (c, t, n) in enumerate(picks)
    ]
    once = clean.dedup_latest(spark.createDataFrame(data, LOAN))
    assert rows(clean.dedup_latest(once)) == rows(once)
    assert once.count() == len({(d[0], d[2]) for d in data})


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(st.one_of(st.none(), st.integers(0, 120)), st.one_of(st.none(), st.floats(-5, 50))),
        min_size=1, max_size=25,
    )
)
def test_quarantine_partitions_the_input(spark, people):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "id int, age int, rate double")
    checks = {"age": clean.age_out_of_range(), "rate": clean.rate_out_of_range()}
    good, bad = clean.split_quarantine(df, checks)
    a, b = {r["id"] for r in good.collect()}, {r["id"] for r in bad.collect()}
    assert a | b == set(range(len(people))) and not a & b


def test_low_quality_is_strict(spark):
    cols = [f"f{i}" for i in range(10)]
    data = [(None,) * 5 + ("x",) * 5, (None,) * 6 + ("x",) * 4, ("",) * 6 + ("x",) * 4]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    out = clean.training_weight(clean.low_quality(clean.missing_count(df, cols), cols))
    got = [(r["missing_count"], r["low_quality"], r["training_weight"]) for r in out.collect()]
    assert got == [(5, False, 1.0), (6, True, 0.5), (6, True, 0.5)]


def test_missing_count_sees_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "a double, b int")
    assert clean.missing_count(df, ["a", "b"]).first()["missing_count"] == 1


def test_quality_report(spark, rows):
    df = spark.createDataFrame([(17, None), (30, "x")], "age int, w string")
    got = rows(clean.quality_report(df, ["age", "w"], {"age": clean.age_out_of_range()}))
    assert got == [("missing", "age", 0, 0.0), ("missing", "w", 1, 0.5), ("rule", "age", 1, 0.5)]


def test_whole_cleaning_pass(spark):
    df = spark.createDataFrame(
        [
            ("c", "l1", T0, 100.0, 12, T0, 5.0, -1),
            ("c", "l2", T0, 100.0, 12, T0 + dt.timedelta(1), 5.0, 0),
            ("c", "l3", T0, -1.0, 12, T0, 5.0, 0),
            ("c", "l4", T0, 5.0, 12, T0, 99.0, 0),
        ],
        LOAN + ", rate double, overdue_cnt int",
    )
    good, bad = clean.clean_loans(df, Rules())
    assert [r["loan_id"] for r in good.collect()] == ["l2"]
    assert [(r["loan_id"], r["reasons"]) for r in bad.collect()] == [("l4", ["rate"])]
    assert good.where(F.col("overdue_cnt") < 0).count() == 0
