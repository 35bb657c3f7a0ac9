import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendmend.operators import factors, repair, rules
from lendmend.operators.combine import masked_truth
from lendmend.sources.zones import shared_dir
from workload import planted

COLS = ["age", "grade", "work"]


def example(spark, extra=()):
    data = (
        [("salaried", "middle", "good")] * 9
        + [("salaried", "middle", "fair")] * 3
        + [("salaried", "young", "fair")] * 4
        + [("self", "middle", "fair")] * 4
        + list(extra)
    )
    return spark.createDataFrame(
        [(i, *d) for i, d in enumerate(data)], "customer_id int, work string, age string, grade string"
    )


GAPS = [("salaried", "middle", None), ("self", "middle", None), ("salaried", "old", None), (None, None, None)]


@pytest.mark.parametrize("extra", [(), tuple(GAPS)])
def test_example_rules(spark, extra):
    """Rows without the grade do not count against its rules."""
    got = {
        (tuple(r["antecedent"]), r["value"]): (round(r["confidence"], 6), round(r["support"], 6))
        for r in rules.rules(example(spark, extra), COLS, ["grade"], 0.1, 0.6).collect()
    }
    assert got == {
        (("age:middle", "work:salaried"), "good"): (0.75, 0.45),
        (("age:young",), "fair"): (1.0, 0.2),
        (("age:young", "work:salaried"), "fair"): (1.0, 0.2),
        (("work:self",), "fair"): (1.0, 0.2),
        (("age:middle", "work:self"), "fair"): (1.0, 0.2),
    }


def test_example_repairs(spark):
    df = example(spark, GAPS)
    table = rules.rules(df, COLS, ["grade"], 0.1, 0.6)
    got = rules.repair_by_rule(df, table, ["grade"], COLS)
    assert {(r["customer_id"], r["value"], round(r["confidence"], 6)) for r in got.collect()} == {
        (20, "good", 0.75), (21, "fair", 1.0)
    }


def test_own_support_for_a_rare_target(spark):
    df = example(spark, [("retired", "old", "poor")])
    common = rules.rules(df, COLS, ["grade"], 0.1, 0.6)
    rare = rules.rules(df, COLS, ["grade"], {"grade": 0.01}, 0.6)
    assert common.where("value = 'poor'").isEmpty() and not rare.where("value = 'poor'").isEmpty()


def test_rule_measures(spark):
    data = [(i, "f", "a", "a" if i < 6 else "b" if i == 6 else None, 0.8) for i in range(10)]
    df = spark.createDataFrame(data, "customer_id int, feature string, truth string, repaired string, confidence double")
    r = repair.rule_metrics(df).first()
    assert (r["masked"], r["repaired"], r["coverage"]) == (10, 7, 0.7)
    assert r["accuracy"] == pytest.approx(6 / 7) and r["mean_confidence"] == pytest.approx(0.8)


def test_number_measures_leave_zero_truth_out(spark):
    df = spark.createDataFrame([(1, "f", "0", "1"), (2, "f", "10", "11")], "customer_id int, feature string, truth string, repaired string")
    r = repair.als_metrics(df).first()
    assert (r["mape"], r["zero_truth"], r["rmse"]) == (pytest.approx(0.1), 1, 1.0)


def test_planted_rules_are_recovered(spark):
    df = planted.grades(spark, 4000).cache()
    masked, hidden = repair.mask(df, ["grade"], 0.2)
    table = rules.rules(masked, COLS, ["grade"], 0.1, 0.6)
    got = rules.repair_by_rule(masked, table, ["grade"], COLS)
    m = repair.rule_metrics(masked_truth(got, repair.to_cells(df, ["grade"]), hidden)).first()
    assert m["accuracy"] > 0.8 and m["coverage"] >= 0.6
    share = hidden.count() / df.count()
    assert 0.17 < share < 0.23


def test_mask_hides_exactly_the_listed_cells(spark):
    df = planted.grades(spark, 500).cache()
    masked, hidden = repair.mask(df, ["grade", "work"], 0.2, seed=5)
    gone = masked.select("customer_id", F.col("grade").isNull().alias("g"), F.col("work").isNull().alias("w"))
    n = gone.agg(F.count_if("g") + F.count_if("w")).first()[0]
    assert n == hidden.count() > 0 and masked.count() == df.count()


def test_planted_matrix_is_recovered(spark):
    names = [f"f{i}" for i in range(12)]
    df = planted.low_rank(spark, 400, 12).cache()
    truth = repair.to_cells(df, names)
    draw = repair.percent_draw("customer_id", "feature", seed=3)
    hidden = truth.select("customer_id", "feature").where(draw < 15)
    hide = hidden.groupBy("customer_id").agg(F.collect_set("feature").alias("h"))
    seen = df.join(hide, "customer_id", "left").select(
        "customer_id",
        *[F.when(~F.coalesce(F.array_contains("h", n), F.lit(False)), F.col(n)).alias(n) for n in names],
    ).cache()
    r = factors.to_ratings(seen, names)
    model = factors.als_fit(r, rank=5, iterations=10)
    gaps = factors.empty_cells(seen, r)
    got = factors.als_repair(model, gaps, r)
    m = repair.als_metrics(masked_truth(got, truth, hidden), ()).first()
    assert m["rmse_sd"] < 0.3 and m["coverage"] > 0.9
    near = factors.knn_repair(model, gaps, r, k=20)
    k = repair.als_metrics(masked_truth(near, truth, hidden), ()).first()
    assert k["rmse_sd"] < 0.8 and k["coverage"] > 0.9


def test_new_customers_are_folded_in(spark):
    """Factors of some customers repair others, and equal a ridge solution written out by hand."""
    names = [f"f{i}" for i in range(12)]
    df = planted.low_rank(spark, 600, 12).cache()
    truth = repair.to_cells(df, names)
    hidden = truth.select("customer_id", "feature").where("customer_id >= 400").where(repair.percent_draw("customer_id", "feature", seed=3) < 15)
    hide = hidden.groupBy("customer_id").agg(F.collect_set("feature").alias("h"))
    seen = df.join(hide, "customer_id", "left").select(
        "customer_id",
        *[F.when(~F.coalesce(F.array_contains("h", n), F.lit(False)), F.col(n)).alias(n) for n in names],
    ).cache()
    r = factors.to_ratings(seen.where("customer_id < 400"), names)
    model = factors.als_fit(r, rank=5, iterations=10)
    folding = factors.fold_in(model, r)
    got = factors.fold_in_repair(folding, seen, r).cache()
    m = repair.als_metrics(masked_truth(got, truth, hidden), ()).first()
    assert m["rmse_sd"] < 0.3 and m["coverage"] > 0.9
    assert got.where("customer_id < 400").isEmpty()
    assert got.count() == seen.where("customer_id >= 400").agg(sum(F.count_if(F.col(n).isNull()) for n in names)).first()[0]

    items = np.array([x["features"] for x in sorted(model.itemFactors.collect())])
    rows = {x["customer_id"]: x for x in r.scaler.transform(seen).where("customer_id >= 590").collect()}
    for g in got.where("customer_id >= 590").collect():
        x = np.array([np.nan if v is None else v for v in (rows[g["customer_id"]][f"{n}_std"] for n in names)])
        v = items[np.isfinite(x)]
        user = np.linalg.solve(v.T @ v + 0.1 * len(v) * np.eye(5), v.T @ x[np.isfinite(x)])
        mean, sd = r.scaler.stats[g["feature"]]
        assert g["value"] == pytest.approx(mean + sd * float(user @ items[names.index(g["feature"])]), rel=1e-9)


def test_folding_in_without_numbers_or_id(spark):
    products = np.array([[2.0, 1.0, 0.0], [1.0, 2.0, 0.0], [0.0, 0.0, 0.0]])
    cells = np.array([[1.0, np.nan, 5.0], [np.nan, np.nan, 5.0], [np.nan, np.nan, np.nan]])
    out = factors.FoldIn(products, 0.5).predicted(cells)
    assert out[0, 1] == pytest.approx(1 / 2.5) and np.isnan(out[0, 2])  # a feature without factors neither tells nor is told
    assert np.isnan(out[1:]).all()

    names = ["f0", "f1", "f2"]
    df = planted.low_rank(spark, 200, 3, known=1.0)
    r = factors.to_ratings(df, names)
    folding = factors.fold_in(factors.als_fit(r, rank=2, iterations=3), r)
    rows = spark.createDataFrame(
        [("a", 3, None, 100.0, 100.0), ("b", None, None, 100.0, None), ("c", 9999, None, None, None), ("d", 9999, 1.0, 2.0, 3.0)],
        "application_id string, customer_id long, f0 double, f1 double, f2 double",
    )
    got = factors.fold_in_repair(folding, rows, r, "application_id", "customer_id").collect()
    assert sorted((g["application_id"], g["feature"]) for g in got) == [("b", "f0"), ("b", "f2")]
    assert factors.fold_in_repair(folding, rows.limit(0), r, "application_id", "customer_id").isEmpty()


def test_router_fills_and_tells_how(spark):
    df = planted.grades(spark, 600).join(planted.low_rank(spark, 600, 5), "customer_id")
    df = df.withColumn("grade", F.when(F.col("customer_id") % 7 != 0, F.col("grade"))).cache()
    names = [f"f{i}" for i in range(5)]
    model = repair.fit_repair(df, ["grade"], names, COLS, rank=4, check_share=0.2)
    out = model.repair(df).cache()
    assert out.count() == 600 and out.columns[: len(df.columns)] != []
    left = out.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    assert sum(left) == 0
    methods = {m for r in out.where("repairs IS NOT NULL").collect() for m in [x["method"] for x in r["repairs"]]}
    assert methods == {"rule", "als"}
    changed = out.join(df.select("customer_id", F.col("f0").alias("old")), "customer_id").where("old IS NOT NULL AND old <> f0")
    assert changed.isEmpty()
    new = df.where("customer_id < 200").withColumn("customer_id", F.col("customer_id") + 10_000)
    told = model.cells(new).where("method <> 'rule'").cache()
    assert told.where("method <> 'fold-in' or confidence is null or confidence not between 0 and 1").isEmpty()
    gaps = new.agg(sum(F.count_if(F.col(n).isNull()) for n in names)).first()[0]
    assert gaps - 5 < told.count() <= gaps > 100  # a row may lack all numbers
    answers = repair.repair_request(model, df.where("customer_id < 50"))
    assert {"customer_id", "feature", "value", "method", "confidence", "evidence"} == set(answers.columns)


def test_cold_start(spark):
    df = spark.createDataFrame([(1, None, None, 1.0), (2, 1.0, None, 1.0)], "customer_id int, a double, b double, c double")
    assert [r["customer_id"] for r in repair.cold_start_report(df, ["a", "b", "c"]).collect()] == [1]


def test_compare_methods(spark):
    a = spark.createDataFrame([(1, "w", "x", "x", 0.9)], "customer_id int, feature string, truth string, repaired string, confidence double")
    b = spark.createDataFrame([(1, "n", "10", "12")], "customer_id int, feature string, truth string, repaired string")
    got = {r["method"]: r for r in repair.compare_methods({"rule": a, "als": b}).collect()}
    assert got["rule"]["accuracy"] == 1.0 and got["rule"]["rmse"] is None and got["als"]["rmse"] == 2.0


def test_factors_are_fitted_with_one_iteration_on_disk(spark, monkeypatch):
    """The item factors are written after each iteration, so that its shuffle files can go."""
    told, plain = {}, factors.ALS
    monkeypatch.setattr(factors, "ALS", lambda **kw: told.update(kw) or plain(**kw))
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)], "customer_id int, a double, b double")
    factors.als_fit(factors.to_ratings(df, ["a", "b"]), rank=2, iterations=2)
    assert told["checkpointInterval"] == 1 and spark.sparkContext.getCheckpointDir()


def test_a_fit_leaves_only_what_its_model_reads(spark):
    rows = [(i, float(i % 7), None if i % 9 == 0 else float(i % 5), "x" if i % 2 else "y") for i in range(90)]
    df = spark.createDataFrame(rows, "customer_id int, a double, b double, c string")
    before = set(os.listdir(shared_dir(spark)))
    model = repair.fit_repair(df, [], ["a", "b"], [], rank=2, iterations=2, check_share=0.3)
    new = [name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before]
    assert sorted(n for n in new if n in ("repair-train", "users", "ratings")) == ["ratings", "users"]
    assert model.repair(df).where("a is null or b is null").isEmpty()


def test_neighbours_are_asked_for_wanted_features_only(spark):
    near = spark.createDataFrame([("t", "a", 0.5, "s"), ("t", "b", 0.5, "s")], "customer_id string, neighbour string, similarity double, feature string")
    seen = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 3.0), ("a", "r", 9.0)], "customer_id string, feature string, value double")
    assert [tuple(r) for r in factors.weighted_value(near, seen).collect()] == [("t", "s", 2.0)]
