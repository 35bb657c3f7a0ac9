import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from lendmend.functions.scorecard import unweighted
from lendmend.operators import boost, encode, explain, models, scoring, select
from lendmend.sources.zones import ModelStore
from workload import planted

X = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def fitted(spark):
    df = planted.defaults(spark, 6000).cache()
    draw = F.pmod(F.xxhash64("customer_id"), F.lit(10))
    train, test = df.where(draw < 7).cache(), df.where(draw >= 7).cache()
    imputer = encode.impute_with_flags(X).fit(train)
    rows = models.class_weight(imputer.transform(train), "loan_default")
    rows = rows.withColumn("valid", F.pmod(F.xxhash64("customer_id", F.lit(1)), F.lit(5)) == 0)
    model = models.train_default(
        rows, imputer.output_cols, depth=3, rounds=8, weight_col="class_weight", valid_flag="valid"
    )
    scored = models.probability(model.transform(imputer.transform(test))).cache()
    return train, test, imputer, model, scored


def test_signal_is_found_and_auc_is_exact(fitted):
    scored = fitted[4]
    ours = models.auc(scored, "loan_default").first()["auc"]
    # On raw scores, as the evaluator sees them; the probability is a monotone map of it.
    theirs = BinaryClassificationEvaluator(labelCol="loan_default", numBins=0).evaluate(scored)
    assert ours > 0.8 and ours == pytest.approx(theirs, abs=1e-9)


def test_random_labels_score_a_half(spark):
    df = spark.range(4000).select(F.rand(1).alias("p"), (F.rand(2) < 0.3).cast("int").alias("y"))
    assert models.auc(df, "y").first()["auc"] == pytest.approx(0.5, abs=0.04)


def test_metrics_and_threshold(spark):
    data = [(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0), (0.1, 1), (0.05, 0)]
    df = spark.createDataFrame(data, "p double, y int")
    m = models.classifier_metrics(df, "y", threshold=0.5).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (2, 1, 2, 1)
    assert m["precision"] == m["recall"] == m["f1"] == pytest.approx(2 / 3)
    assert m["auc"] == pytest.approx(6 / 9)
    best = models.cost_threshold(df, "y", fn_cost=5, fp_cost=1).first()
    assert (best["threshold"], best["cost"]) == (0.1, 2.0)
    none = models.cost_threshold(df, "y", fn_cost=0.1, fp_cost=10).first()
    assert (none["threshold"], none["cost"]) == (0.9, pytest.approx(0.2))


def test_combined_weights_cut_the_cost_and_are_undone(spark):
    df = planted.defaults(spark, 12_000).withColumn("training_weight", F.when(F.col("x1").isNull(), 0.5).otherwise(1.0)).cache()
    draw = F.pmod(F.xxhash64("customer_id"), F.lit(10))
    train, test = df.where(draw < 6), df.where(draw >= 6)
    rows, factor = models.combined_weight(train, "loan_default", 5.0, 1.0, "training_weight")
    fit = lambda d, **kw: boost.fit_boosted(d, X, "loan_default", depth=3, rounds=20, rate=0.4, **kw).transform(test).cache()
    heavy, plain = fit(rows, weight_col="weight"), fit(train)
    cost = lambda s: s.agg(
        F.sum(F.when((F.col("loan_default") == 1) & (F.col("p") < 0.5), 5.0).when((F.col("loan_default") == 0) & (F.col("p") >= 0.5), 1.0).otherwise(0.0))
    ).first()[0]
    # Without the class weights' share of the odds, one half is where rejecting begins to pay.
    assert cost(heavy.withColumn("p", unweighted("p", factor / 5.0))) < cost(plain)
    told = heavy.withColumn("q", unweighted("p", factor))
    mean = told.agg(F.avg("q"), F.avg(F.col("loan_default").cast("double"))).first()
    assert mean[0] == pytest.approx(mean[1], rel=0.2)
    high = told.where("q > 0.3").agg(F.avg("q"), F.avg(F.col("loan_default").cast("double"))).first()
    assert high[0] == pytest.approx(high[1], rel=0.3)
    points = told.select(scoring.score("p", weight=factor).alias("a"), scoring.score("q").alias("b"))
    assert points.where("abs(a - b) > 1e-6").isEmpty()


def test_forest_and_cross_validation(spark, fitted):
    train, _, imputer, _, _ = fitted
    learner = models.default_model(depth=3, rounds=5, kind="forest")
    est = Pipeline(stages=[models.assembler(imputer.output_cols), learner])
    grid = ParamGridBuilder().addGrid(learner.maxDepth, [2, 4]).build()
    cv = models.cross_validate(est, imputer.transform(train), grid, "loan_default", folds=3)
    assert max(cv.avgMetrics) > 0.75


def test_folds_hold_the_class_share(spark, fitted):
    train, _, imputer, _, _ = fitted
    rows = models.stratified_folds(train, "loan_default", folds=3, buckets=16).cache()
    assert rows.columns == [*train.columns, "fold"] and rows.count() == train.count()
    for y in (0, 1):
        sizes = [r["count"] for r in rows.where(F.col("loan_default") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1
    again = models.stratified_folds(train.repartition(5), "loan_default", folds=3, buckets=16)
    assert rows.select("customer_id", "fold").exceptAll(again.select("customer_id", "fold")).isEmpty()

    data = models.class_weight(imputer.transform(train), "loan_default").cache()
    learner = models.default_model(depth=2, rounds=3, kind="forest", weight_col="class_weight")
    est = Pipeline(stages=[models.assembler(imputer.output_cols), learner])
    grid = ParamGridBuilder().addGrid(learner.maxDepth, [2]).build()
    cv = models.cross_validate(est, data, grid, "loan_default", folds=3, key="customer_id", weight_col="class_weight")
    folded = models.stratified_folds(data, "loan_default", folds=3).cache()
    judge = BinaryClassificationEvaluator(labelCol="loan_default", weightCol="class_weight")
    by_hand = [judge.evaluate(est.fit(folded.where(F.col("fold") != f)).transform(folded.where(F.col("fold") == f))) for f in range(3)]
    assert cv.avgMetrics[0] == pytest.approx(sum(by_hand) / 3, abs=0.02) and cv.avgMetrics[0] > 0.7


def test_imputer_flags(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    model = encode.impute_with_flags(["a", "b"]).fit(df)
    got = [tuple(r)[2:] for r in model.transform(df).collect()]
    assert got == [(1.0, 0.0, 0.0, 1.0), (3.0, 0.0, 0.0, 1.0), (1.0, 0.0, 1.0, 1.0)] or got == [
        (1.0, 0.0, 0.0, 1.0), (3.0, 0.0, 0.0, 1.0), (1.0, 1.0, 0.0, 1.0)
    ]


def _margins(scored):
    return {r["customer_id"]: (r["rawPrediction"][1], r["probability"][1]) for r in scored.collect()}


def test_contributions_add_up_to_the_margin(fitted):
    _, _, imputer, model, scored = fitted
    shap = explain.shap_values(model.stages[-1], scored, imputer.output_cols)
    total = shap.groupBy("customer_id").agg((F.sum("shap") + F.max("base")).alias("t")).collect()
    margin = _margins(scored)
    for r in total:
        raw, p = margin[r["customer_id"]]
        assert r["t"] == pytest.approx(raw, abs=1e-6)
        assert p == pytest.approx(1 / (1 + math.exp(-2 * r["t"])), abs=1e-6)
    ranked = explain.shap_importance(shap).collect()
    assert {r["feature"] for r in ranked[:2]} == {"x1_filled", "x2_filled"}
    off = {r["feature"]: r["contradicts"] for r in explain.shap_sanity(shap, {"x1_filled": 1, "x2_filled": 1}).collect()}
    assert off == {"x1_filled": False, "x2_filled": True}
    first = explain.force(shap, total[0]["customer_id"]).collect()
    assert [abs(r["shap"]) for r in first] == sorted((abs(r["shap"]) for r in first), reverse=True)


def _expected(node, by_id, x, known):
    """Path-dependent expectation of one tree, features outside ``known`` averaged out."""
    if node.left < 0:
        return node.stats[1] / sum(node.stats)
    left, right = by_id[node.left], by_id[node.right]
    if node.feature in known:
        return _expected(left if x[node.feature] <= node.threshold[0] else right, by_id, x, known)
    return (
        left.cover * _expected(left, by_id, x, known) + right.cover * _expected(right, by_id, x, known)
    ) / node.cover


def test_contributions_equal_brute_force(spark):
    df = planted.defaults(spark, 1500).fillna({"x1": 0.0})
    model = models.train_default(df, X, kind="forest", depth=4, rounds=3)
    rows = model.stages[0].transform(df.where("customer_id < 5"))
    got = {
        (r["customer_id"], r["feature"]): r["shap"]
        for r in explain.shap_values(model.stages[-1], rows, X).collect()
    }
    nodes = explain.saved_nodes(model.stages[-1], spark)
    trees = [{r.id: r for r in part.itertuples()} for _, part in nodes.groupby("tree")]
    for row in rows.collect():
        x = [row[c] for c in X]

        def value(s):
            return np.mean([_expected(t[0], t, x, s) for t in trees])

        for i, f in enumerate(X):
            rest = [j for j in range(3) if j != i]
            phi = 0.0
            for n in range(3):
                for s in itertools.combinations(rest, n):
                    w = math.factorial(n) * math.factorial(2 - n) / math.factorial(3)
                    phi += w * (value({*s, i}) - value(set(s)))
            assert got[(row["customer_id"], f)] == pytest.approx(phi, abs=1e-9)


def test_deep_paths_add_up(spark):
    """Paths that test up to 15 features: contributions and base give the forest's probability."""
    names = [f"z{i}" for i in range(16)]
    df = spark.range(3000).select(
        F.col("id").alias("customer_id"), *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0).alias(n) for i, n in enumerate(names)]
    )
    df = df.withColumn("loan_default", (sum((F.col(n) for n in names), start=F.lit(0.0)) > 8).cast("int"))
    model = models.train_default(df, names, kind="forest", depth=15, rounds=2)
    rows = model.stages[0].transform(df.where("customer_id < 200"))
    told = explain.shap_values(model.stages[-1], rows, names).groupBy("customer_id").agg((F.sum("shap") + F.max("base")).alias("told"))
    off = models.probability(model.stages[-1].transform(rows)).join(told, "customer_id").where(F.abs(F.col("p") - F.col("told")) > 1e-9)
    _, paths = explain._paths(explain.saved_nodes(model.stages[-1], spark), [0.5, 0.5], True)
    assert off.isEmpty() and max(len(seen) for _, seen in paths) > 12


def test_amount_models_and_quantiles(spark):
    df = planted.amounts(spark, 4000).cache()
    train, test = df.where("loan_id % 5 < 4"), df.where("loan_id % 5 = 4").cache()
    got = models.amount_models(train, test, ["x"], rounds=10, depth=4)
    report = {r["learner"]: r for r in got.report.collect()}
    assert report[got.name]["rmse"] == min(r["rmse"] for r in report.values())
    assert all(r["mape"] < 0.2 for r in report.values())
    out = models.amount_quantiles(train, ["x"], trees=10, depth=5).transform(test)
    r = out.agg(
        F.avg(F.col("disbursed_amount").between(F.col("q10"), F.col("q90")).cast("int")).alias("cover"),
        F.count_if((F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90"))).alias("crossed"),
    ).first()
    assert r["crossed"] == 0 and 0.7 < r["cover"] < 0.92


def test_selection_records_every_drop(spark):
    df = planted.defaults(spark, 3000).fillna({"x1": 0.0}).withColumns(
        {"flat": F.lit(1.0), "tiny": F.rand(9) * 0.01, "twin": F.col("x1") * 2}
    )
    names = [*X, "flat", "tiny", "twin"]
    got = select.select_features(df, names, "loan_default", target=3, step=1)
    assert set(got.kept) | set(got.dropped) == set(names) and not set(got.kept) & set(got.dropped)
    assert got.dropped["flat"] == got.dropped["tiny"] == "variance"
    assert got.dropped["x3"] == "correlation" and "x2" in got.kept
    lasso = select.LassoSelector("loan_default", 0.02).fit(df, ["x1", "x2", "x3"])
    assert "x3" in lasso.dropped and "x1" in lasso.kept
    linear = select.LassoSelector("loan_default", 0.01, logistic=False).fit(df, ["x1", "x2", "x3"])
    assert "x1" in linear.kept


def test_scores_validate(fitted):
    _, _, _, _, scored = fitted
    carded = scoring.scorecard(scored, "p", weight=10.0)
    v = scoring.validate_scores(carded, [600, 700, 800]).first()
    assert v["auc"] > 0.8 and v["bands"] >= 2 and v["monotone"]


def test_model_store_and_request(spark, fitted, tmp_path):
    _, test, imputer, model, scored = fitted
    store = ModelStore(str(tmp_path))
    store.save(model, "default", 3)
    again = store.load("default", 3)
    answer = models.predict_request(again, imputer.transform(test))
    a = {r["customer_id"]: round(r["p"], 12) for r in answer.collect()}
    b = {r["customer_id"]: round(r["p"], 12) for r in scored.collect()}
    assert a == b and {"score", "grade", "policy"} <= set(answer.columns)


def test_importance(spark, fitted):
    _, _, imputer, model, _ = fitted
    gains = models.importance(model.stages[-1], imputer.output_cols, spark)
    ranked = explain.importance_rank(gains, "gain").collect()
    assert ranked[0]["feature"] in ("x1_filled", "x2_filled") and ranked[0]["rank"] == 1


def test_scaler_restores(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, c double")
    for log in (False, True):
        m = encode.Scaler(["a", "c"], log).fit(df)
        out = m.transform(df)
        back = out.select(m.restore(F.col("a_std"), "a").alias("a"), "c_std").collect()
        assert [None if r["a"] is None else round(r["a"], 9) for r in back] == [1.0, 3.0, None]
        assert [r["c_std"] for r in back] == [0.0, 0.0, 0.0]
