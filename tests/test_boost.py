import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendmend.operators import boost, encode, models
from lendmend.sources.zones import ModelStore
from workload import planted


def test_first_cut_equals_a_search_over_all_cuts(spark):
    """200 rows: every feature, threshold and direction of the missing rows tried by hand."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 3)), 1)
    x[rng.random((200, 3)) < 0.25] = np.nan
    y = (rng.random(200) < np.where(np.isnan(x[:, 1]), 0.9, 0.2 + 0.3 * (x[:, 0] > 0.3))).astype(float)
    df = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    model = boost.fit_boosted(df, ["a", "b", "c"], "y", depth=1, rounds=1, rate=1.0, reg=1.0, least=2.0, bins=255)
    p = y.mean()
    g, h = p - y, np.full(200, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    best = []
    for j in range(3):
        for t, side in itertools.product(np.unique(x[~np.isnan(x[:, j]), j]), (False, True)):
            left = np.where(np.isnan(x[:, j]), side, x[:, j] <= t)
            if min(h[left].sum(), h[~left].sum()) >= 2.0:
                best.append((score(left) + score(~left) - score(np.ones(200, bool)), -j, -t, left))
    gain, j, t, left = max(best, key=lambda b: b[:3])
    (tree,) = model.trees
    assert int(tree[0, boost.FEATURE]) == -j and sum(model.gains.values()) == pytest.approx(gain, rel=1e-6)
    went = boost.leaves(tree, x) == 1
    assert (went == left).all()
    for child, rows in ((1, left), (2, ~left)):
        assert tree[child, boost.VALUE] == pytest.approx(-g[rows].sum() / (h[rows].sum() + 1.0), rel=1e-5)


def test_large_tables_carry_margins_along(spark, monkeypatch):
    """Each pass goes through one finished tree at most, and the trees are those of a fit that goes through all."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(b), float(3 * a + b * b)) for a, b in rng.normal(size=(400, 2))], "a double, b double, y double")
    seen, sums = [], boost._sums
    monkeypatch.setattr(boost, "_sums", lambda rows, width, trees, *more: seen.append(len(trees)) or sums(rows, width, trees, *more))
    fit = lambda: boost.fit_boosted(df, ["a", "b"], "y", "squared", depth=2, rounds=4)
    few = fit()
    assert max(seen) == 4
    seen.clear()
    monkeypatch.setattr(boost, "MANY_ROWS", 400, raising=False)
    many = fit()
    assert max(seen) == 0
    assert all((a == b).all() for a, b in zip(few.trees, many.trees, strict=True)) and len(many.trees) == 4


def test_a_pass_reads_blocks_of_rows(spark):
    """The binned table has a row for many rows, with all that a pass needs of them."""
    data = [(float(i % 7), None if i % 3 else 1.0, float(i), 1.0 + i % 2, i % 5 == 0) for i in range(300)]
    given = spark.createDataFrame(data, "a double, b double, y double, w double, valid boolean").coalesce(1)
    given = given.select(F.array("a", "b").alias("cells"), "y", "w", "valid")
    (row,) = boost._binned(given, ["a", "b"], [[1.0, 3.0], [0.5]], 3).collect()
    bins, y, w, valid, margin = boost._rows([bytes(row[c]) for c in boost.BLOCK], 2, [], 3)
    assert bins.tolist() == [[int(np.searchsorted([1.0, 3.0], a)), 3 if b is None else 1] for a, b, *_ in data]
    assert list(zip(y, w, valid)) == [r[2:] for r in data] and not margin.any()


def test_missing_values_carry_the_signal(spark):
    """Filled with the median, missing rows look like those in the middle; here they go their own way."""
    x = F.when(F.rand(2) < 0.3, F.lit(None)).otherwise(F.round(F.randn(3)))
    df = spark.range(4000).select("id", x.alias("x"), F.randn(4).alias("z"), F.rand(5).alias("u"))
    df = df.withColumn("y", (F.col("u") < F.when(F.col("x").isNull(), 0.8).otherwise(0.2)).cast("int")).cache()
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    ours = boost.fit_boosted(train, ["x", "z"], "y", depth=3, rounds=10).transform(test)
    imputer = encode.impute_with_flags(["x", "z"]).fit(train)
    filled = models.train_default(imputer.transform(train), ["x_filled", "z_filled"], "y", depth=3, rounds=10)
    theirs = models.probability(filled.transform(imputer.transform(test)))
    a, b = (models.auc(s, "y").first()["auc"] for s in (ours, theirs))
    assert a > 0.72 and a > b + 0.02


def test_signal_stopping_and_weights(spark):
    df = planted.defaults(spark, 4000).withColumn("valid", F.pmod(F.xxhash64("customer_id"), F.lit(5)) == 0).cache()
    model = boost.fit_boosted(df, ["x1", "x2", "x3"], "loan_default", depth=3, rounds=40, rate=0.5, valid_flag="valid")
    assert len(model.trees) < 40 and model.valid_loss[len(model.trees) - 1] == min(model.valid_loss)
    scored = model.transform(df.where("valid"))
    assert models.auc(scored, "loan_default").first()["auc"] > 0.8
    gains = {r["feature"]: r["gain"] for r in model.importance(spark).collect()}
    assert gains["x1"] > gains["x2"] > gains["x3"] and sum(gains.values()) == pytest.approx(1)
    # A weight of w is as good as w equal rows.
    few = df.limit(400).withColumn("w", F.when(F.col("loan_default") == 1, 3.0).otherwise(1.0))
    often = few.withColumn("k", F.explode(F.when(F.col("loan_default") == 1, F.array(*map(F.lit, range(3)))).otherwise(F.array(F.lit(0)))))
    a = boost.fit_boosted(few, ["x2"], "loan_default", depth=2, rounds=3, weight_col="w", bins=8)
    edges = boost.bin_edges(few, ["x2"], 8)
    b_trees = boost.fit_boosted(often, ["x2"], "loan_default", depth=2, rounds=1, bins=8)
    assert a.base == pytest.approx(b_trees.base) and len(edges[0]) <= 7


def test_numbers_are_predicted(spark):
    df = planted.amounts(spark, 3000).withColumn("x", F.when(F.col("loan_id") % 10 != 0, F.col("x"))).cache()
    train, test = df.where("loan_id % 5 <> 1"), df.where("loan_id % 5 = 1")
    got = models.amount_models(train.where("x is not null"), test.where("x is not null"), ["x"], rounds=30, depth=3)
    errors = {r["learner"]: r["rmse"] for r in got.report.collect()}
    assert set(errors) == {"forest", "gbt", "second_order"} and errors["second_order"] < 1.1 * min(errors.values())
    model = boost.fit_boosted(train, ["x"], "disbursed_amount", "squared", depth=3, rounds=30)
    near = model.transform(test).agg(F.avg("prediction"), F.avg("disbursed_amount"), F.count("prediction"), F.count("*")).first()
    assert near[0] == pytest.approx(near[1], rel=0.05) and near[2] == near[3]


def test_trees_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    df = planted.defaults(spark, 1500)
    edges = boost.bin_edges(df, ["x1", "x2"], 16)
    fit = lambda rows: boost.fit_boosted(rows, ["x1", "x2"], "loan_default", depth=2, rounds=22, rate=0.2, bins=16, edges=edges)
    rows = df.withColumn("x2", F.round("x2", 1)).withColumn("x1", F.round("x1", 1)).cache()
    a, b = fit(rows.repartition(1)), fit(rows.repartition(7))
    assert len(a.trees) == 22 and all(np.array_equal(x, y) for x, y in zip(a.trees, b.trees, strict=True))
    store = ModelStore(str(tmp_path))
    store.save_fitted(spark, a, "boost", 1)
    again = store.load_fitted(spark, "boost", 1)
    cells = np.array([[0.1, np.nan], [np.nan, np.nan], [-2.0, 5.0]])
    assert again.margins(cells).tolist() == a.margins(cells).tolist()


def test_edge_cases(spark):
    schema = "x double, y int"
    with pytest.raises(ValueError, match="no rows"):
        boost.fit_boosted(spark.createDataFrame([], schema), ["x"], "y")
    one = boost.fit_boosted(spark.createDataFrame([(1.0, 1), (2.0, 1), (None, None)], schema), ["x"], "y", rounds=3)
    assert one.trees == [] and one.margins(np.array([[math.nan]]))[0] > 10
    empty = boost.fit_boosted(spark.createDataFrame([(None, i % 2) for i in range(20)], schema), ["x"], "y", rounds=2)
    assert empty.trees == [] and empty.transform(spark.createDataFrame([], schema)).count() == 0
    # No missing rows in training: later ones follow the heavier side.
    rows = spark.createDataFrame([(float(i), int(i >= 25)) for i in range(100)], schema)
    model = boost.fit_boosted(rows, ["x"], "y", depth=1, rounds=1, bins=100)
    tree = model.trees[0]
    assert boost.leaves(tree, np.array([[math.nan]]))[0] == boost.leaves(tree, np.array([[90.0]]))[0]
