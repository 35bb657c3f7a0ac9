"""Default, fraud and amount models on MLlib trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendmend.functions import metrics as M
from lendmend.functions.vectors import haversine_km
from lendmend.operators.boost import BoostedTrees, fit_boosted
from lendmend.operators.features import application_burst
from lendmend.operators.ranked import running_by_value
from lendmend.schema import FraudRules


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def probability(df: DataFrame, out: str = "p") -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


def default_model(
    label: str = "loan_default",
    features_col: str = "features",
    depth: int = 6,
    rate: float = 0.1,
    rounds: int = 200,
    weight_col: str | None = None,
    valid_flag: str | None = None,
    tolerance: float = 0.001,
    kind: str = "gbt",
    seed: int = 7,
):
    """Unfitted classifier: boosted trees by default, or ``forest``.

    With ``valid_flag`` (a boolean column) boosting stops when the flagged rows stop improving.
    """
    if kind == "forest":
        model = RandomForestClassifier(
            featuresCol=features_col, labelCol=label, maxDepth=depth, numTrees=rounds, seed=seed
        )
    else:
        model = GBTClassifier(
            featuresCol=features_col, labelCol=label, maxDepth=depth, stepSize=rate,
            maxIter=rounds, seed=seed,
        )
        if valid_flag:
            model = model.setValidationIndicatorCol(valid_flag)
            model.set(model.validationTol, tolerance)
    return model.setWeightCol(weight_col) if weight_col else model


def train_default(
    train: DataFrame, features: list[str], label: str = "loan_default", **params
) -> PipelineModel:
    return Pipeline(stages=[assembler(features), default_model(label, **params)]).fit(train)


def class_weight(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Positives weigh n_neg / n_pos, negatives 1."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    ).first()
    ratio = row["neg"] / row["pos"] if row["pos"] else 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(1.0))


def combined_weight(
    df: DataFrame, label: str, fn_cost: float = 5.0, fp_cost: float = 1.0, quality_col: str | None = None, out: str = "weight"
) -> tuple[DataFrame, float]:
    """Rows with one training weight, and the factor by which it moves a model's odds.

    The weight is cost x class x quality: a missed default costs ``fn_cost``, a needless rejection
    ``fp_cost``; positives weigh n_neg / n_pos; ``quality_col`` (see ``clean.training_weight``) is what
    a row counts whatever its label. The first two multiply the odds by their ratio, which ``unweighted``
    and the scorecard's ``weight`` undo; the third does not move the odds of rows that are alike.
    """
    pos, neg = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    ratio = neg / pos if pos else 1.0
    quality = F.lit(1.0) if quality_col is None else F.coalesce(F.col(quality_col).cast("double"), F.lit(1.0))
    own = F.when(F.col(label) == 1, F.lit(fn_cost * ratio)).when(F.col(label) == 0, F.lit(float(fp_cost)))
    return df.withColumn(out, own * quality), fn_cost * ratio / fp_cost


def stratified_folds(
    df: DataFrame, label: str, key: str = "customer_id", folds: int = 5, seed: int = 7, buckets: int = 1024, out: str = "fold"
) -> DataFrame:
    """Adds the fold of each row, from 0: every class is dealt evenly, to within one row.

    Rows of a class are dealt in turn in the order of a hash of their key. They are numbered inside
    ranges of that hash, which hold about the same number of rows; a range starts where the one before
    ended, so no task holds a class.
    """
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    rows = df.withColumns({"_draw": draw, "_range": F.floor(draw / ((1 << 40) / buckets)).cast("int")})
    sizes = rows.groupBy(F.col(label).alias("_class"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    # At most ``buckets`` rows for each class.
    before = W.partitionBy("_class").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_class", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(W.partitionBy(label, "_range").orderBy("_draw", key)) - 1
    same = F.col(label).eqNullSafe(F.col("_class")) & (F.col("_range") == F.col("_r"))
    dealt = rows.withColumn("_nth", nth).join(F.broadcast(starts), same)
    return dealt.withColumn(out, ((F.col("_start") + F.col("_nth")) % folds).cast("int")).drop("_draw", "_range", "_class", "_r", "_start", "_nth")


def cross_validate(
    est, train: DataFrame, grid, label: str, folds: int = 5, parallelism: int = 4, seed: int = 7,
    key: str | None = None, weight_col: str | None = None,
) -> CrossValidatorModel:
    """AUC of every setting over folds. With ``key`` the folds are stratified by class (``stratified_folds``);
    ``weight_col`` weighs the rows that are judged; give it to the learner as well for the fit."""
    evaluator = BinaryClassificationEvaluator(labelCol=label)
    if weight_col is not None:
        evaluator = evaluator.setWeightCol(weight_col)
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds,
        parallelism=parallelism, seed=seed,
    )
    if key is not None:
        train, cv = stratified_folds(train, label, key, folds, seed), cv.setFoldCol("fold")
    return cv.fit(train)


def _pos_neg(label: str) -> dict[str, Column]:
    return {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)}


def roc_points(scored: DataFrame, label: str, p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr): one row per distinct probability, predicting 1 from it upwards."""
    cum = running_by_value(scored, p, _pos_neg(label), descending=True)
    return cum.select(
        F.col(p).alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("all_pos")).alias("tpr"),
    )


def auc(scored: DataFrame, label: str, p: str = "p") -> DataFrame:
    """Rank-sum AUC, ties counted half. One row."""
    cum = running_by_value(scored, p, _pos_neg(label))
    wins = F.col("pos").cast("double") * (
        F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0)
    )
    total = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    return cum.agg(F.try_divide(F.sum(wins), total).alias("auc"))


def confusion(scored: DataFrame, label: str, p: str = "p", threshold: float = 0.5) -> DataFrame:
    said = F.when(F.col(p) >= threshold, 1).otherwise(0)
    y = F.col(label)
    return scored.agg(
        F.count_if((y == 1) & (said == 1)).alias("tp"),
        F.count_if((y == 0) & (said == 1)).alias("fp"),
        F.count_if((y == 0) & (said == 0)).alias("tn"),
        F.count_if((y == 1) & (said == 0)).alias("fn"),
        M.precision(y, said).alias("precision"),
        M.recall(y, said).alias("recall"),
        M.f1(y, said).alias("f1"),
        F.avg(F.when(y == said, 1.0).otherwise(0.0)).alias("accuracy"),
    )


def classifier_metrics(
    scored: DataFrame, label: str, p: str = "p", threshold: float = 0.5
) -> DataFrame:
    """One row: AUC, confusion counts, precision, recall, F1, accuracy."""
    area = auc(scored, label, p).first()["auc"]
    return confusion(scored, label, p, threshold).withColumn(
        "auc", F.lit(area).cast("double")
    )


def cost_threshold(
    scored: DataFrame, label: str, p: str = "p", fn_cost: float = 5.0, fp_cost: float = 1.0
) -> DataFrame:
    """One row: the probability from which to reject at least cost, and that cost.

    Rejecting no one is the start of the search (threshold above 1 shows as null).
    """
    cum = running_by_value(scored, p, _pos_neg(label), descending=True)
    cost = (F.col("all_pos") - F.col("cum_pos")) * F.lit(float(fn_cost)) + F.col(
        "cum_neg"
    ) * F.lit(float(fp_cost))
    # On a tie the higher threshold wins: fewer rejections.
    best = cum.agg(
        F.min(F.struct(cost.alias("cost"), (-F.col(p)).alias("_minus"))).alias("b"),
        (F.max("all_pos") * F.lit(float(fn_cost))).alias("none"),
    )
    return best.select(
        F.when(F.col("b.cost") < F.col("none"), -F.col("b._minus")).alias("threshold"),
        F.least("b.cost", "none").alias("cost"),
    )


def importance(model, features: list[str], spark) -> DataFrame:
    """(feature, gain) of a fitted tree ensemble; one row per feature."""
    gains = model.featureImportances.toArray()
    rows = [(f, float(g)) for f, g in zip(features, gains)]
    return spark.createDataFrame(rows, "feature string, gain double")


def fraud_features(
    apps: DataFrame,
    customers: DataFrame,
    areas: DataFrame,
    cfg: FraudRules = FraudRules(),
    ts: str = "apply_time",
) -> DataFrame:
    """Burst of applications, age against credit history, distance, absent documents.

    ``customers``: customer_id, age, credit_years, inquiry_cnt, home_area_id and the document
    flags. ``apps`` carries ``area_id``. Distance stays null unless both areas are known.
    """
    burst = application_burst(apps, ts, cfg.burst_count, cfg.burst_days)
    joined = burst.join(customers, "customer_id", "left")

    def place(prefix, on):
        return areas.select(
            F.col("area_id").alias(on),
            F.col("latitude").alias(f"_{prefix}_lat"),
            F.col("longitude").alias(f"_{prefix}_lon"),
        )

    placed = joined.join(place("app", "area_id"), "area_id", "left").join(
        place("home", "home_area_id"), "home_area_id", "left"
    )
    km = haversine_km(
        F.col("_app_lat"), F.col("_app_lon"), F.col("_home_lat"), F.col("_home_lon")
    )
    absent = sum(
        (F.when(~F.col(d), 1).otherwise(0) for d in cfg.documents), start=F.lit(0)
    )
    out = placed.withColumns(
        {
            "many_inquiries": F.coalesce(F.col("inquiry_cnt") > cfg.max_inquiries, F.lit(False))
            | F.col("burst"),
            "age_conflict": F.coalesce(
                F.col("age") - F.col("credit_years") < cfg.min_credit_start_age, F.lit(False)
            ),
            "distance_km": km,
            "far_away": F.coalesce(km > cfg.max_distance_km, F.lit(False)),
            "absent_documents": absent,
            "documents_absent": absent > cfg.max_absent_documents,
        }
    )
    return out.drop("_app_lat", "_app_lon", "_home_lat", "_home_lon")


def fraud_model(train: DataFrame, features: list[str], label: str = "fraud", **params):
    """The default model's learner on fraud labels."""
    return train_default(train, features, label, **params)


AMOUNT_LEARNERS = {
    "forest": lambda label, rounds, depth, seed: RandomForestRegressor(
        labelCol=label, numTrees=rounds, maxDepth=depth, seed=seed
    ),
    "gbt": lambda label, rounds, depth, seed: GBTRegressor(
        labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed
    ),
}


@dataclass
class AmountComparison:
    report: DataFrame  # learner, rmse, mape, best
    best: PipelineModel | BoostedTrees
    name: str


def amount_models(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    label: str = "disbursed_amount",
    rounds: int = 50,
    depth: int = 6,
    learners: tuple[str, ...] = ("forest", "gbt", "second_order"),
    seed: int = 7,
) -> AmountComparison:
    """Fit every learner on the same rows and compare on the test rows; least RMSE wins.

    ``second_order`` takes missing values as they are, the others take none.
    """
    fitted, rows = {}, []
    for name in learners:
        if name == "second_order":
            fitted[name] = fit_boosted(train, features, label, "squared", depth, rounds=rounds)
        else:
            stages = [assembler(features), AMOUNT_LEARNERS[name](label, rounds, depth, seed)]
            fitted[name] = Pipeline(stages=stages).fit(train)
        got = fitted[name].transform(test).agg(
            M.rmse(label, "prediction").alias("rmse"), M.mape(label, "prediction").alias("mape")
        )
        r = got.first()
        rows.append((name, r["rmse"], r["mape"]))
    best = min(rows, key=lambda r: (r[1], r[0]))[0]
    report = train.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows],
        "learner string, rmse double, mape double, best boolean",
    )
    return AmountComparison(report, fitted[best], best)


@dataclass
class QuantileForest:
    """Random forest whose leaves keep the distribution of the target, so quantiles never cross."""

    pipeline: PipelineModel
    edges: list[float]  # upper ends of the target bins
    table: np.ndarray  # tree x leaf x bin, share of the leaf's rows

    def transform(self, df: DataFrame, quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
        table, edges, qs = self.table, np.array(self.edges), list(quantiles)
        trees = np.arange(table.shape[0])
        names = [f"q{round(q * 100)}" for q in qs]

        @F.pandas_udf(", ".join(f"{n} double" for n in names))
        def read(leaves: pd.Series) -> pd.DataFrame:
            at = np.vstack(leaves.to_numpy()).astype(int)
            cdf = np.zeros((len(at), table.shape[2]))
            for t in trees:  # one row of bins per tree: memory stays rows x bins
                cdf += table[t, at[:, t]]
            cdf = np.cumsum(cdf / len(trees), axis=1)
            pick = [np.minimum((cdf < q - 1e-12).sum(1), len(edges) - 1) for q in qs]
            return pd.DataFrame({n: edges[i] for n, i in zip(names, pick)})

        scored = self.pipeline.transform(df)
        out = scored.withColumn("_q", read(vector_to_array("leaf")))
        return out.select("*", *[F.col(f"_q.{n}").alias(n) for n in names]).drop("_q", "leaf")


def amount_quantiles(
    train: DataFrame,
    features: list[str],
    label: str = "disbursed_amount",
    trees: int = 20,
    depth: int = 6,
    bins: int = 100,
    seed: int = 7,
) -> QuantileForest:
    """Fit the forest and count target bins per (tree, leaf).

    The counts have at most trees x 2^depth x bins entries, whatever the number of rows.
    """
    forest = RandomForestRegressor(
        labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed,
        leafCol="leaf",
    )
    fitted = Pipeline(stages=[assembler(features), forest]).fit(train)
    probs = [i / bins for i in range(1, bins + 1)]
    edges = sorted(set(train.approxQuantile(label, probs, 0.2 / bins)))
    # Bin = number of edges below the target. On negated values the binary search counts the
    # edges at or above it.
    n = len(edges)
    splits = [float("-inf"), *sorted(-e for e in edges), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="_minus", outputCol="_above").transform(
        train.withColumn("_minus", -F.col(label).cast("double"))
    )
    bin_of = F.least(F.lit(n) - F.col("_above").cast("int"), F.lit(n - 1))
    counts = (
        fitted.transform(binned)
        .select(bin_of.alias("bin"), vector_to_array("leaf").alias("leaf"))
        .select("bin", F.posexplode("leaf").alias("tree", "leaf"))
        .groupBy("tree", F.col("leaf").cast("int").alias("leaf"), "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .toPandas()
    )
    table = np.zeros((trees, int(counts["leaf"].max()) + 1, len(edges)))
    table[counts["tree"], counts["leaf"], counts["bin"]] = counts["n"]
    total = table.sum(2, keepdims=True)
    table = np.divide(table, total, out=np.zeros_like(table), where=total > 0)
    return QuantileForest(fitted, edges, table)


def predict_request(model: PipelineModel, df: DataFrame, weight: float = 1.0) -> DataFrame:
    """Answer to a prediction request: probability, score, grade, policy per record."""
    from lendmend.operators.scoring import scorecard

    scored = probability(model.transform(df))
    return scorecard(scored, "p", weight=weight).drop(
        "features", "rawPrediction", "probability", "prediction"
    )
