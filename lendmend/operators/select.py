"""Feature selection. Every selector is fitted on the training split and records what it drops."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmend.functions.metrics import pearson


def corr_with_label(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, r): Pearson correlations with the label, in one pass; null for a constant."""
    one = df.agg(*[pearson(f, label).alias(f) for f in features])
    return one.unpivot([], features, "feature", "r").withColumn(
        "r", F.nanvl("r", F.lit(None).cast("double"))
    )


@dataclass
class Selection:
    kept: list[str]
    dropped: dict[str, str] = field(default_factory=dict)  # feature -> step that dropped it

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


def _assembled(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    cols = [F.col(f).cast("double").alias(f) for f in features]
    extra = [F.col(label).cast("double").alias(label)] if label else []
    return (
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
        .transform(df.select(*cols, *extra))
        .select("features", *([label] if label else []))
    )


@dataclass
class CorrFilter:
    """Keep features with |r| of at least ``least``."""

    label: str
    least: float = 0.05

    def fit(self, train: DataFrame, features: list[str]) -> Selection:
        r = {x["feature"]: x["r"] for x in corr_with_label(train, features, self.label).collect()}
        weak = [f for f in features if r[f] is None or math.isnan(r[f]) or abs(r[f]) < self.least]
        return Selection([f for f in features if f not in weak], {f: "correlation" for f in weak})


@dataclass
class VarFilter:
    """Drop features whose sample variance is below ``least``. Use it before scaling."""

    least: float = 0.01

    def fit(self, train: DataFrame, features: list[str]) -> Selection:
        chosen = (
            VarianceThresholdSelector(varianceThreshold=self.least, outputCol="kept")
            .fit(_assembled(train, features))
            .selectedFeatures
        )
        kept = [features[i] for i in sorted(chosen)]
        return Selection(kept, {f: "variance" for f in features if f not in kept})


@dataclass
class RFE:
    """Drop the ``step`` least important features by random forest until ``n`` are left."""

    label: str
    n: int
    step: int = 5
    trees: int = 20
    depth: int = 5
    seed: int = 7

    def fit(self, train: DataFrame, features: list[str]) -> Selection:
        kept, dropped = list(features), {}
        base = train.select(*[F.col(c).cast("double").alias(c) for c in [*features, self.label]])
        base.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            while len(kept) > self.n:
                forest = RandomForestClassifier(
                    labelCol=self.label, numTrees=self.trees, maxDepth=self.depth, seed=self.seed
                ).fit(_assembled(base, kept, self.label))
                weight = dict(zip(kept, forest.featureImportances.toArray()))
                least = sorted(kept, key=lambda f: (weight[f], f))
                for f in least[: min(self.step, len(kept) - self.n)]:
                    kept.remove(f)
                    dropped[f] = "recursive elimination"
        finally:
            base.unpersist()
        return Selection(kept, dropped)


@dataclass
class LassoSelector:
    """L1 regression; features with a zero coefficient go."""

    label: str
    reg: float = 0.001
    logistic: bool = True

    def fit(self, train: DataFrame, features: list[str]) -> Selection:
        data = _assembled(train, features, self.label).persist(StorageLevel.MEMORY_AND_DISK)
        scaled = StandardScaler(inputCol="features", outputCol="x", withMean=True).fit(data)
        learner = (LogisticRegression if self.logistic else LinearRegression)(
            featuresCol="x", labelCol=self.label, regParam=self.reg, elasticNetParam=1.0,
            standardization=False, maxIter=50,
        )
        coef = learner.fit(scaled.transform(data)).coefficients.toArray()
        data.unpersist()
        kept = [f for f, c in zip(features, coef) if c != 0.0]
        return Selection(kept, {f: "lasso" for f in features if f not in kept})


def select_features(
    train: DataFrame, features: list[str], label: str, target: int = 80, least_corr: float = 0.05,
    least_variance: float = 0.01, reg: float = 0.001, step: int = 5,
) -> Selection:
    """Variance, correlation, recursive elimination to ``target``, Lasso.

    Input columns are unscaled; a step that would drop everything raises.
    """
    kept, dropped = list(features), {}
    rows = train.select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for selector in (
            VarFilter(least_variance),
            CorrFilter(label, least_corr),
            RFE(label, target, step),
            LassoSelector(label, reg),
        ):
            got = selector.fit(rows, kept)
            if not got.kept:
                raise ValueError(f"{type(selector).__name__} would drop all of {kept}")
            kept, dropped = got.kept, {**dropped, **got.dropped}
    finally:
        rows.unpersist()
    return Selection(kept, dropped)


def selection_report(spark, selection: Selection) -> DataFrame:
    rows = [(f, "kept") for f in selection.kept] + list(selection.dropped.items())
    return spark.createDataFrame(rows, "feature string, outcome string")
