"""Signed contribution of each feature to a tree ensemble's output.

The contributions are exact Shapley values of the path-dependent expectation. Along one
root-to-leaf path the value of a feature subset is a product, one factor per distinct feature:
the row's 0/1 test where the feature is known, the share of training rows that went that way
where it is not. Averaged over all orders, a feature's contribution is an integral over [0, 1] of
the product of the other features' factors, each mixed from share and test; the integrand is a
polynomial, which Gauss-Legendre nodes integrate exactly. The work per row is leaves x depth^2,
and what the tasks are sent grows with the model's leaves alone.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmend.functions.metrics import pearson
from lendmend.operators.keyed import top_per_key

CHUNK_CELLS = 2_000_000  # rows x paths worked on at once


@dataclass
class PathTable:
    """Paths with ``m`` distinct features: tests and shares [P, m], leaf values [P]."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def saved_nodes(model, spark: SparkSession) -> pd.DataFrame:
    """Node rows of a fitted ensemble, from its saved form. Bounded by the model's size."""
    from lendmend.sources.zones import shared_dir

    path = f"{shared_dir(spark)}/explain-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    return (
        spark.read.parquet(f"{path}/data")
        .select(
            F.col("treeID").alias("tree"),
            n["id"].alias("id"),
            n["prediction"].alias("prediction"),
            n["impurityStats"].alias("stats"),
            n["rawCount"].cast("double").alias("cover"),
            n["leftChild"].alias("left"),
            n["rightChild"].alias("right"),
            n["split"]["featureIndex"].alias("feature"),
            n["split"]["leftCategoriesOrThreshold"].alias("threshold"),
            n["split"]["numCategories"].alias("categories"),
        )
        .toPandas()
    )


def _paths(nodes: pd.DataFrame, weights: list[float], is_forest_classifier: bool):
    """(base value, list of (leaf value, {feature: [low, high, share]}))."""
    base, paths = 0.0, []
    for tree, part in nodes.groupby("tree"):
        by_id = {r.id: r for r in part.itertuples()}
        root = by_id[0]
        todo = [(root, {}, 1.0)]
        while todo:
            node, seen, reach = todo.pop()
            if node.left < 0:
                value = node.prediction
                if is_forest_classifier:
                    value = node.stats[1] / sum(node.stats)
                value *= weights[tree]
                base += reach * value
                paths.append((value, seen))
                continue
            if node.categories > 0:
                raise ValueError("one-hot encode categories: nominal splits are not explained")
            cut, f = node.threshold[0], node.feature
            for child, lo, hi in (
                (by_id[node.left], -math.inf, cut),
                (by_id[node.right], cut, math.inf),
            ):
                share = child.cover / node.cover
                a, b, s = seen.get(f, (-math.inf, math.inf, 1.0))
                todo.append(
                    (child, {**seen, f: (max(a, lo), min(b, hi), s * share)}, reach * share)
                )
    return base, paths


def _tabulate(paths) -> list[PathTable]:
    tables = []
    for m in sorted({len(seen) for _, seen in paths} - {0}):
        group = [(v, sorted(seen.items())) for v, seen in paths if len(seen) == m]
        low, high, share = (np.array([[t[k] for _, t in s] for _, s in group]) for k in range(3))
        feature = np.array([[f for f, _ in s] for _, s in group])
        tables.append(PathTable(feature, low, high, share, np.array([v for v, _ in group])))
    return tables


def _contributions(x: np.ndarray, tables: list[PathTable], n_features: int) -> np.ndarray:
    out = np.zeros((len(x), n_features))
    for t in tables:
        p, m = t.feature.shape
        nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
        nodes, weights = (nodes + 1) / 2, weights / 2
        step = max(1, CHUNK_CELLS // p)
        for lo in range(0, len(x), step):
            rows = x[lo : lo + step]
            held = [rows[:, t.feature[:, j]] for j in range(m)]
            test = [((v > t.low[:, j]) & (v <= t.high[:, j])).astype(float) for j, v in enumerate(held)]
            others = [np.zeros((len(rows), p)) for _ in range(m)]
            for node, weight in zip(nodes, weights, strict=True):
                factor = [t.share[:, j] * (1 - node) + test[j] * node for j in range(m)]
                after = [np.ones((len(rows), p))]
                for f in reversed(factor[1:]):
                    after.append(after[-1] * f)
                before = np.full((len(rows), p), weight)
                for j in range(m):
                    others[j] += before * after[m - 1 - j]
                    before = before * factor[j]
            for j in range(m):
                add = t.value * (test[j] - t.share[:, j]) * others[j]
                for f in np.unique(t.feature[:, j]):
                    out[lo : lo + step, f] += add[:, t.feature[:, j] == f].sum(1)
    return out


def shap_values(
    model, df: DataFrame, features: list[str], key: str = "customer_id",
    features_col: str = "features",
) -> DataFrame:
    """(key, feature, value, shap, base): one row per record and feature.

    Positive contributions raise the risk. ``base`` plus a record's contributions is the
    margin of a boosted model, or the probability / prediction of a forest.
    ``df`` carries the assembled vector.
    """
    spark = df.sparkSession
    kind = type(model).__name__
    nodes = saved_nodes(model, spark)
    weights = list(model.treeWeights)
    if kind.startswith("RandomForest"):
        weights = [w / len(weights) for w in weights]
    base, paths = _paths(nodes, weights, kind == "RandomForestClassificationModel")
    shared = spark.sparkContext.broadcast(_tabulate(paths))  # a few numbers for each leaf and feature
    n, key_type = len(features), df.schema[key].dataType.simpleString()

    def explain(batches):
        tables = shared.value
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["_x"].to_numpy())
                phi = _contributions(x, tables, n)
                yield pd.DataFrame({key: pdf[key], "_x": pdf["_x"], "_phi": list(phi)})

    rows = df.select(key, vector_to_array(features_col).alias("_x")).mapInPandas(
        explain, f"`{key}` {key_type}, _x array<double>, _phi array<double>"
    )
    names = F.array(*[F.lit(f) for f in features])
    cell = F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"), F.col("_phi").alias("shap"))
    return rows.select(key, F.explode(cell).alias("c")).select(
        key,
        F.col("c.feature").alias("feature"),
        F.col("c.value").alias("value"),
        F.col("c.shap").alias("shap"),
        F.lit(float(base)).alias("base"),
    )


def shap_importance(shap_df: DataFrame) -> DataFrame:
    """Features by mean absolute contribution, most important first."""
    per = shap_df.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    return importance_rank(per, "mean_abs_shap")


def importance_rank(df: DataFrame, value_col: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.orderBy(F.col(value_col).desc(), "feature")  # one row per feature
    return df.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def force(shap_df: DataFrame, customer, key: str = "customer_id") -> DataFrame:
    """One customer's contributions by size, with their direction."""
    return (
        shap_df.where(F.col(key) == customer)
        .withColumn("direction", F.when(F.col("shap") >= 0, "raises risk").otherwise("lowers risk"))
        .orderBy(F.abs("shap").desc(), "feature")
    )


def top_reasons(shap_df: DataFrame, k: int = 3, key: str = "customer_id") -> DataFrame:
    """The k largest contributions of every record."""
    return top_per_key(shap_df, [key], [F.abs("shap").desc(), F.col("feature")], k)


def shap_sanity(shap_df: DataFrame, expected_signs: dict[str, int]) -> DataFrame:
    """Features whose contribution runs against the sign expected of them (e.g. age: -1)."""
    pairs: list[Column] = [F.lit(x) for f, s in expected_signs.items() for x in (f, s)]
    sign = F.try_element_at(F.create_map(*pairs), F.col("feature"))
    return (
        shap_df.where(F.col("feature").isin(list(expected_signs)))
        .groupBy("feature")
        .agg(pearson("value", "shap").alias("r"))
        .withColumn("expected", sign)
        .withColumn(
            "contradicts",
            F.coalesce(F.signum("r") * F.col("expected") < 0, F.lit(False)),
        )
    )
