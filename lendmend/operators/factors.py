"""Repair of numbers by matrix factorisation and by similar customers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendmend.operators.encode import Scaler, ScalerModel
from lendmend.operators.similar import similar

KEY = "customer_id"
CELLS_PER_BLOCK = 2_000_000


def dense_ids(df: DataFrame, key: str = KEY, buckets: int = 4096) -> DataFrame:
    """(key, user): consecutive integers from 0, numbered in parallel.

    Keys are numbered inside hash buckets; a bucket starts where the one before ended. Null keys
    are left out. The factorisation takes 32-bit ids: more than 2^31 - 1 keys are refused.
    """
    df = df.where(F.col(key).isNotNull())
    keys = df.select(key).distinct().withColumn(
        "_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    )
    sizes = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # <= ``buckets`` rows
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1
    return keys.join(F.broadcast(starts), "_b").select(
        key,
        F.when(nth + F.col("_start") < 2**31, (nth + F.col("_start")).try_cast("int"))
        .otherwise(F.raise_error("more than 2^31 - 1 users").cast("int"))
        .alias("user"),
    )


@dataclass
class Ratings:
    """Scaled cells in long form with what is needed to get back."""

    cells: DataFrame  # user, item, rating
    users: DataFrame  # key, user
    features: list[str]
    scaler: ScalerModel

    def item_of(self, feature: Column) -> Column:
        pos = F.array_position(F.array(*[F.lit(f) for f in self.features]), feature)
        return (pos - 1).cast("int")

    def feature_of(self, item: Column) -> Column:
        return F.array(*[F.lit(f) for f in self.features])[item]

    def restore(self, item: Column, scaled: Column) -> Column:
        out = None
        for i, f in enumerate(self.features):
            value = self.scaler.restore(scaled, f)
            out = F.when(item == i, value) if out is None else out.when(item == i, value)
        return out


def to_ratings(
    df: DataFrame, features: list[str], key: str = KEY, scaler: ScalerModel | None = None
) -> Ratings:
    """Customer x feature cells; a missing value is an absent cell. Features are standardised.

    Ids and cells are written once: the factorisation and every repair read them again.
    """
    from lendmend.sources.zones import shuffles_freed, written

    scaler = scaler or Scaler(features).fit(df)
    with shuffles_freed(df.sparkSession):
        users = written(dense_ids(df, key), "users")
    long = (
        scaler.transform(df)
        .select(key, *[F.col(f"{f}_std").alias(f) for f in features])
        .unpivot([key], features, "feature", "value")
        .where(F.col("value").isNotNull())
        .join(users, key)
    )
    out = Ratings(long, users, features, scaler)
    item = out.item_of(F.col("feature")).alias("item")
    with shuffles_freed(df.sparkSession):
        out.cells = written(
            long.select("user", item, F.col("value").cast("float").alias("rating")), "ratings"
        )
    return out


def als_fit(
    ratings: Ratings, rank: int = 50, reg: float = 0.1, iterations: int = 10, seed: int = 7
) -> ALSModel:
    """Every user's factors go through a shuffle for each item, in every iteration. With the item factors written
    after each, which are few, the shuffle files of one iteration are deleted before the next."""
    from lendmend.sources.zones import shared_dir

    sc = ratings.cells.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(ratings.cells.sparkSession)}/factors")
    blocks = max(10, math.ceil(ratings.cells.count() / CELLS_PER_BLOCK))
    return ALS(
        numUserBlocks=blocks, rank=rank, regParam=reg, maxIter=iterations, seed=seed, userCol="user", itemCol="item",
        ratingCol="rating", coldStartStrategy="drop", nonnegative=False, checkpointInterval=1,
    ).fit(ratings.cells)


def empty_cells(
    df: DataFrame, ratings: Ratings, key: str = KEY, user_key: str | None = None
) -> DataFrame:
    """(key, feature, user, item) of the missing numeric cells.

    ``user_key`` names the customer where ``key`` names something else, such as an application.
    """
    user_key = user_key or key
    gaps = F.array_compact(
        F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in ratings.features])
    )
    return (
        df.select(*dict.fromkeys([key, user_key]), F.explode(gaps).alias("feature"))
        .join(ratings.users, user_key)
        .select(key, "feature", "user")
        .withColumn("item", ratings.item_of(F.col("feature")))
    )


def als_repair(model: ALSModel, missing: DataFrame, ratings: Ratings, key: str = KEY) -> DataFrame:
    """(key, feature, value): user . item, back in the feature's unit.

    Users or features unknown to the model give no row.
    """
    scored = model.transform(missing)
    return scored.select(
        key,
        "feature",
        ratings.restore(F.col("item"), F.col("prediction").cast("double")).alias("value"),
    )


@dataclass
class FoldIn:
    """Repairs rows of users that the factors do not know, from the cells they have.

    With the item factors held fixed, a user's factors are the ridge solution over the known cells,
    with the penalty of the fit (``reg`` for each known cell). What they predict depends on the inner
    products of the item factors alone, so a row costs one system of as many equations as features.
    """

    products: np.ndarray  # feature x feature
    reg: float

    def predicted(self, cells: np.ndarray) -> np.ndarray:
        """Scaled numbers (row x feature) of every feature; nan stands for a missing cell, also of a feature
        without factors, and a row without a known cell stays nan."""
        usable = np.diag(self.products) > 0
        known = np.isfinite(cells) & usable
        n = known.sum(1)
        both = known[:, :, None] & known[:, None, :]
        system = np.where(both, self.products, 0.0)
        every = np.arange(cells.shape[1])
        # A missing cell's equation is that its weight is zero.
        system[:, every, every] += np.where(known, self.reg * n[:, None], 1.0)
        weights = np.linalg.solve(system, np.where(known, cells, 0.0)[:, :, None])[:, :, 0]
        out = weights @ self.products
        out[n == 0] = np.nan
        out[:, ~usable] = np.nan
        return out


def fold_in(model: ALSModel, ratings: Ratings, reg: float = 0.1) -> FoldIn:
    """``reg`` is that of the fit. The item factors are one row per feature."""
    size = len(ratings.features)
    factors = np.zeros((size, model.rank))
    for row in model.itemFactors.collect():  # one row per feature
        factors[row["id"]] = row["features"]
    return FoldIn(factors @ factors.T, reg)


def fold_in_repair(
    folding: FoldIn, df: DataFrame, ratings: Ratings, key: str = KEY, user_key: str | None = None, known: bool = False
) -> DataFrame:
    """(key, feature, value) of the missing numbers of rows whose customer is not in the factors.

    ``user_key`` names the customer where ``key`` names something else, such as an application; a null
    one is unknown. ``known`` takes the customers in the factors as well. A row without any known
    number gives none. One pass without a shuffle but for the list of known customers.
    """
    user_key = user_key or key
    rows = df if known else df.join(ratings.users.select(user_key), user_key, "left_anti")
    scaled = ratings.scaler.transform(rows)
    gaps = F.array(*[F.col(f).isNull() for f in ratings.features])
    cells = F.array(*[F.col(f"{f}_std").cast("double") for f in ratings.features])
    asked = scaled.where(F.exists(gaps, lambda x: x)).select(F.col(key).alias("key"), cells.alias("cells"))
    size, chunk = len(ratings.features), max(1, 4_000_000 // len(ratings.features) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                out = folding.predicted(flat.reshape(-1, size))
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size)
                found = pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["key", "cells", "found"])

    kind = asked.schema["key"].dataType.simpleString()
    filled = asked.mapInArrow(run, f"key {kind}, cells array<double>, found array<double>")
    each = filled.select("key", F.posexplode(F.arrays_zip("cells", "found")).alias("item", "cell"))
    item = F.col("item").cast("int")
    return each.where("cell.cells is null and cell.found is not null").select(
        F.col("key").alias(key), ratings.feature_of(item).alias("feature"), ratings.restore(item, F.col("cell.found")).alias("value")
    )


def weighted_value(neighbours: DataFrame, observed: DataFrame, key: str = KEY) -> DataFrame:
    """Similarity-weighted mean of the neighbours' observed values.

    ``neighbours``: key, neighbour, similarity; ``observed``: key, feature, value. Neighbours
    that point away (similarity <= 0) carry no weight. With a column feature, ``neighbours`` tells
    for which features it asks.
    """
    near = neighbours.where(F.col("similarity") > 0)
    seen = observed.withColumnRenamed(key, "neighbour")
    return (
        near.join(seen, ["neighbour", "feature"] if "feature" in near.columns else "neighbour")
        .groupBy(key, "feature")
        .agg(
            F.try_divide(
                F.sum(F.col("similarity") * F.col("value")), F.sum("similarity")
            ).alias("value")
        )
    )


def knn_repair(
    model: ALSModel, missing: DataFrame, ratings: Ratings, k: int = 20, key: str = KEY, **kw
) -> DataFrame:
    """(key, feature, value) from the k customers whose factors are most similar."""
    from lendmend.sources.zones import written

    factors = model.userFactors.select(F.col("id").alias("user"), F.col("features").alias("vec"))
    wanted = written(missing.select("user", "item").distinct(), "wanted")
    asking = factors.join(wanted, "user", "left_semi")
    near = similar(asking, factors, "vec", k, id_col="user", **kw)
    seen = ratings.cells.select("user", "item", F.col("rating").cast("double").alias("value"))
    # Only what is wanted meets the neighbours' cells.
    asked = near.join(wanted.withColumnRenamed("item", "feature"), "user")
    scaled = weighted_value(
        asked, seen.withColumnRenamed("item", "feature"), key="user"
    ).withColumnRenamed("feature", "item")
    return (
        scaled.join(ratings.users, "user")
        .select(
            key,
            ratings.feature_of(F.col("item")).alias("feature"),
            ratings.restore(F.col("item"), F.col("value")).alias("value"),
        )
    )
