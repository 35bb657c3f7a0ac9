"""Encoders and scalers. All are fitted on the training split only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmend.functions.ratios import log_amount


def frequency(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) of a column; missing values are not counted."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    # One row joins every row: the constant key keeps it an equality join.
    return (
        counts.withColumn("_k", F.lit(1))
        .join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
        .select(col, "n", (F.col("n").cast("double") / F.col("_total")).alias("share"))
    )


@dataclass
class FrequencyModel:
    """Shares counted once, when fitted; Spark broadcasts a table that is small enough."""

    tables: dict[str, DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        for col, table in self.tables.items():
            df = df.join(table, col, "left").withColumn(
                f"{col}_freq", F.coalesce(f"{col}_freq", F.lit(0.0))
            )
        return df


@dataclass
class FrequencyEncoder:
    """Category -> its share of the training rows; unseen -> 0. Adds ``<col>_freq``."""

    cols: list[str]

    def fit(self, train: DataFrame) -> FrequencyModel:
        from lendmend.sources.zones import written

        return FrequencyModel(
            {
                c: written(frequency(train, c).select(c, F.col("share").alias(f"{c}_freq")), "shares")
                for c in self.cols
            }
        )


def ordinal(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """Position of the value in ``levels`` (0 = lowest); null where it is none of them."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)).cast("int") - 1
    return df.withColumn(f"{col}_level", F.when(pos >= 0, pos))


def one_hot(cols: list[str]) -> Pipeline:
    """Binary vector ``<col>_hot``; unseen and missing values share the last slot."""
    index = StringIndexer(
        inputCols=cols, outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep"
    )
    hot = OneHotEncoder(
        inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_hot" for c in cols],
        dropLast=False,
    )
    return Pipeline(stages=[index, hot])


@dataclass
class ScalerModel:
    stats: dict[str, tuple[float | None, float | None]]
    log: bool = False
    suffix: str = "_std"

    def _x(self, c: str) -> Column:
        return log_amount(c) if self.log else F.col(c).cast("double")

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (mean, sd) in self.stats.items():
            centred = self._x(c) - F.lit(mean)
            # As with StandardScaler, a constant column scales to zero.
            out[f"{c}{self.suffix}"] = (
                centred / F.lit(sd) if sd else F.when(F.col(c).isNotNull(), F.lit(0.0))
            )
        return df.withColumns(out)

    def restore(self, value: Column, c: str) -> Column:
        """Back from the scaled to the original unit."""
        mean, sd = self.stats[c]
        x = value * F.lit(sd or 0.0) + F.lit(mean)
        return F.expm1(x) if self.log else x


@dataclass
class Scaler:
    """Mean 0, sample standard deviation 1; missing values stay missing. Adds ``<col>_std``.

    Scalar columns keep their nulls, which a vector column could not hold.
    """

    cols: list[str]
    log: bool = False

    def fit(self, train: DataFrame) -> ScalerModel:
        model = ScalerModel({}, self.log)
        aggs = []
        for c in self.cols:
            x = model._x(c)
            aggs += [F.avg(x), F.stddev_samp(x)]
        row = list(train.agg(*aggs).first())
        stats = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(self.cols)}
        return ScalerModel(stats, self.log)


def scaler(cols: list[str]) -> Scaler:
    return Scaler(cols)


def log_scaler(cols: list[str]) -> Scaler:
    return Scaler(cols, log=True)


class ImputeWithFlags:
    """Median fill plus a 0/1 column per input that tells what was missing.

    Tree learners here take no nulls; the flag lets them split on missingness.
    """

    def __init__(self, cols: list[str]):
        self.cols = cols

    def fit(self, train: DataFrame) -> "ImputeWithFlagsModel":
        # An all-missing column has no median; it is filled with zero.
        seen = train.agg(*[F.count(c).alias(c) for c in self.cols]).first()
        known = [c for c in self.cols if seen[c]]
        doubles = train.select(*[F.col(c).cast("double").alias(c) for c in known])
        imputer = Imputer(
            inputCols=known, outputCols=[f"{c}_filled" for c in known], strategy="median"
        ).fit(doubles)
        medians = imputer.surrogateDF.first().asDict()
        return ImputeWithFlagsModel({c: float(medians.get(c, 0.0)) for c in self.cols})


@dataclass
class ImputeWithFlagsModel:
    medians: dict[str, float]

    @property
    def output_cols(self) -> list[str]:
        return [f"{c}_filled" for c in self.medians] + [f"{c}_absent" for c in self.medians]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, m in self.medians.items():
            x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            out[f"{c}_filled"] = F.coalesce(x, F.lit(m))
            out[f"{c}_absent"] = x.isNull().cast("double")
        return df.withColumns(out)


def impute_with_flags(cols: list[str]) -> ImputeWithFlags:
    return ImputeWithFlags(cols)

