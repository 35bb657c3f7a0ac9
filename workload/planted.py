"""Generated tables with a known signal, built by Spark from ``range``; used by tests only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def noise(seed: int) -> Column:
    return F.randn(seed)


def grades(spark: SparkSession, n: int) -> DataFrame:
    """Grade depends on (work, age): 80 % good for salaried middle, else mostly fair."""
    r = F.rand(3)
    work = F.when(F.rand(1) < 0.6, "salaried").otherwise("self")
    age = F.when(F.rand(2) < 0.6, "middle").otherwise("young")
    base = spark.range(n).select(F.col("id").alias("customer_id"), work.alias("work"), age.alias("age"), r.alias("r"))
    hit = (F.col("work") == "salaried") & (F.col("age") == "middle")
    grade = F.when(hit, F.when(F.col("r") < 0.85, "good").otherwise("fair")).otherwise(
        F.when(F.col("r") < 0.9, "fair").otherwise("good")
    )
    return base.withColumn("grade", grade).drop("r")


def low_rank(spark: SparkSession, n: int, features: int, rank: int = 3, known: float = 0.8) -> DataFrame:
    """features columns that are ``rank`` hidden numbers mixed, plus small noise; some missing."""
    hidden = spark.range(n).select(
        F.col("id").alias("customer_id"), *[noise(10 + i).alias(f"u{i}") for i in range(rank)]
    )
    mix = [[((7 * f + 3 * i) % 11) / 5 - 1 for i in range(rank)] for f in range(features)]
    cols = {}
    for f in range(features):
        x = sum((F.col(f"u{i}") * mix[f][i] for i in range(rank)), start=F.lit(0.0))
        cols[f"f{f}"] = 100.0 + 10.0 * (x + 0.05 * noise(100 + f))
    full = hidden.withColumns(cols)
    return full.select(
        "customer_id", *[F.when(F.rand(200 + f) < known, F.col(f"f{f}")).alias(f"f{f}") for f in range(features)]
    )


def defaults(spark: SparkSession, n: int) -> DataFrame:
    """About 7 % defaults from a logit of x1, x2; x3 is noise; some x1 missing."""
    df = spark.range(n).select(
        F.col("id").alias("customer_id"), noise(1).alias("x1"), noise(2).alias("x2"),
        noise(3).alias("x3"), F.rand(4).alias("u"), F.rand(5).alias("m"),
    )
    logit = -3.6 + 1.8 * F.col("x1") - 1.2 * F.col("x2")
    return df.select(
        "customer_id", F.when(F.col("m") > 0.1, F.col("x1")).alias("x1"), "x2", "x3",
        (F.col("u") < 1 / (1 + F.exp(-logit))).cast("int").alias("loan_default"),
    )


def amounts(spark: SparkSession, n: int) -> DataFrame:
    """Amount grows with x and spreads with it."""
    df = spark.range(n).select(F.col("id").alias("loan_id"), (F.rand(1) * 10).alias("x"), noise(2).alias("e"))
    return df.select("loan_id", "x", (1000 + 500 * F.col("x") + 60 * F.col("x") * F.col("e")).alias("disbursed_amount"))
