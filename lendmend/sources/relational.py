"""Relational store <-> lake: partitioned copies, increments and upserts over JDBC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmend.operators.keyed import latest_per_key


def jdbc_read(
    spark: SparkSession,
    url: str,
    table: str,
    column: str | None = None,
    lower: int = 0,
    upper: int = 0,
    partitions: int = 1,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Read in ``partitions`` ranges of a numeric key, one connection each."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=properties or {},
    )


def jdbc_write(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "append",
    connections: int = 8,
    properties: dict[str, str] | None = None,
) -> None:
    """Write with at most ``connections`` open connections."""
    # Not coalesce: that would also run the stage before the write in so few tasks.
    df.repartition(connections).write.option("truncate", "true").jdbc(
        url, table, mode=mode, properties={"batchsize": "10000", **(properties or {})}
    )


def jdbc_sync(
    spark: SparkSession,
    url: str,
    table: str,
    path: str,
    direction: str,
    mode: str = "overwrite",
    **read_options,
) -> None:
    """Copy a table ``to_lake`` or ``to_store``."""
    if direction == "to_lake":
        jdbc_read(spark, url, table, **read_options).write.mode(mode).parquet(path)
    elif direction == "to_store":
        jdbc_write(spark.read.parquet(path), url, table, mode)
    else:
        raise ValueError("direction is 'to_lake' or 'to_store'")


def newer_than(table: DataFrame, ts_col: str, last_ts: datetime | str) -> DataFrame:
    """Rows new or updated since ``last_ts``; the predicate reaches the source."""
    return table.where(F.col(ts_col) > F.lit(last_ts).cast("timestamp"))


def upsert(current: DataFrame, delta: DataFrame, keys: list[str], ts_col: str) -> DataFrame:
    """Merge an increment: the newest row of a key wins, the increment wins a tie."""
    tagged = current.withColumn("_from_delta", F.lit(0)).unionByName(
        delta.withColumn("_from_delta", F.lit(1))
    )
    order = [F.col(ts_col).desc_nulls_last(), F.col("_from_delta").desc()]
    return latest_per_key(tagged, keys, order).drop("_from_delta")


def jdbc_incremental(
    spark: SparkSession,
    url: str,
    table: str,
    ts_col: str,
    last_ts: datetime | str,
    current: DataFrame,
    keys: list[str],
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """The lake copy brought up to date with rows changed since ``last_ts``."""
    delta = newer_than(jdbc_read(spark, url, table, properties=properties), ts_col, last_ts)
    return upsert(current, delta, keys, ts_col)


def publish_clean(
    df: DataFrame, root: str, name: str, url: str | None = None,
    properties: dict[str, str] | None = None,
) -> str:
    """Cleaned rows to the zone, then from the written copy to the relational table."""
    from lendmend.sources.zones import zone_write

    path = zone_write(df, root, "cleaned", name)
    if url:
        jdbc_write(
            df.sparkSession.read.parquet(path), url, name, "overwrite", properties=properties
        )
    return path
