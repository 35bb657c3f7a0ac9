"""The area heat map by hour of event time, kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lendmend.functions.bands import heat

KEYS = ("hour", "area_id")


def hourly_heat(
    decided: DataFrame, risky: str = "risky", ts: str = "apply_time", delay: str = "2 hours", red: float = 0.10, yellow: float = 0.05
) -> DataFrame:
    """(hour, area_id, applications, bad, bad_rate, heat) of a stream or a table with ``area_id`` and a
    boolean ``risky``.

    On a stream an application that is up to ``delay`` behind the newest one still changes its hour's
    row; the state holds the hours that can change.
    """
    rows = decided.withWatermark(ts, delay) if decided.isStreaming else decided
    counted = rows.groupBy(F.window(ts, "1 hour").alias("w"), "area_id").agg(
        F.count(F.lit(1)).alias("applications"), F.count_if(F.col(risky)).alias("bad")
    )
    rate = F.try_divide(F.col("bad").cast("double"), F.col("applications"))
    out = counted.select(F.col("w.start").alias("hour"), "area_id", "applications", "bad", rate.alias("bad_rate"))
    return out.withColumn("heat", heat("bad_rate", red, yellow))


def upsert_hours(path: str) -> Callable[[DataFrame, int], None]:
    """Sink by batch: the rows of a batch replace those of the same hour and area.

    Only the partitions of the hours in the batch are read and rewritten. An update carries the whole
    new row, so a batch that is run again leaves the table as it was.
    """
    from lendmend.sources.zones import discard, written

    def write(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        changed = written(changed.withColumn("hour_key", F.date_format("hour", "yyyy-MM-dd-HH")), "heat-changes")
        merged, at = changed, spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            hours = [r[0] for r in changed.select("hour_key").distinct().collect()]  # those within the delay
            before = spark.read.schema(changed.schema).parquet(path).where(F.col("hour_key").isin(hours))
            kept = before.join(changed.select(*[F.col(c).alias(f"_{c}") for c in KEYS]), _same(), "left_anti")
            merged = changed.unionByName(kept)
        merged = written(merged, "heat-hours")
        (
            merged.repartition("hour_key")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("hour_key")
            .parquet(path)
        )
        discard(merged)
        discard(changed)

    return write


def _same():
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS]
    return same[0] & same[1]


def run_heat(heat_rows: DataFrame, path: str, checkpoint: str, every: str | None = "1 hour") -> StreamingQuery:
    """Starts the refresh. ``every=None`` works off what is there and stops."""
    writer = heat_rows.writeStream.outputMode("update").foreachBatch(upsert_hours(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
