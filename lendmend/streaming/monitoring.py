"""Per-batch measures, alerts and throughput."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_metrics(
    batch_df: DataFrame, batch_id: int, threshold: float = 0.5, amount: str = "suggested_amount"
) -> DataFrame:
    """One row: rows, predicted default rate, mean amount."""
    amt = F.avg(F.col(amount).cast("double")) if amount in batch_df.columns else F.lit(None).cast("double")
    return batch_df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(F.col("p") >= threshold, 1.0).otherwise(0.0)).alias("default_rate"),
        amt.alias("mean_amount"),
    ).select(F.lit(batch_id).cast("bigint").alias("batch_id"), "*")


METRICS = "rows bigint, default_rate double, mean_amount double, batch_id bigint"
TRAILED = ("default_rate", "mean_amount")


def trailing_means(spark: SparkSession, metrics_path: str, batch_id: int, batches: int) -> dict[str, float | None]:
    """Mean of each measure over the last ``batches`` committed batches before ``batch_id`` that had rows.

    The measures of a batch that is run again, and of any after it, are not looked at, so the answer is
    that of the first run. One row per batch, and only the last ones are kept.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(metrics_path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return dict.fromkeys(TRAILED)
    before = spark.read.schema(METRICS).parquet(metrics_path).where((F.col("batch_id") < batch_id) & (F.col("rows") > 0))
    last = before.orderBy(F.desc("batch_id")).limit(batches)
    return last.agg(*[F.avg(c).alias(c) for c in TRAILED]).first().asDict()


def monitor(
    metrics_path: str, alerts_path: str, max_default_rate: float = 0.2, min_rows: int = 0,
    threshold: float = 0.5, trailing: int = 0, factor: float = 1.5,
) -> Callable[[DataFrame, int], None]:
    """Write the batch's measures, and an alert row for every limit it breaks.

    With ``trailing`` a measure is also held against its mean over so many committed batches before,
    and an alert (measure ``..._jump``) is raised where it is above ``factor`` times that. Both tables
    are partitioned by batch, so a repeated batch replaces its own rows and alerts once.
    """

    def write(df: DataFrame, path: str) -> None:
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    def observe(batch_df: DataFrame, batch_id: int) -> None:
        row = batch_metrics(batch_df, batch_id, threshold).first()
        spark = batch_df.sparkSession
        write(
            spark.createDataFrame(
                [tuple(row)], "batch_id bigint, rows bigint, default_rate double, mean_amount double"
            ),
            metrics_path,
        )
        alerts = []
        if row["default_rate"] is not None and row["default_rate"] > max_default_rate:
            alerts.append((batch_id, "default_rate", row["default_rate"], max_default_rate))
        if row["rows"] < min_rows:
            alerts.append((batch_id, "rows", float(row["rows"]), float(min_rows)))
        means = trailing_means(spark, metrics_path, batch_id, trailing) if trailing else {}
        for measure, mean in means.items():
            if mean is not None and row[measure] is not None and row[measure] > factor * mean:
                alerts.append((batch_id, f"{measure}_jump", row[measure], factor * mean))
        if alerts:
            write(
                spark.createDataFrame(
                    alerts, "batch_id bigint, measure string, value double, allowed double"
                ),
                alerts_path,
            )

    return observe


def record_progress(path: str) -> Callable[[SparkSession, int, int, float], None]:
    """Keeps rows and time of every batch in a table; a repeated batch replaces its own row."""

    def record(spark: SparkSession, batch_id: int, rows: int, seconds: float) -> None:
        (
            spark.createDataFrame([(batch_id, rows, int(seconds * 1000))], "batch_id bigint, rows bigint, took_ms bigint")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    return record


def throughput(
    spark: SparkSession, path: str, min_rows_per_second: float = 1000.0, max_ms_per_row: float = 100.0
) -> DataFrame:
    """Throughput of every batch that ``record_progress`` has seen, against the targets."""
    rate = F.try_divide(F.col("rows") * 1000.0, "took_ms")
    per_row = F.try_divide(F.col("took_ms").cast("double"), "rows")
    return spark.read.parquet(path).select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "rows", "took_ms",
        rate.alias("rows_per_second"), per_row.alias("ms_per_row"),
        ((rate >= min_rows_per_second) & (per_row <= max_ms_per_row)).alias("on_target"),
    )


def progress_rows(
    spark: SparkSession, progress: list, min_rows_per_second: float = 1000.0,
    max_ms_per_row: float = 100.0,
) -> DataFrame:
    """Throughput per micro-batch from ``query.recentProgress``, against the targets."""
    rows = []
    for p in progress:
        n, took = int(p["numInputRows"]), int(p["durationMs"].get("triggerExecution", 0))
        rows.append(
            (
                int(p["batchId"]), n, took,
                n * 1000.0 / took if took else None,
                took / n if n else None,
            )
        )
    out = spark.createDataFrame(
        rows, "batch_id bigint, rows bigint, took_ms bigint, rows_per_second double, ms_per_row double"
    )
    return out.withColumn(
        "on_target",
        (F.col("rows_per_second") >= min_rows_per_second) & (F.col("ms_per_row") <= max_ms_per_row),
    )
