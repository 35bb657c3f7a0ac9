"""The live decision flow: the batch code applied to every micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lendmend.operators.encode import ImputeWithFlagsModel
from lendmend.operators.features import derive
from lendmend.operators.models import probability
from lendmend.operators.repair import RepairModel
from lendmend.operators.scoring import scorecard
from lendmend.streaming.intake import Intake


@dataclass
class Models:
    """Everything a batch needs, fitted offline and loaded once before the stream starts."""

    default: PipelineModel
    amount: PipelineModel | None = None
    imputer: ImputeWithFlagsModel | None = None
    repair: RepairModel | None = None
    class_weight: float = 1.0
    featured: DataFrame | None = None  # static customer features, joined by customer_id
    key: str = "application_id"
    keep: tuple[str, ...] = field(default=("customer_id",))


def decide(batch_df: DataFrame, models: Models) -> DataFrame:
    """Missing check, repair, features, default and amount models, score.

    Works the same on a batch table and on a micro-batch; nothing is refitted.
    """
    rows = batch_df
    if models.featured is not None:
        # Cut the feature table down to the batch's customers first: that is a filter while it
        # is scanned, where an outer join would shuffle the whole table every batch.
        asked = rows.select("customer_id").distinct()
        known = models.featured.join(asked, "customer_id", "left_semi")
        rows = rows.join(known, "customer_id", "left")
    if "features" in rows.columns:
        # The message's own numbers serve where the featured zone has none: of that name, or of a
        # customer it does not know. What is still missing is repaired from them.
        wanted = [] if models.imputer is None else list(models.imputer.medians)
        if models.repair is not None:
            wanted += [c for c in models.repair.numeric if c not in wanted]
        types = dict(rows.dtypes)

        def own(c):
            told = F.try_element_at("features", F.lit(c))
            return told if c not in types else F.coalesce(F.col(c), told.cast(types[c]))

        rows = rows.withColumns({c: own(c) for c in wanted}).drop("features")
    if models.repair is not None:
        rows = models.repair.repair(rows, models.key, "customer_id")
    if {"outstanding", "disbursed", "approved", "installment"} <= set(rows.columns):
        rows = derive(rows)
    if models.imputer is not None:
        rows = models.imputer.transform(rows)
    scored = probability(models.default.transform(rows))
    # Drop what the first model leaves behind, so the second can write the same names.
    scored = scored.drop("features", "rawPrediction", "probability", "prediction")
    if models.amount is not None:
        scored = (
            models.amount.transform(scored)
            .withColumnRenamed("prediction", "suggested_amount")
            .drop("features")
        )
    out = scorecard(scored, "p", weight=models.class_weight)
    cols = [models.key, *models.keep, "p", "score", "grade", "policy"]
    return out.select(*cols, *[c for c in ("suggested_amount", "repairs") if c in out.columns])


def write_batch_files(path: str) -> Callable[[DataFrame, int], None]:
    """Sink by batch: a repeated batch replaces its own folder, so nothing doubles."""

    def write(decisions: DataFrame, batch_id: int) -> None:
        (
            decisions.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    return write


def decision_sink(
    url: str, table: str, key: str = "application_id", properties: dict[str, str] | None = None
) -> Callable[[DataFrame, int], None]:
    """Sink to a relational table that exists: rows of this batch already there are skipped."""
    from lendmend.sources.relational import jdbc_read, jdbc_write

    def write(decisions: DataFrame, batch_id: int) -> None:
        there = jdbc_read(decisions.sparkSession, url, table, properties=properties)
        done = there.where(F.col("batch_id") == batch_id).select(key)
        fresh = decisions.withColumn("batch_id", F.lit(batch_id)).join(done, key, "left_anti")
        jdbc_write(fresh, url, table, "append", properties=properties)

    return write


def batch_step(
    models: Models,
    sink: Callable[[DataFrame, int], None],
    monitor: Callable[[DataFrame, int], None] | None = None,
    intake: Intake | None = None,
    record: Callable[[SparkSession, int, int, float], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """What runs per micro-batch. Decisions are written once, monitored from the copy, and the copy
    is deleted when the batch is done.

    ``intake`` sets aside what must not be decided; ``record`` is told batch, rows and seconds.
    """
    from lendmend.sources.zones import discard, shuffles_freed, written

    def step(batch_df: DataFrame, batch_id: int) -> None:
        with shuffles_freed(batch_df.sparkSession):  # a stream has a session of its own
            work(batch_df, batch_id)

    def work(batch_df: DataFrame, batch_id: int) -> None:
        began = time.monotonic()
        fresh = batch_df if intake is None else intake.sort_out(batch_df, batch_id)
        decisions = written(decide(fresh, models), "decisions")
        sink(decisions, batch_id)
        if monitor is not None:
            monitor(decisions, batch_id)
        if record is not None:
            rows = decisions.count() if intake is None else intake.rows
            record(decisions.sparkSession, batch_id, rows, time.monotonic() - began)
        discard(decisions)
        if intake is not None:
            discard(fresh)

    return step


def run(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = "10 seconds",
) -> StreamingQuery:
    """Start the flow. ``every=None`` works off what is there and stops."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def check_parity(stream_out: DataFrame, batch_out: DataFrame, key: str = "application_id") -> DataFrame:
    """Decisions on which stream and batch disagree (also those only one of them made)."""
    a = stream_out.select(key, F.round("p", 9).alias("p_stream"), F.round("score", 6).alias("s_stream"))
    b = batch_out.select(key, F.round("p", 9).alias("p_batch"), F.round("score", 6).alias("s_batch"))
    return a.join(b, key, "full_outer").where(
        ~(
            F.col("p_stream").eqNullSafe(F.col("p_batch"))
            & F.col("s_stream").eqNullSafe(F.col("s_batch"))
        )
    )
