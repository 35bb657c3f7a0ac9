"""What becomes of every arriving message: decided, malformed, late or repeated; nothing is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUTCOMES = ("decided", "malformed", "late", "repeated")
LEDGER = (
    "outcome string, reason string, application_id string, apply_time timestamp, payload string, "
    "apply_date date, batch_id bigint"
)
MARKS = "high timestamp, batch_id bigint"


class Intake:
    """Sorts micro-batches and keeps a ledger of every message with its outcome and text.

    * malformed: unreadable, or without application id or time; never scored.
    * repeated: the id came before, in this batch or an earlier one. Redelivery carries the same
      apply time, so only the ledger's dates that occur in the batch are read.
    * late: a first delivery more than ``delay`` behind the newest application of earlier batches.
    * decided: all others.

    The ledger is partitioned by date and batch, so a batch that is run again replaces its own rows
    and does not take them for earlier ones.
    """

    def __init__(self, root: str, delay: str = "1 day"):
        self.ledger, self.marks, self.delay = f"{root}/ledger", f"{root}/marks", delay
        self.rows = 0  # messages of the last batch

    def _read(self, spark: SparkSession, path: str, schema: str) -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path)

    def sort_out(self, batch_df: DataFrame, batch_id: int) -> DataFrame:
        """The applications to decide, as a written table; all outcomes go to the ledger."""
        from lendmend.sources.zones import discard, written

        spark = batch_df.sparkSession
        earlier = self._read(spark, self.marks, MARKS).where(F.col("batch_id") < batch_id)
        high = earlier.agg(F.max("high")).first()[0]  # one row per batch
        bad = F.col("application_id").isNull() | F.col("apply_time").isNull()
        if "bad_message" in batch_df.columns:
            bad |= F.col("bad_message").isNotNull()
        rows = batch_df.withColumns(
            {
                "_bad": bad,
                "_date": F.to_date("apply_time"),
                "_payload": F.to_json(F.struct(*batch_df.columns)),
            }
        )
        first = F.row_number().over(W.partitionBy("application_id").orderBy("apply_time", "_payload"))
        # Malformed messages are set apart before they could meet under one null id.
        good = rows.where(~F.col("_bad")).withColumn("_nth", first)
        known = self._read(spark, self.ledger, LEDGER).where(F.col("batch_id") != batch_id)
        known = known.where(F.col("outcome").isin("decided", "late")).select(
            F.col("application_id").alias("_known"), F.col("apply_date").alias("_seen")
        )
        asked = good.select("application_id", "_date").distinct()
        seen = known.join(asked, (F.col("_known") == F.col("application_id")) & (F.col("_seen") == F.col("_date")), "left_semi")
        good = good.join(seen.select("_known").distinct(), F.col("application_id") == F.col("_known"), "left")
        late = F.lit(False) if high is None else F.col("apply_time") < F.lit(high) - F.expr(f"INTERVAL {self.delay}")
        outcome = (
            F.when((F.col("_nth") > 1) | F.col("_known").isNotNull(), "repeated").when(late, "late").otherwise("decided")
        )
        sorted_ = written(
            good.withColumn("_outcome", outcome)
            .drop("_nth", "_known")
            .unionByName(rows.where("_bad").withColumn("_outcome", F.lit("malformed"))),
            "sorted",
        )
        reason = (
            F.when(F.col("_outcome") == "malformed", "not readable, or without id or time")
            .when(F.col("_outcome") == "late", f"more than {self.delay} behind")
            .when(F.col("_outcome") == "repeated", "delivered before")
        )
        self._write(
            sorted_.select(
                F.col("_outcome").alias("outcome"), reason.alias("reason"), "application_id", "apply_time",
                F.col("_payload").alias("payload"), F.col("_date").alias("apply_date"), F.lit(batch_id).alias("batch_id"),
            ),
            self.ledger, ["apply_date", "batch_id"],
        )
        decided = sorted_.where("_outcome = 'decided'")
        newest, self.rows = sorted_.agg(
            F.max(F.when(F.col("_outcome") == "decided", F.col("apply_time"))), F.count(F.lit(1))
        ).first()
        self._write(
            spark.createDataFrame([(newest, batch_id)], MARKS), self.marks, ["batch_id"]
        )
        fresh = written(decided.drop("_bad", "_date", "_payload", "_outcome", "bad_message"), "fresh")
        discard(sorted_)
        return fresh

    def _write(self, df: DataFrame, path: str, by: list[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """(outcome, messages) of everything that arrived."""
        return self._read(spark, self.ledger, LEDGER).groupBy("outcome").agg(F.count(F.lit(1)).alias("messages"))
