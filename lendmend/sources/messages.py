"""The application topic, with a file source of the same shape where no broker is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmend.functions.payload import decode
from lendmend.schema import APPLICATION

TOPIC = "lending_application"


def decoded(messages: DataFrame, schema=APPLICATION) -> DataFrame:
    """``value`` as JSON -> typed columns. The raw text is kept for messages that fail."""
    text = F.col("value").cast("string")
    return (
        messages.select(text.alias("_text"), decode(text, schema).alias("_m"))
        .select(
            "_m.*",
            F.when(F.col("_m.application_id").isNull(), F.col("_text")).alias("bad_message"),
        )
    )


def application_stream(
    spark: SparkSession,
    brokers: str | None = None,
    directory: str | None = None,
    topic: str = TOPIC,
    files_per_trigger: int = 100,
    max_offsets: int = 100_000,
) -> DataFrame:
    """Applications from the topic, or from JSON-line files in ``directory``."""
    if brokers:
        messages = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("subscribe", topic)
            .option("maxOffsetsPerTrigger", max_offsets)
            .option("failOnDataLoss", "true")
            .load()
        )
    elif directory:
        messages = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(directory)
    else:
        raise ValueError("give brokers or directory")
    return decoded(messages)


def once_per_application(apps: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop redelivered applications; state is kept for ``delay`` of event time."""
    return apps.withWatermark("apply_time", delay).dropDuplicatesWithinWatermark(
        ["application_id"]
    )
