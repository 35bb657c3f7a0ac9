"""Batch files: pick up arriving CSVs, and check that what landed is what was sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def raw_schema(columns: list[str]) -> T.StructType:
    """All columns as text plus the malformed-row column; types come later, by dictionary."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])


def renamed(df: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """File column -> domain column; columns without an entry keep their name."""
    mapping = mapping or {}
    return df.select(*[F.col(c).alias(mapping.get(c, c)) for c in df.columns])


def spool_csv(
    spark: SparkSession,
    directory: str,
    columns: list[str],
    mapping: dict[str, str] | None = None,
    files_per_trigger: int = 1000,
    archive: str | None = None,
) -> DataFrame:
    """Streaming read of a landing directory.

    The checkpoint of the query that consumes it remembers which files are done, so a restart
    goes on where it stopped. With ``archive`` set, finished files are moved there.
    """
    reader = (
        spark.readStream.schema(raw_schema(columns))
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", files_per_trigger)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    landed = reader.csv(directory)
    return renamed(landed, mapping).withColumns(
        {"source_file": F.col("_metadata.file_name"), "ingest_ts": F.current_timestamp()}
    )


def read_csv(
    spark: SparkSession, path: str, columns: list[str], mapping: dict[str, str] | None = None
) -> DataFrame:
    """Batch read with the same treatment of malformed rows."""
    landed = (
        spark.read.schema(raw_schema(columns))
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    return renamed(landed, mapping).withColumn("source_file", F.col("_metadata.file_name"))


def _fingerprint(df: DataFrame, file_col: str, columns: list[str], side: str) -> DataFrame:
    # XOR and sum of row hashes do not depend on row order, and combine map-side.
    # The hash skips nulls, so where they stand is hashed as well.
    row_hash = F.xxhash64(*[F.col(c).isNull() for c in columns], *[F.col(c) for c in columns])
    return df.groupBy(file_col).agg(
        F.count(F.lit(1)).alias(f"{side}_rows"),
        F.bit_xor(row_hash).alias(f"{side}_xor"),
        F.sum(row_hash.cast("decimal(38,0)")).alias(f"{side}_sum"),
    )


def ingest_check(source: DataFrame, landed: DataFrame, file_col: str = "source_file") -> DataFrame:
    """One row per file: rows sent, rows landed and whether the contents agree."""
    columns = [c for c in source.columns if c != file_col]
    sent = _fingerprint(source, file_col, columns, "sent")
    got = _fingerprint(landed, file_col, columns, "landed")
    both = sent.join(got, file_col, "full_outer")
    same = (
        F.col("sent_rows").eqNullSafe(F.col("landed_rows"))
        & F.col("sent_xor").eqNullSafe(F.col("landed_xor"))
        & F.col("sent_sum").eqNullSafe(F.col("landed_sum"))
    )
    return both.select(
        file_col,
        F.coalesce("sent_rows", F.lit(0)).alias("sent_rows"),
        F.coalesce("landed_rows", F.lit(0)).alias("landed_rows"),
        same.alias("complete"),
    )
