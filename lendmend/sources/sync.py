"""Incremental sync with a stored high-water mark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmend.operators.keyed import latest_per_key


@dataclass
class Sync:
    """A table that follows a source by its change time.

    Rows live in partitions by a hash of their key, so a newer version meets the older one in its own
    partition, and only partitions that an increment touches are rewritten. The mark is the newest
    change time taken over; it is written after the rows. A run that fails in between, or is repeated,
    takes the same rows over again and leaves the same table. Rows at the mark itself are read again,
    since the source may have got more of that instant. Rows without key or change time are not taken.
    """

    root: str
    key: str
    ts_col: str
    buckets: int = 64

    @property
    def rows_path(self) -> str:
        return f"{self.root}/rows"

    @property
    def marks_path(self) -> str:
        return f"{self.root}/marks"

    def _exists(self, spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def mark(self, spark: SparkSession):
        """The newest change time taken over, or None."""
        if not self._exists(spark, self.marks_path):
            return None
        return spark.read.parquet(self.marks_path).agg(F.max("mark")).first()[0]  # a row per increment

    def newer(self, source: DataFrame) -> DataFrame:
        """What the source has from the mark on; the filter reaches the source's scan."""
        mark = self.mark(source.sparkSession)
        known = source.where(F.col(self.key).isNotNull() & F.col(self.ts_col).isNotNull())
        return known if mark is None else known.where(F.col(self.ts_col) >= F.lit(mark))

    def run(self, source: DataFrame) -> int:
        """Takes over what is new; the number of partitions rewritten."""
        from lendmend.sources.zones import discard, written

        spark = source.sparkSession
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        fresh = latest_per_key(self.newer(source), [self.key], [F.col(self.ts_col).desc()])
        fresh = written(fresh.withColumn("bucket", bucket), "increment")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        if touched:
            merged = fresh
            if self._exists(spark, self.rows_path):
                before = spark.read.schema(fresh.schema).parquet(self.rows_path).where(F.col("bucket").isin(touched))
                old = fresh.select(F.col(self.key).alias("_key"), F.col(self.ts_col).alias("_ts"))
                both = before.join(old, F.col(self.key) == F.col("_key"), "left")
                # A version that is already newer stays; at the same instant the source's wins.
                stays = both.where(F.col("_key").isNull() | (F.col(self.ts_col) > F.col("_ts"))).select(*fresh.columns)
                newer = stays.select(F.col(self.key).alias("_key"))
                merged = stays.unionByName(fresh.join(newer, F.col(self.key) == F.col("_key"), "left_anti"))
            merged = written(merged, "merged")
            (
                merged.repartition("bucket")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("bucket")
                .parquet(self.rows_path)
            )
            discard(merged)
            fresh.agg(F.max(self.ts_col).alias("mark")).write.mode("append").parquet(self.marks_path)
        discard(fresh)
        return len(touched)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.rows_path).drop("bucket")
