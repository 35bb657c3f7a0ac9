"""Zones (raw, cleaned, featured, model), table layouts and the quarantine sink."""

from __future__ import annotations

import importlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = ("raw", "cleaned", "featured", "model")
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="lendmend-")
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the copy.

    Used where a result feeds several branches, or an action decides the rest of the plan.
    The copy survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*copies: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in copies:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def zone_path(root: str, zone: str, name: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}, expected one of {ZONES}")
    return f"{root.rstrip('/')}/{zone}/{name}"


def zone_write(
    df: DataFrame, root: str, zone: str, name: str, partition_by: list[str] | None = None
) -> str:
    """Write a table into its zone; only the partitions present in ``df`` are replaced."""
    path = zone_path(root, zone, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
    return path


def zone_read(spark: SparkSession, root: str, zone: str, name: str) -> DataFrame:
    return spark.read.parquet(zone_path(root, zone, name))


def with_quarter(df: DataFrame, date_col: str) -> DataFrame:
    return df.withColumns({"year": F.year(date_col), "quarter": F.quarter(date_col)})


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession):
    """The shuffle files of a copy that is written inside go with its job, not when the driver next collects garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def partitioned_table(
    df: DataFrame, date_col: str, path: str, target_bytes: int = 128 << 20, files_per_quarter: int | None = None
) -> str:
    """Parquet by year and quarter, in files of about ``target_bytes`` of shuffled rows.

    Spark counts the bytes of every quarter while they are shuffled, and cuts a large one into several
    tasks and files by itself: a quarter with a third of all rows lands in no single task, and a small
    one is one file. ``files_per_quarter`` fixes the number instead, by a hash of the row.
    """
    out = with_quarter(df, date_col)
    if files_per_quarter is None:
        out = out.sparkSession.sql("SELECT /*+ REBALANCE(year, quarter) */ * FROM {rows}", rows=out)
    else:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_quarter))
        out = out.repartition("year", "quarter", salt)
    with _setting(df.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes)):
        (
            out.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("year", "quarter")
            .parquet(path)
        )
    return path


def between_dates(df: DataFrame, date_col: str, start: str, end: str) -> DataFrame:
    """start <= date < end, with the year/quarter predicate that prunes the partitions.

    Spark does not derive it from a date range by itself.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    y0, y1 = int(start[:4]), int(end[:4])
    q0, q1 = (int(start[5:7]) - 1) // 3 + 1, (int(end[5:7]) - 1) // 3 + 1
    ordinal = F.col("year") * 4 + F.col("quarter")
    return df.where(
        F.col("year").between(y0, y1)
        & ordinal.between(y0 * 4 + q0, y1 * 4 + q1)
        & (F.col(date_col) >= lo)
        & (F.col(date_col) < hi)
    )


def cluster_by_key(
    df: DataFrame, table: str, key: str = "customer_id", sort: str = "disbursed_date",
    buckets: int = 64, path: str | None = None,
) -> str:
    """Bucketed, sorted table with a Parquet bloom filter on the key.

    Joins and windows on the key then need no shuffle, and a lookup of one key reads one
    bucket and skips row groups.
    """
    writer = (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key, sort)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
    )
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return table


def compact(spark: SparkSession, path: str, target: str, files: int) -> str:
    """Rewrite a table of many small files into ``files`` files at ``target``."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(target)
    return target


def quarantine_sink(bad: DataFrame, path: str, ingest_date: Column | None = None) -> str:
    """Append non-repairable rows, by ingest date. All source columns are kept as text."""
    day = ingest_date if ingest_date is not None else F.current_date()
    kept = [F.col(c).cast("string").alias(c) for c in bad.columns if c != "reasons"]
    (
        bad.select(*kept, "reasons", day.alias("ingest_date"))
        .write.mode("append")
        .partitionBy("ingest_date")
        .parquet(path)
    )
    return path


class ModelStore:
    """Versioned models in the model zone."""

    def __init__(self, root: str):
        self.root = root

    def path(self, name: str, version: int) -> str:
        return zone_path(self.root, "model", f"{name}/v{version}")

    def save(self, model: PipelineModel, name: str, version: int) -> str:
        path = self.path(name, version)
        model.write().overwrite().save(path)
        return path

    def load(self, name: str, version: int) -> PipelineModel:
        return PipelineModel.load(self.path(name, version))

    def save_fitted(self, spark: SparkSession, fitted: Any, name: str, version: int) -> str:
        """Any fitted object of this library: its tables, MLlib models, arrays and plain values."""
        path = self.path(name, version)
        spec = json.dumps(_stored(spark, fitted, f"{path}/state"))
        spark.createDataFrame([(spec,)], "value string").write.mode("overwrite").text(f"{path}/spec")
        return path

    def load_fitted(self, spark: SparkSession, name: str, version: int) -> Any:
        path = self.path(name, version)
        spec = spark.read.option("wholetext", True).text(f"{path}/spec").first()[0]
        return _restored(spark, json.loads(spec), f"{path}/state")

    def has(self, spark: SparkSession, name: str, version: int) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name, version)}/spec/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _stored(spark: SparkSession, value: Any, path: str) -> dict:
    """Writes what JSON cannot hold below ``path`` and describes the value."""
    if value is None or isinstance(value, (str, int, float, bool)):
        return {"plain": value}
    if isinstance(value, (list, tuple)):
        parts = [_stored(spark, v, f"{path}/{i}") for i, v in enumerate(value)]
        return {"tuple" if isinstance(value, tuple) else "list": parts}
    if isinstance(value, dict):
        return {"dict": [[_stored(spark, k, path), _stored(spark, v, f"{path}/{i}")] for i, (k, v) in enumerate(value.items())]}
    if isinstance(value, np.ndarray):
        spark.createDataFrame(
            [(list(value.shape), value.astype(float).ravel().tolist())], "shape array<int>, cells array<double>"
        ).write.mode("overwrite").parquet(path)
        return {"array": True}
    if isinstance(value, DataFrame):
        value.write.mode("overwrite").parquet(path)
        return {"table": True}
    kind = type(value)
    if hasattr(value, "write") and kind.__module__.startswith("pyspark.ml"):
        value.write().overwrite().save(path)
        return {"model": [kind.__module__, kind.__qualname__]}
    if kind.__module__.split(".")[0] != __name__.split(".")[0]:
        raise TypeError(f"cannot store a {kind.__name__}")
    fields = {k: _stored(spark, v, f"{path}/{k}") for k, v in vars(value).items()}
    return {"object": [kind.__module__, kind.__qualname__], "fields": fields}


def _restored(spark: SparkSession, spec: dict, path: str) -> Any:
    if "plain" in spec:
        return spec["plain"]
    for kind in ("list", "tuple"):
        if kind in spec:
            parts = [_restored(spark, s, f"{path}/{i}") for i, s in enumerate(spec[kind])]
            return parts if kind == "list" else tuple(parts)
    if "dict" in spec:
        return {_restored(spark, k, path): _restored(spark, v, f"{path}/{i}") for i, (k, v) in enumerate(spec["dict"])}
    if "array" in spec:
        row = spark.read.parquet(path).first()
        return np.array(row["cells"]).reshape(row["shape"])
    if "table" in spec:
        return spark.read.parquet(path)
    module, name = spec.get("model") or spec["object"]
    if module.split(".")[0] not in ("pyspark", __name__.split(".")[0]):
        raise TypeError(f"cannot load a {module}.{name}")
    kind = getattr(importlib.import_module(module), name)
    if "model" in spec:
        return kind.load(path)
    out = kind.__new__(kind)
    out.__dict__.update({k: _restored(spark, s, f"{path}/{k}") for k, s in spec["fields"].items()})
    return out
