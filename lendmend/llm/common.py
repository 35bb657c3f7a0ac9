"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmend.sources.zones import shared_dir

_folders: list[str] = []


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the copy, which survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """A written copy of ``docs`` with a row number ``__row``.

    Numbers made while a table is scanned hold for that scan only: another one may cut the files
    into other splits. What is joined by row number reads this copy.
    """
    return written(docs.select("*", F.monotonically_increasing_id().alias("__row")), "rows", compression="zstd")


def mark() -> int:
    """A point in the list of copies; see ``since`` and ``remove``."""
    return len(_folders)


def since(point: int) -> list[str]:
    return _folders[point:]


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete copies that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside; rows with whole texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a copy that is written inside go with its job, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for every linked node.

    Alternating large-star and small-star: each round hangs every node under the smallest
    neighbour it knows, so a component of diameter d needs about log d rounds, and a hub costs one
    row per neighbour. Each round is written, the rows stay in the cluster.
    """

    def seen(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(edges.where("u <> v").distinct(), "links")
    mark = seen(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "links")
        now = seen(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def slices(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive parts of a string column of about ``most`` bytes each; a longer text is a part by itself."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())).to_numpy()
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, stop - at)
        at = stop


def taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[0]:][:sizes[0]], values[starts[1]:][:sizes[1]], ... one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def gathered(texts: pa.Array, ids_of: Callable[[list[str]], list[bytes]], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of texts from those of their parts between ASCII white space.

    ``ids_of`` gives the ids of every distinct part as numbers of ``kind``. Returns all ids, one text
    after the other, and where each text's begin, with the end.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = parts.flatten().dictionary_encode()
    ids = ids_of(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(kind).itemsize
    at = coded.indices.to_numpy()
    flat = taken(np.frombuffer(b"".join(ids), kind), (np.cumsum(size) - size)[at], size[at])
    ends = np.r_[0, np.cumsum(size[at])]
    offsets = parts.offsets.to_numpy()
    return flat, ends[offsets - offsets[0]]
