"""Line dedup by hashes of runs of lines.

Every shortest run of consecutive lines with at least ``WORDS`` words is a window, with the hash of
all its lines; the least line hash in it is its fingerprint. Windows whose fingerprint stands at one
place only are left out, the others are compared by their hashes. This takes the place of winnowing
with extension: a longer repeat is the union of its windows. A window that occurred before, in
document order, is deleted with all its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import written

WORDS = 50  # words of the shortest run that counts as a repeat


def windows_of(hashes: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    """(fingerprint, key, place, start, end) of each shortest run with ``least`` words.

    Runs that are shortest from their first line on, or from their last line back. ``key`` is the
    hash of all the run's lines, ``place`` the line of the fingerprint.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + least)  # lines before the end of a run from each line
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    runs = {(i, int(j)) for i, j in enumerate(ends) if j <= n}
    runs |= {(int(i), j + 1) for j, i in enumerate(starts) if i >= 0 and total[j + 1] - total[i] >= least}
    out = []
    for i, j in sorted(runs):
        part = hashes[i:j]
        at = int(part.argmin())
        out.append((int(part[at]), xxhash.xxh64_intdigest(part.tobytes(), 7) - (1 << 63), i + at, i, j))
    return out


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("line_text"):
                lines = (text.as_py() or b"").split(b"\n")
                hashes = np.array([xxhash.xxh64_intdigest(x.strip(), 42) - (1 << 63) for x in lines], np.int64)
                words = np.array([len(x.split()) for x in lines], np.int64)
                rows.append([dict(zip(("fp", "key", "place", "start", "end"), w, strict=True)) for w in windows_of(hashes, words, least)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], [*batch.schema.names[:-1], "windows"])

    kind = pa.list_(pa.struct([("fp", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    return run


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", row_col: str = "row", text_col: str = "text", least: int = WORDS) -> DataFrame:
    """(row, cuts): per row the line ranges (start, end) to delete, end exclusive.

    ``row`` identifies a row; order is by id (null first), then row, then line. Of a run that
    repeats within its own overlap, the lines of its first occurrence stay.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(row_col).alias("row"), F.col(text_col).cast("binary").alias("line_text"))
    kind = given.schema["id"].dataType.simpleString()
    found = given.mapInArrow(
        _windows(least), f"id {kind}, row long, windows array<struct<fp:long,key:long,place:int,start:int,end:int>>"
    )
    windows = written(found.select("id", "row", F.explode("windows").alias("w")).select("id", "row", "w.*"), "windows")
    # Fingerprints at more than one position; copies are combined before they are dealt.
    place = F.struct("row", "place")
    shared = windows.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp")
    joined = windows.join(shared, "fp")
    first = joined.groupBy("fp", "key").agg(F.min(F.struct("id", "row", "start", "end")).alias("first"), F.count("*").alias("n"))
    later = joined.join(first.where("n > 1").drop("n"), ["fp", "key"]).where(
        (F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))
    )
    start = F.when(F.col("row") == F.col("first.row"), F.greatest("start", "first.end")).otherwise(F.col("start"))
    cuts = later.select("row", start.alias("start"), "end").where("start < end")
    return cuts.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS) -> DataFrame:
    """``docs`` with later repeats of runs of at least ``least`` words deleted from ``text_col``.

    Lines are what stands between newlines, compared without white space at their ends; words are
    split at ASCII white space. Adds ``n_lines`` and ``n_removed``. Rows stay, also if no line
    remains (then the text is empty); a null text stays null and has no lines. Repeated rows: the first keeps its
    lines. Rows with a null id come first in order. An empty table stays empty. Columns named
    ``n_lines`` and ``n_removed`` are replaced, all others kept.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = written(docs.select(*names, F.monotonically_increasing_id().alias("__row")), "rows")
    cuts = written(repeated_runs(rows, id_col, "__row", text_col, least), "cuts").select(F.col("row").alias("__row"), F.col("cuts").alias("__cuts"))
    joined = rows.join(cuts.hint("merge"), "__row", "left")
    lines = F.split(F.col(text_col), "\n", -1)
    inside = lambda i: F.exists("__cuts", lambda c: (c.start <= i) & (i < c.end))
    kept = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~inside(i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), inside))).cast("long")
    out = joined.select(*[F.col(c) for c in names], n_lines.alias("n_lines"), gone.alias("n_removed"), kept.alias("__kept"))
    return out.select(*[F.col("__kept").alias(c) if c == text_col else F.col(c) for c in [*names, "n_lines", "n_removed"]])
