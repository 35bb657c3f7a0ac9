"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Candidates and queries are packed into blocks of bounded size, every query block meets every
candidate block in a cell of its own, and a cell scatters one dimension after the other of the
query rows, weighted, into dense score arrays. Each cell keeps k rows for a query; the cells' rows
are merged by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendmend.llm.common import written

CANDIDATES = 4096  # rows of a candidate block
QUERIES = 1024  # rows of a query block
SLAB = 64  # query rows whose score arrays are open at once
NARROW = 2**31  # blocks whose components are all below this take four bytes for each
EXACT = float(2**53)  # from here on every double is whole


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, q array<double>): floor(scale * x) of each component x as double.

    Left out are null ids, null vectors, and vectors with a null or non-finite component, also once scaled.
    """

    def down(x):
        big = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(big) >= EXACT, big).otherwise(F.floor(F.when(F.abs(big) < EXACT, big)).cast("double"))

    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double") * float(scale)) < float("inf"), F.lit(False)))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), down).alias("q")
    )


def _packed(rows: DataFrame, size: int, block: str) -> DataFrame:
    """Blocks of at most ``size`` rows, ordered by id; shorter vectors are filled with zeros."""

    parts = max(1, -(-rows.count() // size))

    def pack(ids, vectors, part, n):
        order = np.argsort(ids, kind="stable")
        dims = max(map(len, vectors), default=0)
        matrix = np.zeros((len(ids), dims))
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        wide = bool((np.abs(matrix) >= NARROW).any())
        matrix = matrix if wide else matrix.astype(np.int32)
        return {
            f"{block}": [n * parts + part], f"{block}_ids": [ids[order].tobytes()],
            f"{block}_rows": [matrix[order].tobytes()], f"{block}_dims": [dims], f"{block}_wide": [wide],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, ids, vectors = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += [np.asarray(v.values) if len(v) else np.zeros(0) for v in batch.column(1)]
            while len(ids) >= size:
                yield pa.RecordBatch.from_pydict(pack(np.array(ids[:size], np.int64), vectors[:size], part, n), names)
                ids, vectors, n = ids[size:], vectors[size:], n + 1
        if ids:
            yield pa.RecordBatch.from_pydict(pack(np.array(ids, np.int64), vectors, part, n), names)

    names = pa.schema(
        [(block, pa.int64()), (f"{block}_ids", pa.binary()), (f"{block}_rows", pa.binary()), (f"{block}_dims", pa.int32()), (f"{block}_wide", pa.bool_())]
    )
    dealt = rows.repartition(parts, F.xxhash64("id"))
    return written(dealt.mapInArrow(run, f"{block} long, {block}_ids binary, {block}_rows binary, {block}_dims int, {block}_wide boolean"), block)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller position."""
    if scores.dtype == object:
        scores = _fitted(scores).astype(object)
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:k], np.int64)
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        at = np.concatenate([over, tied[: k - len(over)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))]


def _largest(rows: np.ndarray) -> int:
    return int(np.abs(rows.astype(np.float64)).max(initial=0))


def _whole(rows: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return rows.astype(kind)
    out = np.empty(rows.shape, object)
    out.ravel()[:] = [int(x) for x in rows.ravel()]
    return out


def _fitted(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers; one beyond them is the nearest of these."""
    if scores.dtype == object:
        scores = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores], np.int64)
    return scores.astype(np.int64)


def _cell(k: int):
    def one(c_ids, c_rows, q_ids, q_rows):
        """Top rows of a cell: query position, candidate id, score."""
        dims = min(c_rows.shape[1], q_rows.shape[1])
        bound = _largest(c_rows) * _largest(q_rows) * max(1, dims)
        kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object  # all exact; floats are fastest
        columns, q_rows = _whole(np.ascontiguousarray(c_rows.T), kind), _whole(q_rows, kind)
        out = []
        for at in range(0, len(q_ids), SLAB):
            q = q_rows[at : at + SLAB]
            scores = np.zeros((len(q), len(c_ids)), kind)
            for d in range(dims):
                used = np.flatnonzero(q[:, d])
                if len(used) == len(q):
                    scores += q[:, d, None] * columns[d]
                elif len(used):
                    scores[used] += q[used, d, None] * columns[d]
            for i in range(len(q)):
                own = np.searchsorted(c_ids, [q_ids[at + i], q_ids[at + i] + 1])
                row, ids = scores[i], c_ids
                if own[0] < own[1]:
                    row, ids = np.delete(row, np.s_[own[0] : own[1]]), np.delete(ids, np.s_[own[0] : own[1]])
                best = _best(row, k)
                out.append((np.full(len(best), at + i), ids[best], _fitted(row[best])))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                c_ids, q_ids = np.frombuffer(x["c_ids"], np.int64), np.frombuffer(x["q_ids"], np.int64)
                c_rows, q_rows = (
                    np.frombuffer(x[f"{b}_rows"], np.float64 if x[f"{b}_wide"] else np.int32).reshape(-1, x[f"{b}_dims"]) if x[f"{b}_dims"]
                    else np.zeros((len(ids), 0), np.int32)
                    for b, ids in (("c", c_ids), ("q", q_ids))
                )
                at, ids, scores = one(c_ids, c_rows, q_ids, q_rows)
                yield pa.RecordBatch.from_pydict(
                    {"q": np.full(len(at), x["q"]), "at": at, "query_id": q_ids[at], "vec_id": ids, "score": scores}
                )

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for every row of ``queries``.

    Rows with the query's id are its own and never returned; ties go to the smaller id; where fewer
    candidates exist, all are returned. A repeated query row gets its result again, a repeated
    candidate row counts as two. Vectors of other lengths count as filled with zeros. What takes no
    part is said in ``quantized``. Scores are exact; one that leaves 64 bits counts as the nearest 64-bit
    number. Empty tables give no rows.
    """
    c = _packed(quantized(vectors, id_col, vector_col, scale), CANDIDATES, "c")
    q = _packed(quantized(queries, id_col, vector_col, scale), QUERIES, "q")
    last = q.agg(F.max("q")).first()[0]
    # The grid holds block numbers only.
    every = F.sequence(F.lit(0).cast("long"), F.lit(-1 if last is None else last).cast("long"), F.lit(1).cast("long"))
    grid = c.select("c", F.explode(every if last is not None else F.array().cast("array<long>")).alias("q"))
    cells = grid.join(c, "c").join(q, "q").repartition("c", "q")
    found = cells.mapInArrow(_cell(k), "q long, at long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
