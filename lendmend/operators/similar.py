"""Exact top-k cosine neighbours without comparing every pair as rows.

On unit vectors cosine similarity and Euclidean distance order alike, so the triangle
inequality can rule out whole cells. Candidates sit in cells around pivots. A query first
searches the cell it falls into, which bounds the distance of its k-th neighbour, and then
only the cells that can hold something closer. Both sides are packed once into blocks of
bounded size, each the rows of one cell, so a cell with a third of all vectors is many blocks.
Pairs of blocks are read from those copies by a product of partitions and never shuffled: a task
meets a set of query blocks with a set of candidate blocks, holds one block of each as matrices,
and emits at most k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmend.functions.vectors import cosine, unit
from lendmend.operators.keyed import top_per_key

MAX_PIVOTS = 1024
PIVOT_SAMPLE = 50_000
SLACK = 1e-7  # of distances: the root of a rounding error near zero
ROUNDING = 1e-12  # of similarities
BLOCK_BYTES = 8 << 20
HELD_BYTES = 64 << 20  # candidates that a task holds to meet its queries
TILE = (256, 2048)  # queries and candidates of one matrix product


def _salt(col: str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n) if isinstance(n, int) else n).cast("int")


def _pivots(cand: DataFrame, n_rows: int, cell_rows: int, seed: int) -> np.ndarray:
    """Pivot vectors. Their choice affects speed only."""
    n = min(MAX_PIVOTS, max(1, math.ceil(n_rows / cell_rows)))
    if n == 1:
        return np.zeros((1, 1))  # there is one cell
    part = cand.sample(min(1.0, PIVOT_SAMPLE / n_rows), seed=seed)
    model = KMeans(k=n, seed=seed, maxIter=5).fit(part.select(array_to_vector(unit("_raw")).alias("features")))
    return np.array(model.clusterCenters(), dtype=float)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zeros stay."""
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(size == 0, 1.0, size)[:, None]


def _unit_rows(raw: pd.Series) -> np.ndarray:
    return _units(np.vstack(raw.to_numpy()).astype(float))


def _to_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""

    @F.pandas_udf("cell int, dist double")
    def nearest(raw: pd.Series) -> pd.DataFrame:
        x = _unit_rows(raw)
        gap = (x * x).sum(1)[:, None] - 2.0 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
        cell = gap.argmin(1)
        dist = np.linalg.norm(x - pivots[cell], axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "dist": dist})

    return df.withColumn("_c", nearest("_raw")).select(
        "*", F.col("_c.cell").alias("_cell"), F.col("_c.dist").alias("_dist")
    ).drop("_c")


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _raw): the vectors in their own type. Rows without one, or with a number that is null or not
    finite, have no similarity and are left out."""
    kind = df.schema[vec_col].dataType.simpleString()
    raw = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    finite = F.forall("_raw", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # nan is above
    return df.select(F.col(id_col).alias("_id"), raw.alias("_raw")).where(finite)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _packing(most: int):
    """Rows that follow each other and are of one cell and block -> one row for at most ``most`` of them, by id."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("_id", "ascending")], null_placement="at_start")).combine_chunks()
        ids, raw, kth, masks = (rows.column(c).combine_chunks() for c in ("_id", "_raw", "_kth", "_mask"))
        cell = rows.column("_cell")[0].as_py()
        asked, mask = [cell], None
        if masks.null_count == 0:
            mask = b"".join(masks.to_pylist())
            bits = np.bitwise_or.reduce(np.frombuffer(mask, np.uint8).reshape(len(ids), -1), axis=0)
            asked = np.flatnonzero(np.unpackbits(bits)).tolist()
        kth = None if kth.null_count == len(kth) else pc.fill_null(kth, -np.inf).to_numpy().tobytes()
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
        cells = [cell, _numbers(raw.flatten()).tobytes(), kth, mask, asked]
        cells = [pa.array([x], t) for x, t in zip(cells, kinds, strict=True)]
        cells.insert(1, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
        return pa.RecordBatch.from_arrays(cells, ["cell", "ids", "vecs", "kth", "mask", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, key = [], 0, None
        for batch in batches:
            keys = np.stack([_numbers(batch.column(c)) for c in ("_cell", "_block")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    own = tuple(keys[:, lo].tolist())
                    if n and (own != key or n == most):
                        yield packed(held)
                        held, n = [], 0
                    part = batch.slice(lo, min(hi - lo, most - n))
                    held, n, key, lo = [*held, part], n + part.num_rows, own, lo + part.num_rows
        if n:
            yield packed(held)

    return run


def _packed(rows: DataFrame, most: int, label: str) -> DataFrame:
    """Blocks of at most ``most`` rows, written, each in a file of its own."""
    from lendmend.sources.zones import written

    for c, kind in (("_kth", "double"), ("_mask", "binary")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    rows = rows.select("_id", "_raw", "_cell", "_block", "_kth", "_mask")
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"cell int, ids array<{kind}>, vecs binary, kth binary, mask binary, asked array<int>"
    return written(rows.mapInArrow(_packing(most), schema), label, maxRecordsPerFile="1")


def _by_cell(rows: DataFrame, most: int, label: str) -> DataFrame:
    """The same of rows with ``_cell`` and ``_block``, which are brought together first. Blocks were dealt by a
    hash, so they vary in size."""
    return _packed(rows.repartition("_cell", "_block").sortWithinPartitions("_cell", "_block"), 2 * most, label)


class _Top:
    """The best k of the candidates met so far, for each query of a block."""

    def __init__(self, ids: pa.Array, vecs: np.ndarray, kth: np.ndarray | None, k: int):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.floor = np.full(len(ids), -np.inf) if kth is None else kth
        self.row, self.sim, self.who = np.zeros(0, np.int64), np.zeros(0), ids.slice(0, 0)

    def meet(self, ids: pa.Array, vecs: np.ndarray, of: np.ndarray) -> None:
        """Compares the queries ``of`` with a block of candidates, which is sorted by id."""
        own, other = self._same(ids)
        rows, cols = [], []
        for a in range(0, len(of), TILE[0]):
            part = of[a : a + TILE[0]]
            floor, place = self.floor[part], np.full(len(self.ids), -1)
            place[part] = np.arange(len(part))
            for b in range(0, len(ids), TILE[1]):
                sim = self.vecs[part] @ vecs[b : b + TILE[1]].T
                mine = (place[own] >= 0) & (other >= b) & (other < b + TILE[1])
                sim[place[own[mine]], other[mine] - b] = -np.inf
                row, col, floor = self._kept(sim, floor)
                rows.append(part[row])
                cols.append(col + b)
        row, col = np.concatenate(rows), np.concatenate(cols)
        if not len(row):
            return
        sim = np.empty(len(row))  # in the same way for every pair, so that equal vectors tie
        for a in range(0, len(row), 1 << 16):
            sim[a : a + (1 << 16)] = np.einsum("ij,ij->i", self.vecs[row[a : a + (1 << 16)]], vecs[col[a : a + (1 << 16)]])
        row, sim = np.concatenate([self.row, row]), np.concatenate([self.sim, sim])
        who = pa.concat_arrays([self.who, ids.take(pa.array(col))])
        rank = pc.rank(who, null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, -sim, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        order, row = order[nth < self.k], row[nth < self.k]
        self.row, self.sim, self.who = row, sim[order], who.take(pa.array(order))
        full = nth[nth < self.k] == self.k - 1
        self.floor[row[full]] = np.maximum(self.floor[row[full]], self.sim[full])

    def _same(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) places with the same id; a null id is no other's."""
        codes = pc.fill_null(pa.concat_arrays([self.ids, ids]).dictionary_encode().indices, -1).to_numpy()
        asked, held = codes[: len(self.ids)], codes[len(self.ids) :]
        order = np.argsort(held, kind="stable")
        lo, hi = (np.searchsorted(held[order], asked, side) for side in ("left", "right"))
        n = np.where(asked < 0, 0, hi - lo)
        own = np.repeat(np.arange(len(asked)), n)
        return own, order[np.repeat(lo, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]

    def _kept(self, sim: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a tile that may be among the best k, and what the next tiles are held against."""
        take = min(self.k, sim.shape[1])
        open_ = np.flatnonzero(np.isneginf(floor)) if take == self.k else np.zeros(0, np.int64)
        if len(open_):
            floor = floor.copy()
            floor[open_] = np.nan_to_num(-np.partition(-sim[open_], take - 1, axis=1)[:, take - 1], nan=-np.inf, neginf=-np.inf)
        keep = sim >= floor[:, None] - ROUNDING
        if np.count_nonzero(keep) > 8 * self.k * len(sim):
            # Many alike: those above the k-th, and of its equals the first by id.
            kth = np.nan_to_num(-np.partition(-sim, take - 1, axis=1)[:, take - 1], nan=-np.inf, neginf=-np.inf)[:, None]
            above = keep & (sim > kth + ROUNDING)
            equal = keep & ~above & (sim >= kth - ROUNDING)
            keep = above | (equal & (equal.cumsum(axis=1) <= self.k - above.sum(axis=1)[:, None]))
        at = np.flatnonzero(keep.ravel())  # far quicker than by rows and columns
        at = at[sim.ravel()[at] > -np.inf]
        return *np.divmod(at, sim.shape[1]), floor

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.row)), self.who, pa.array(self.sim)], ["_qid", "_cid", "_sim"])


def _searching(k: int, items: dict[str, str]):
    """Block pairs, in the order of the query blocks -> the best of the candidates for each query."""

    def matrix(batch: pa.RecordBatch, side: str) -> tuple[pa.Array, np.ndarray]:
        ids = batch.column(f"{side}ids")[0].values
        raw = np.frombuffer(batch.column(f"{side}vecs")[0].as_buffer(), items[side])
        return ids, _units(raw.reshape(len(ids), -1).astype(float))

    def bytes_of(batch: pa.RecordBatch, c: str) -> np.ndarray | None:
        cell = batch.column(c)[0]
        return np.frombuffer(cell.as_buffer(), np.uint8) if cell.is_valid else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = key = mask = None
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            if (own := batch.column("q_key")[0].as_py()) != key:
                if top is not None:
                    yield top.result()
                kth, mask, key = bytes_of(batch, "q_kth"), bytes_of(batch, "q_mask"), own
                top = _Top(*matrix(batch, "q_"), None if kth is None else kth.view(float).copy(), k)
                mask = None if mask is None else mask.reshape(len(top.ids), -1)
            cell = batch.column("c_cell")[0].as_py()
            of = np.arange(len(top.ids)) if mask is None else np.flatnonzero(mask[:, cell >> 3] >> (7 - (cell & 7)) & 1)
            top.meet(*matrix(batch, "c_"), of)
        if top is not None:
            yield top.result()

    return run


def _item(df: DataFrame, vec_col: str) -> str:
    return "float32" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "float64"


def _block_rows(n: int, dim: int, most: int, spark: SparkSession) -> int:
    """Rows of a block: so few that small tables are work for all cores as well."""
    most = max(1, min(most, BLOCK_BYTES // (8 * max(1, dim))))
    return min(most, max(1024, math.ceil(n / (2 * spark.sparkContext.defaultParallelism))))


def _salted(rows: DataFrame, counts: dict[int, int], most: int) -> DataFrame:
    """``_block``: rows of a cell in parts of about ``most``."""
    parts = F.array(*[F.lit(max(1, math.ceil(counts.get(i, 0) / most))) for i in range(max(counts, default=0) + 1)])
    return rows.withColumn("_block", _salt("_id", F.get(parts, F.col("_cell"))))


def _cell_counts(rows: DataFrame) -> dict[int, int]:
    return {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pivot


def _search(queries: DataFrame, cand: DataFrame, k: int, items: tuple[str, str], held: int) -> DataFrame:
    """(_qid, _cid, _sim): the best k of every query in the cells that its block asks, from each part of the candidates.

    A task holds ``held`` bytes of candidate blocks and meets its query blocks with them one by one. The result
    has to be written with ``_one_row_batches``: a row is a pair of blocks.
    """
    spark = queries.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    q_blocks, c_blocks = queries.count(), cand.count()
    parts = max(1, math.ceil(held / HELD_BYTES), min(c_blocks, math.ceil(tasks / max(1, q_blocks))))
    q = queries.select(F.monotonically_increasing_id().alias("q_key"), *[F.col(c).alias(f"q_{c}") for c in queries.columns])
    c = cand.coalesce(parts).select(*[F.col(c).alias(f"c_{c}") for c in ("cell", "ids", "vecs")])
    pairs = q.join(c.hint("shuffle_replicate_nl"), F.array_contains("q_asked", F.col("c_cell")))
    q_id, c_id = (df.schema["ids"].dataType.elementType.simpleString() for df in (queries, cand))
    return pairs.drop("q_asked", "q_cell").mapInArrow(_searching(k, dict(zip(("q_", "c_"), items))), f"_qid {q_id}, _cid {c_id}, _sim double")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_per_key(found, ["_qid"], [F.col("_sim").desc(), F.col("_cid")], k)


def _one_row_batches(spark: SparkSession):
    from lendmend.sources.zones import _setting

    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1")


def similar(
    queries: DataFrame,
    candidates: DataFrame,
    vec_col: str,
    k: int,
    id_col: str = "customer_id",
    block_rows: int = 16_384,
    cell_rows: int = 65_536,
    seed: int = 7,
) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar candidates of every query; a written table.

    Exact; ties go to the smaller id, and a query is no neighbour of itself. Rows without a vector, or with a
    null number in it, are left out.
    """
    from lendmend.sources.zones import discard, shuffles_freed, written

    spark = queries.sparkSession
    items = _item(queries, vec_col), _item(candidates, vec_col)
    c = _vectors(candidates, id_col, vec_col)
    q = c if queries is candidates else _vectors(queries, id_col, vec_col)
    n_c, dim = c.agg(F.count(F.lit(1)), F.max(F.size("_raw"))).first()
    n_q = n_c if q is c else q.count()
    if n_c == 0 or n_q == 0:
        none = queries.limit(0).select(F.col(id_col).alias("_qid"), F.col(id_col).alias("_cid"))
        return _named(none.withColumn("_sim", F.lit(0.0)), id_col)
    held = n_c * dim * np.dtype(items[1]).itemsize
    most_q, most_c = (_block_rows(n, dim, block_rows, spark) for n in (n_q, n_c))
    pivots = _pivots(c, n_c, cell_rows, seed)
    with shuffles_freed(spark):
        if len(pivots) == 1:
            whole = {"_cell": F.lit(0), "_block": F.lit(0)}
            packed = _packed(c.withColumns(whole), most_c, "similar-candidates")
            asking = packed if q is c else _packed(q.withColumns(whole), most_q, "similar-queries")
            with _one_row_batches(spark):
                found = written(_named(_best(_search(asking, packed, k, items, held), k), id_col), "similar")
            discard(packed, asking)
            return found

        celled = _to_cells(c, pivots)
        # One row per pivot, at most MAX_PIVOTS.
        stats = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_dist").alias("radius")).collect()
        packed = _by_cell(_salted(celled, {r["_cell"]: r["n"] for r in stats}, most_c), most_c, "similar-candidates")
        if q is c:
            q_counts, asking = {r["_cell"]: r["n"] for r in stats}, packed
        else:
            q_counts = _cell_counts(_to_cells(q, pivots))
            asking = _by_cell(_salted(_to_cells(q, pivots), q_counts, most_q), most_q, "similar-queries")
        with _one_row_batches(spark):
            first = written(_best(_search(asking, packed, k, items, held), k), "similar-first")
        if q is not c:
            discard(asking)
        bound = first.groupBy("_qid").agg(F.when(F.count(F.lit(1)) == k, F.min("_sim")).alias("_kth"))
        radius = {r["_cell"]: r["radius"] for r in stats}
        live = np.array(sorted(radius))
        centre, reach = pivots[live], np.array([radius[i] for i in live])

        @F.pandas_udf("binary")
        def can_hold_closer(raw: pd.Series, kth: pd.Series, own: pd.Series) -> pd.Series:
            x = _unit_rows(raw)
            sq = (x * x).sum(1)[:, None] - 2.0 * x @ centre.T + (centre * centre).sum(1)[None, :]
            nearest = np.maximum(0.0, np.sqrt(np.maximum(sq, 0.0)) - reach[None, :])
            worst = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * kth.fillna(-1.0).to_numpy(float)))
            ok = nearest <= worst[:, None] + SLACK
            # A zero vector has no direction: its bound does not hold, so it visits every cell.
            ok |= ((x * x).sum(1) == 0)[:, None]
            ok &= live[None, :] != own.to_numpy()[:, None]
            return _masks(ok, live, len(pivots))

        more = _salted(_to_cells(q, pivots), q_counts, most_q).join(bound, F.col("_id") == F.col("_qid"), "left")
        more = more.withColumn("_mask", can_hold_closer("_raw", "_kth", "_cell")).where(F.col("_mask").isNotNull())
        more = _by_cell(more, most_q, "similar-more")
        with _one_row_batches(spark):
            found = first.unionByName(_search(more, packed, k, items, held))
            found = written(_named(_best(found, k), id_col), "similar")
        discard(packed, first, more)
        return found


def _masks(ok: np.ndarray, cells: np.ndarray, n: int) -> pd.Series:
    """Rows of marked cells as bits, one for each of ``n`` cells; none for a row without a mark."""
    bits = np.zeros((len(ok), n), bool)
    bits[:, cells] = ok
    return pd.Series([row.tobytes() if some else None for row, some in zip(np.packbits(bits, axis=1), ok.any(axis=1))], dtype=object)


def similar_probed(
    queries: DataFrame,
    candidates: DataFrame,
    vec_col: str,
    k: int,
    id_col: str = "customer_id",
    probes: int = 8,
    block_rows: int = 16_384,
    cell_rows: int = 65_536,
    seed: int = 7,
) -> DataFrame:
    """As ``similar``, but a query looks into its ``probes`` nearest cells only.

    What is found is exact: ranked by true similarity, ties to the smaller id. What lies in no cell
    that was looked into is missed, so the recall depends on the data: vectors in clusters keep nearly
    all neighbours, vectors spread evenly in many dimensions lose them unless most cells are probed.
    ``probed_share`` tells how many pairs that compares. As many probes as cells give ``similar``.

    Queries are packed by their nearest cell, once, with the cells that each looks into.
    """
    from lendmend.sources.zones import discard, shuffles_freed, written

    spark = queries.sparkSession
    items = _item(queries, vec_col), _item(candidates, vec_col)
    c, q = (_vectors(df, id_col, vec_col) for df in (candidates, queries))
    n_c, dim = c.agg(F.count(F.lit(1)), F.max(F.size("_raw"))).first()
    pivots = _pivots(c, n_c, cell_rows, seed) if n_c else np.zeros((1, 1))
    if len(pivots) == 1:
        return similar(queries, candidates, vec_col, k, id_col, block_rows, cell_rows, seed)
    nearest = _probes(pivots, probes)

    @F.pandas_udf("binary")
    def asked(raw: pd.Series) -> pd.Series:
        ok = np.zeros((len(raw), len(pivots)), bool)
        ok[np.arange(len(raw))[:, None], nearest(raw)] = True
        return _masks(ok, np.arange(len(pivots)), len(pivots))

    with shuffles_freed(spark):
        c, q = _to_cells(c, pivots), _to_cells(q, pivots).withColumn("_mask", asked("_raw"))
        counts, q_counts = _cell_counts(c), _cell_counts(q)
        most_q, most_c = (_block_rows(n, dim, block_rows, spark) for n in (sum(q_counts.values()), n_c))
        packed = _by_cell(_salted(c, counts, most_c), most_c, "probed-candidates")
        asking = _by_cell(_salted(q, q_counts, most_q), most_q, "probes")
        with _one_row_batches(spark):
            held = n_c * dim * np.dtype(items[1]).itemsize
            found = written(_named(_best(_search(asking, packed, k, items, held), k), id_col), "probed")
        discard(packed, asking)
    return found


def probed_share(
    queries: DataFrame, candidates: DataFrame, vec_col: str, id_col: str = "customer_id", probes: int = 8,
    cell_rows: int = 65_536, seed: int = 7,
) -> float:
    """Share of all pairs that ``similar_probed`` with the same numbers compares."""
    c, q = (_vectors(df, id_col, vec_col) for df in (candidates, queries))
    n = c.count()
    pivots = _pivots(c, n, cell_rows, seed) if n else np.zeros((1, 1))
    if len(pivots) == 1:
        return 1.0
    nearest = _probes(pivots, probes)

    @F.pandas_udf("array<int>")
    def cells(raw: pd.Series) -> pd.Series:
        return pd.Series(list(nearest(raw)))

    sizes = _cell_counts(_to_cells(c, pivots))
    visits = _cell_counts(q.select(F.explode(cells("_raw")).alias("_cell")))
    return sum(sizes.get(i, 0) * v for i, v in visits.items()) / max(1, q.count() * n)


def _probes(pivots: np.ndarray, probes: int):
    """Vectors -> their nearest cells."""
    squares = (pivots * pivots).sum(1)

    def nearest(raw: pd.Series) -> np.ndarray:
        gap = squares[None, :] - 2.0 * _unit_rows(raw) @ pivots.T
        return np.argsort(gap, axis=1, kind="stable")[:, :probes].astype("int32")

    return nearest


def _named(best: DataFrame, id_col: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("_qid").orderBy(F.col("_sim").desc(), "_cid")  # <= k rows per query
    return best.select(
        F.col("_qid").alias(id_col),
        F.col("_cid").alias("neighbour"),
        F.col("_sim").alias("similarity"),
        F.row_number().over(w).alias("rank"),
    )


def top_k_similar(pairs: DataFrame, k: int, id_col: str = "customer_id") -> DataFrame:
    """The k best of given (id, neighbour, similarity) rows; ties by neighbour id."""
    best = pairs.select(
        F.col(id_col).alias("_qid"), F.col("neighbour").alias("_cid"),
        F.col("similarity").alias("_sim"),
    )
    return _named(_best(best, k), id_col)


def near_centroid(df: DataFrame, good: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """Similarity of every row to the mean vector of ``good`` (one row of ``dim`` numbers)."""
    centre = good.agg(*[F.avg(F.get(vec_col, i)).alias(str(i)) for i in range(dim)]).first()
    if centre is None or centre[0] is None:
        return df.withColumn("similarity", F.lit(None).cast("double"))
    lit = F.array(*[F.lit(float(v)) for v in centre])
    return df.withColumn("similarity", cosine(F.col(vec_col), lit))
