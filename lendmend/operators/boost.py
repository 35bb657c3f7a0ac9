"""Second-order boosted trees that learn where missing values go.

A missing value is not filled. Features are cut into bins of about equal counts, and missing has a bin
of its own. Each level of a tree is one grouped aggregate: tasks add up gradients and second
derivatives by (node, feature, bin), Spark adds the sums, and every cut is tried with the missing rows
on its left and on its right. Sums are whole numbers, so the same rows and bins give the same trees
however the rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 1 << 24  # gradients are summed as multiples of 1 / UNIT
PATIENCE = 5  # rounds without a better loss
REFRESH = 20  # rounds between written copies of the margins, as each pass goes through the trees since the last
MANY_ROWS = 200_000  # from so many on a copy each round costs less than its trees in every pass
BLOCK = ["bins", "y", "w", "valid", "margin"]  # what a block holds of its rows
FEATURE, THRESHOLD, CUT, MISSING_LEFT, VALUE = range(5)  # columns of a tree's node table


def _cells(features: list[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of one width as rows; null becomes nan."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _descend(tree: np.ndarray, n: int, left_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Node in which each of ``n`` rows ends. Children of node i are 2i + 1 and 2i + 2."""
    at = np.zeros(n, np.int64)
    for _ in range((len(tree) + 1).bit_length() - 2):
        feature = tree[at, FEATURE].astype(int)
        if not (feature >= 0).any():
            break
        at = np.where(feature >= 0, 2 * at + np.where(left_of(at, feature), 1, 2), at)
    return at


def leaves(tree: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Node in which each row of numbers ends; nan is missing."""
    rows = np.arange(len(cells))

    def left_of(at, feature):
        x = cells[rows, feature]
        return np.where(np.isnan(x), tree[at, MISSING_LEFT] > 0, x <= tree[at, THRESHOLD])

    return _descend(tree, len(cells), left_of)


def _binned_leaves(tree: np.ndarray, bins: np.ndarray, missing: int) -> np.ndarray:
    rows = np.arange(len(bins))

    def left_of(at, feature):
        b = bins[rows, feature]
        return np.where(b == missing, tree[at, MISSING_LEFT] > 0, b <= tree[at, CUT])

    return _descend(tree, len(bins), left_of)


@dataclass
class BoostedTrees:
    """A fitted ensemble. ``loss`` is logistic (classes 0 and 1) or squared (a number)."""

    features: list[str]
    loss: str
    base: float
    spread: float  # margins are in units of this
    trees: list[np.ndarray] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)
    valid_loss: list[float] = field(default_factory=list)  # after each round, where rows were held out

    def margins(self, cells: np.ndarray) -> np.ndarray:
        out = np.full(len(cells), self.base)
        for tree in self.trees:
            out += tree[leaves(tree, cells), VALUE]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``margin`` and ``p`` to classified rows, ``prediction`` to rows of a number."""

        @F.pandas_udf("double")
        def margin(cells: pd.Series) -> pd.Series:
            return pd.Series(self.margins(np.vstack(cells.to_numpy()).astype(float)) if len(cells) else [], dtype=float)

        scored = margin(_cells(self.features))
        if self.loss == "squared":
            return df.withColumn("prediction", scored * F.lit(self.spread))
        return df.withColumn("margin", scored).withColumn("p", 1 / (1 + F.exp(-F.col("margin"))))

    def importance(self, spark) -> DataFrame:
        """(feature, gain), shares of the loss that its cuts have saved."""
        total = sum(self.gains.values()) or 1.0
        return spark.createDataFrame([(f, self.gains.get(f, 0.0) / total) for f in self.features], "feature string, gain double")


def bin_edges(train: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most ``bins - 1`` upper ends for each feature, at about equal counts of its known values."""
    known = train.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features])
    shares = [i / bins for i in range(1, bins)]
    return [sorted(set(q)) for q in known.approxQuantile(features, shares, 0.1 / bins)]


def _binned(train: DataFrame, features: list[str], edges: list[list[float]], missing: int) -> DataFrame:
    """Blocks of rows (cells, y, w, valid): one row with the bytes of the bins, y, w, valid and the margin of
    each batch. Every pass reads all rows, and as rows of a table they cost the JVM more than the sums do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _matrix(batch.column(0), len(features))
            bins = np.empty(cells.shape, np.uint8)
            for j, ends in enumerate(edges):
                bins[:, j] = np.searchsorted(ends, cells[:, j], side="left")
            bins[np.isnan(cells)] = missing
            if len(bins):
                rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4)]
                yield _block([x.tobytes() for x in (bins, *rows, np.zeros(len(bins)))])

    return train.mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK))


def _block(parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [batch.column(c)[i].as_py() for c in BLOCK]


def _rows(block: list[bytes], width: int, trees: list[np.ndarray], missing: int):
    bins = np.frombuffer(block[0], np.uint8).reshape(-1, width)
    y, w, valid, margin = (np.frombuffer(x, kind) for x, kind in zip(block[1:], (float, float, bool, float), strict=True))
    margin = margin.copy()
    for tree in trees:
        margin += tree[_binned_leaves(tree, bins, missing), VALUE]
    return bins, y, w, valid, margin


def _few_blocks(spark: SparkSession):
    """Blocks are handed to Python a few at once."""
    from lendmend.sources.zones import _setting

    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "64")


def _derivatives(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, second derivative, loss) of each row."""
    if loss == "squared":
        return margin - y, np.ones(len(y)), 0.5 * (margin - y) ** 2
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p), np.logaddexp(0, margin) - y * margin


def _sums(
    rows: DataFrame, width: int, trees: list[np.ndarray], tree: np.ndarray, level: range, loss: str, base: float, missing: int
) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Gradients and second derivatives by (node of the level, feature, bin), and the mean loss of held-out rows.

    One pass and one grouped aggregate. What comes to the driver is nodes x features x bins numbers.
    """
    nodes, bins_n = len(level), missing + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, nodes * width * bins_n), np.int64)
        held = [0, 0]
        for block in _blocks(batches):
            bins, y, w, valid, margin = _rows(block, width, trees, missing)
            g, h, lost = _derivatives(loss, y, base + margin)
            if valid.any():
                held[0] += int(np.rint((w * lost)[valid] * UNIT).sum())
                held[1] += int(np.rint(w[valid] * UNIT).sum())
            at = _binned_leaves(tree, bins, missing) - level.start
            mine = np.flatnonzero(~valid & (at >= 0))
            at, bins = at[mine], bins[mine].astype(np.int64)
            parts = [np.rint(w[mine] * x[mine] * UNIT).astype(np.int64) for x in (g, h)]
            for j in range(width):
                place = (at * width + j) * bins_n + bins[:, j]
                for k in range(2):  # whole numbers below 2^53 within a batch
                    total[k] += np.bincount(place, parts[k], len(total[k])).astype(np.int64)
        used = np.flatnonzero(total.any(0))
        columns = [np.r_[used, -1], np.r_[total[0][used], held[0]], np.r_[total[1][used], held[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "g", "h"])

    with _few_blocks(rows.sparkSession):
        found = rows.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, nodes * width * bins_n))
    cell, sum_g, sum_h = (found[c].to_numpy() for c in ("cell", "g", "h"))
    mine, held = cell >= 0, cell < 0
    out[0, cell[mine]], out[1, cell[mine]] = sum_g[mine] / UNIT, sum_h[mine] / UNIT
    mean = float(sum_g[held][0] / sum_h[held][0]) if held.any() and sum_h[held][0] else None
    shape = (nodes, width, bins_n)
    return out[0].reshape(shape), out[1].reshape(shape), mean


def best_cut(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing to the left) of sums by (feature, bin); the last bin is missing.

    Bins up to the cut go left. Both sides keep a second derivative of ``least`` at the least. Of equal
    gains the first feature and the lowest cut win, with missing rows on the right; where a feature
    has no missing rows, later ones follow the heavier side.
    """
    all_g, all_h = g[0].sum(), h[0].sum()
    left_g, left_h = np.cumsum(g[:, :-1], 1), np.cumsum(h[:, :-1], 1)
    left_g = np.stack([left_g, left_g + g[:, -1:]], 2)
    left_h = np.stack([left_h, left_h + h[:, -1:]], 2)
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + reg) + right_g**2 / (right_h + reg) - all_g**2 / (all_h + reg)
    gain[(left_h < least) | (right_h < least)] = -np.inf
    at = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[at] > 1e-9:
        return None
    feature, cut, side = map(int, at)
    if h[feature, -1] == 0:
        side = int(left_h[at] > right_h[at])
    return float(gain[at]), feature, cut, bool(side)


def fit_boosted(
    train: DataFrame,
    features: list[str],
    label: str,
    loss: str = "logistic",
    depth: int = 6,
    rate: float = 0.1,
    rounds: int = 200,
    reg: float = 1.0,
    least: float = 1.0,
    bins: int = 64,
    weight_col: str | None = None,
    valid_flag: str | None = None,
    tolerance: float = 0.001,
    edges: list[list[float]] | None = None,
) -> BoostedTrees:
    """Boosted trees on features with missing values (null or nan), at most 255 bins each.

    ``reg`` is added to each leaf's second derivative, ``least`` is what either side of a cut must
    have. With ``valid_flag`` (a boolean column) the flagged rows are held out, and boosting stops
    after ``PATIENCE`` rounds that improve their loss by less than ``tolerance`` of it; the trees after the
    best round go. Rows without a label are left out. ``edges`` are the bins' upper ends, by default
    those of ``bin_edges``. A level is one pass over the binned table.
    """
    from lendmend.sources.zones import discard, written

    if loss not in ("logistic", "squared") or not 2 <= bins <= 255:
        raise ValueError("loss is logistic or squared, bins from 2 to 255")
    width, missing = len(features), bins
    weight = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    valid = F.lit(False) if valid_flag is None else F.coalesce(F.col(valid_flag), F.lit(False))
    y = F.col(label).cast("double")
    given = train.where(y.isNotNull() & ~F.isnan(y)).select(_cells(features).alias("cells"), y.alias("y"), weight.alias("w"), valid.alias("valid"))
    own = F.when(~F.col("valid"), F.col("w"))
    all_w, mean, square, n = given.agg(F.sum(own), F.try_divide(F.sum(own * F.col("y")), F.sum(own)), F.try_divide(F.sum(own * F.col("y") ** 2), F.sum(own)), F.count(F.lit(1))).first()
    refresh = REFRESH if n < MANY_ROWS else 1
    if not all_w:
        raise ValueError("no rows to fit on")
    if loss == "squared":
        spread = math.sqrt(max(square - mean * mean, 0.0)) or 1.0
        base, given = mean / spread, given.withColumn("y", F.col("y") / F.lit(spread))
    else:
        share = min(max(mean, 1e-6), 1 - 1e-6)
        spread, base = 1.0, math.log(share / (1 - share))
    edges = edges or bin_edges(train.where(y.isNotNull()), features, bins)
    rows = written(_binned(given, features, edges, missing), "binned")
    model = BoostedTrees(features, loss, base, spread)
    fresh: list[np.ndarray] = []  # trees that the written margins lack
    best, stale, losses = math.inf, 0, []
    while True:
        tree = np.zeros((2 ** (depth + 1) - 1, 5))
        tree[:, FEATURE] = -1
        sums = lambda level: _sums(rows, width, fresh, tree, level, loss, base, missing)  # noqa: B023, E731
        g, h, held = sums(range(1))
        if held is not None and model.trees:
            losses.append(held)
            stale = 0 if held < best * (1 - tolerance) else stale + 1
            best = min(best, held)
        if stale >= PATIENCE or len(model.trees) == rounds:
            break
        for d in range(depth):
            level = range(2**d - 1, 2 ** (d + 1) - 1)
            if d:
                g, h, _ = sums(level)
            if not _cut_level(model, tree, level, g, h, edges, rate, reg, least):
                break
        if tree[0, FEATURE] < 0:
            break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == refresh:
            with _few_blocks(rows.sparkSession):
                rows, old = written(_advanced(rows, width, fresh, missing), "binned"), rows
            discard(old)
            fresh = []
    discard(rows)
    model.valid_loss = losses
    if losses:
        model.trees = model.trees[: int(np.argmin(losses)) + 1]
    return model


def _cut_level(
    model: BoostedTrees, tree: np.ndarray, level: range, g: np.ndarray, h: np.ndarray, edges: list[list[float]], rate: float, reg: float, least: float
) -> bool:
    """Cuts the nodes of a level where that gains; whether any was cut."""
    any_cut = False
    for k, node in enumerate(level):
        if h[k, 0].sum() <= 0 or (found := best_cut(g[k], h[k], reg, least)) is None:
            continue
        gain, feature, cut, to_left = found
        threshold = edges[feature][cut] if cut < len(edges[feature]) else math.inf  # else all known values go left
        tree[node, :VALUE] = feature, threshold, cut, to_left
        name = model.features[feature]
        model.gains[name] = model.gains.get(name, 0.0) + gain
        left = [x[k, feature, : cut + 1].sum() + to_left * x[k, feature, -1] for x in (g, h)]
        right = [x[k, feature].sum() - y for x, y in zip((g, h), left, strict=True)]
        for child, (cg, ch) in ((2 * node + 1, left), (2 * node + 2, right)):
            tree[child, VALUE] = -rate * cg / (ch + reg)
        any_cut = True
    return any_cut


def _advanced(rows: DataFrame, width: int, trees: list[np.ndarray], missing: int) -> DataFrame:
    """The rows with the margins of some more trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _block([*block[:4], _rows(block, width, trees, missing)[4].tobytes()])

    return rows.mapInArrow(run, rows.schema)
