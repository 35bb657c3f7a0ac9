"""Quality classifier by co-training.

Two views of a document get a classifier each: its text content (words, and shares of character
and word kinds) and its page metadata (source, language, length). Over a few rounds each scores all
unlabelled documents, and those it is sure of become training rows of the other. The two scores are
calibrated on held-out labelled rows and combined; documents whose combined probability of being
bad reaches a threshold calibrated on the same rows are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import numbered, written

SAMPLE = 10_000  # labelled documents that the classifiers are fitted on, drawn by hash
ROUNDS = 2
PER_ROUND = 500  # pseudo-labels of each class that a view hands over in a round
SURE = 0.95  # least calibrated probability of a pseudo-label
LEAST_DOCS = 5  # training documents that must hold a feature
ASSOCIATION = 4.0  # standard deviations by which a text feature's rate of bad documents must differ
SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Steps of the shares: each share becomes the feature of the step it lies in.
STEPS = np.array([0, 0.003, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7, 0.85])
DIGITS, UPPER = b"0123456789", bytes(range(65, 91))
MARKS = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b".,'"))


def _feature(name: str) -> int:
    return xxhash.xxh64_intdigest(name, 1) >> 1


def text_features(data: bytes | None) -> np.ndarray:
    """Hashes of the distinct words, and of the steps of a text's shares."""
    data = data or b""
    words = data.translate(SEPARATORS).split()
    distinct = set(words)
    shares = {"none": float(not words)}
    if words:
        size = len(data)
        tokens = data.split()
        shares |= {
            "marks": (size - len(data.translate(None, MARKS))) / size,
            "upper": (size - len(data.translate(None, UPPER))) / size,
            "digits": (size - len(data.translate(None, DIGITS))) / size,
            "distinct": len(distinct) / len(words) ** 0.75,
            "same_as_before": sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens),
            "word_length": sum(map(len, words)) / len(words) / 20,
            "repeated_lines": 1 - len(set(lines := data.split(b"\n"))) / len(lines),
        }
    digest = xxhash.xxh64_intdigest
    found = [digest(w, 0) >> 1 for w in distinct]
    found += [_feature(f"{k}:{np.searchsorted(STEPS, v, side='right')}") for k, v in shares.items()]
    return np.array(found, np.int64)


def meta_features(source, lang, n_chars) -> np.ndarray:
    size = -1 if n_chars is None else int(n_chars).bit_length()
    return np.array([_feature(f"{k}={v}") for k, v in (("source", source), ("lang", lang), ("size", size), ("both", (source, lang)))], np.int64)


class Rows:
    """Sparse binary rows: feature numbers laid end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.at], minlength=self.n)

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, errors[self.row], minlength=size)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, size: int, start: np.ndarray | None = None, steps: int = 150) -> np.ndarray:
    """Weights of a logistic regression, the last one the intercept. Adam over all rows, small ridge."""
    x, y = Rows([np.r_[r, size] for r in rows]), labels.astype(float)
    w = np.zeros(size + 1) if start is None else start.copy()
    first, second = np.zeros_like(w), np.zeros_like(w)
    ridge = np.full(size + 1, 2e-5)
    ridge[-1] = 0
    for t in range(1, steps + 1):
        g = x.back(_sigmoid(x.dot(w)) - y, size + 1) / max(1, len(y)) + ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w


def selected(rows: list[np.ndarray], labels: np.ndarray, use: np.ndarray, least: float) -> np.ndarray:
    """Sorted features that tell bad rows from good ones, by how far their rate is from the mean rate."""
    own = [np.unique(rows[i]) for i in np.flatnonzero(use)]
    of = np.repeat(labels[use], [len(r) for r in own])
    values, place, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    rate = labels[use].mean()
    z = (np.bincount(place, of) - counts * rate) / np.sqrt(counts * max(rate * (1 - rate), 1e-9))
    return values[(counts >= LEAST_DOCS) & (np.abs(z) >= least)]


def raw_scores(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    return Rows(rows).dot(w[:-1]) + w[-1]


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into calibrated log odds (Newton steps, smoothed labels)."""
    pos, neg = labels.sum(), (1 - labels).sum()
    y = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, np.abs(scores).max(initial=0))
    x = np.stack([scores / scale, np.ones(len(scores))])
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(w @ x)
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        w += np.clip(np.linalg.solve(h, x @ (y - p) - 1e-6 * w), -5, 5)
    return float(max(0.0, w[0]) / scale), float(w[1])


class CoTrained:
    """Vocabularies, weights and calibration of both views, and the threshold."""

    def __init__(self, text_vocabulary: np.ndarray, meta_vocabulary: np.ndarray):
        self.vocabularies = text_vocabulary, meta_vocabulary
        self.weights: list[np.ndarray] = [np.zeros(len(v) + 1) for v in self.vocabularies]
        self.calibration = [(0.0, 0.0), (0.0, 0.0)]
        self.prior, self.threshold = 0.0, 0.5

    def numbers(self, view: int, hashes: np.ndarray) -> np.ndarray:
        v = self.vocabularies[view]
        at = np.searchsorted(v, hashes)
        ok = at < len(v)
        ok[ok] = v[at[ok]] == hashes[ok]
        return np.unique(at[ok])

    def log_odds(self, view: int, rows: list[np.ndarray]) -> np.ndarray:
        slope, intercept = self.calibration[view]
        return slope * raw_scores(rows, self.weights[view]) + intercept

    def combined(self, text: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of being bad: by text, by metadata, and by both as independent views."""
        a, b = self.log_odds(0, text), self.log_odds(1, meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.astype(np.int64).tobytes() for v in values], pa.binary())


def _both_views(docs: DataFrame, keep: str, vocabulary=None) -> DataFrame:
    """(keep columns, text and meta feature hashes) of (source, lang, n_chars, text binary) rows.

    With a ``vocabulary`` the numbers of the known features; in one pass, since a second one behind it
    takes another Python worker for each core.
    """

    def lists(view: int, rows: list[np.ndarray]) -> pa.Array:
        if vocabulary is None:
            return _lists(rows)
        return pa.array([vocabulary.value.numbers(view, x).astype(np.int32).tobytes() for x in rows], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [text_features(x.as_py()) for x in batch.column("text")]
            meta = [meta_features(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")], strict=True)]
            own = [i for i, n in enumerate(batch.schema.names) if n not in ("text", "source", "lang", "n_chars")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in own), lists(0, text), lists(1, meta)], [*(batch.schema.names[i] for i in own), "words", "page"]
            )

    return docs.mapInArrow(run, f"{keep}, words binary, page binary")


def _fitted(text, meta, labels, held, model: CoTrained, extra: list, start: bool) -> None:
    """Fits both views on the labelled rows and what the other view has handed over."""
    for view, rows in enumerate((text, meta)):
        use = np.flatnonzero(~held)
        more = extra[view]
        x = [rows[i] for i in use] + [r for r, _ in more]
        y = np.concatenate([labels[use], np.array([v for _, v in more], float)])
        size = len(model.vocabularies[view])
        model.weights[view] = fit_weights(x, y, size, None if start else model.weights[view], 150 if start else 50)
        scores = raw_scores([rows[i] for i in np.flatnonzero(held)], model.weights[view])
        model.calibration[view] = platt(scores, labels[held])
    rate = (labels[held].sum() + 1) / (held.sum() + 2)
    model.prior = float(np.log(rate / (1 - rate)))


def _threshold(p: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the widest gap among the cuts that err least on the held-out rows."""
    order = np.argsort(p)
    p, y = p[order], labels[order]
    wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
    edges = np.r_[0.0, p, 1.0]
    best = np.flatnonzero(wrong == wrong.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float(np.clip((edges[widest] + edges[widest + 1]) / 2, 0.2, 0.8))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    per_round: int = PER_ROUND,
    row_col: str | None = None,
) -> DataFrame:
    """(id, row, p_text, p_meta, p_bad, keep): one row per document.

    ``labels`` has the id, ``quality`` (1 good) and ``toxic`` (1 toxic); a document is bad if its
    quality is 0 or it is toxic; labels with a null among these are not used, repeated ones count
    as bad if one is. At most ``sample`` labelled documents are used for fitting, drawn by hash; a
    quarter is held out for calibration. Every document is scored, also labelled ones, repeated
    rows, and those with nulls or an empty text. With no usable label of one of the classes, all
    documents are kept with a null score. An empty table gives no rows. ``row`` is the stored row
    number ``row_col``; without one it only tells the rows of the result apart.
    """
    spark = docs.sparkSession
    of = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    given = docs.select(
        F.col(id_col).alias("id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), of("source", "string"), of("lang", "string"),
        of("n_chars", "long"), F.col(text_col).cast("binary").alias("text"),
    )
    kind = given.schema["id"].dataType.simpleString()
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & bad.isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(bad).alias("bad"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    drawn = written(drawn, "label-sample")  # bounded by the parameter
    fitted = _both_views(given.join(F.broadcast(drawn), "id").select("id", "bad", "source", "lang", "n_chars", "text"), f"id {kind}, bad int")
    fitted = fitted.select("bad", "words", "page", F.pmod(F.xxhash64("id"), F.lit(64)).alias("draw")).toPandas().sort_values(["draw", "words", "page", "bad"])
    plain = given.select("id", "row")
    y = fitted["bad"].to_numpy(float)
    if not 0 < y.sum() < len(y) or len(y) < 40:
        none = F.lit(None).cast("double")
        return plain.select("*", none.alias("p_text"), none.alias("p_meta"), none.alias("p_bad"), F.lit(True).alias("keep"))
    hashes = [[np.frombuffer(x, np.int64) for x in fitted[c]] for c in ("words", "page")]
    held = np.arange(len(y)) % 4 == 3
    vocabularies = [selected(h, y, ~held, z) for h, z in zip(hashes, (ASSOCIATION, 0.0), strict=True)]
    model = CoTrained(*vocabularies)
    text, meta = ([model.numbers(v, h) for h in hashes[v]] for v in (0, 1))
    del fitted, hashes
    extra: list[list] = [[], []]
    _fitted(text, meta, y, held, model, extra, True)

    # All documents' features, as numbers of the vocabularies, are written once.
    vocabulary = spark.sparkContext.broadcast(CoTrained(*vocabularies))
    features = _both_views(given, f"id {kind}, row long", vocabulary)
    features = written(features, "features")

    def scored(model: CoTrained, rows: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                views = [[np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in batch.column(c)] for c in ("words", "page")]
                scores = [pa.array(x, pa.float64()) for x in shared.value.combined(*views)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *scores], [*batch.schema.names, "p_text", "p_meta", "p_bad"])

        return rows.mapInArrow(run, f"id {kind}, row long, words binary, page binary, p_text double, p_meta double, p_bad double")

    unlabelled = features.join(known.select("id").hint("merge"), "id", "left_anti").select(*features.columns)
    unlabelled = written(unlabelled, "unlabelled") if rounds else unlabelled
    used: set[int] = set()
    for _ in range(rounds):
        found = written(scored(model, unlabelled), "round")
        handed = 0
        for view, p, other in ((0, "p_text", "page"), (1, "p_meta", "words")):
            for label, order in ((1, F.desc(p)), (0, F.asc(p))):
                sure = F.col(p) >= SURE if label else F.col(p) <= 1 - SURE
                best = found.where(sure).orderBy(order, F.xxhash64("row")).select("row", other).limit(per_round + len(used))
                new = [r for r in best.collect() if r.row not in used][:per_round]  # bounded by the parameters
                extra[1 - view] += [(np.frombuffer(r[1], np.int32).astype(np.int64), label) for r in new]
                used |= {r.row for r in new}
                handed += len(new)
        if not handed:
            break
        _fitted(text, meta, y, held, model, extra, False)
    calibrated = np.flatnonzero(held)
    p = model.combined([text[i] for i in calibrated], [meta[i] for i in calibrated])[2]
    model.threshold = _threshold(p, y[held])
    return scored(model, features).select("id", "row", "p_text", "p_meta", "p_bad", (F.col("p_bad") < model.threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those rejected."""
    rows = numbered(docs)
    good = written(score_documents(rows, labels, id_col, row_col="__row", **options).where("keep").select("row"), "good")
    return rows.join(good.withColumnRenamed("row", "__row").hint("merge"), "__row").select(*docs.columns)
