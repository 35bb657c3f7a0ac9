"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The seeds of a test item are its rare word 3-grams: the less frequent their words are in the whole
corpus, the rarer. A passage of a training document that holds a seed of an item is aligned with
the whole item, so paraphrased and edited copies score as well as exact ones. The score is the best
local alignment (match 1, mismatch and gap -1) divided by the item's number of words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import numbered, written

GRAM = 3
SEED_BITS = 24.0  # information of a seed's words; half of an item's grams are seeds in any case
LEAST_SCORE = 0.5
BLOCK_BYTES = 4_000_000  # of item texts that are sent to the tasks at once

#: ASCII punctuation separates words, ASCII letters are lower-cased, other bytes stay.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_WORDS).split()


@dataclass
class Items:
    """A block of test items: ids, word ids of each, and the words' numbers."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]


def _numbered(block: list[tuple]) -> Items:
    vocabulary: dict[bytes, int] = {}
    words = [
        np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int64) for _, text in block
    ]
    return Items([i for i, _ in block], words, vocabulary)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Items with at least one word, in blocks of bounded size; one block at a time on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        if not words_of(row.text):
            continue
        if block and size + len(row.text) > BLOCK_BYTES:
            yield _numbered(block)
            block, size = [], 0
        block.append((row.id, bytes(row.text)))
        size += len(row.text)
    if block:
        yield _numbered(block)


def _word_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How often each word of the vocabulary occurs in all documents, and their number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts = shared.value, np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for x in batch.column("text"):
                found = [number.get(w, -1) for w in words_of(x.as_py())]
                counts += np.bincount(np.array(found, np.int64) + 1, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"word": at - 1, "n": counts[at]})

    found = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary), np.int64)
    total = 0
    for word, n in found:  # at most a row for each word of the block
        total += n
        if word >= 0:
            counts[word] = n
    return counts, total


def _codes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Number of the gram that starts at each position, -1 where a word is unknown."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(size):
        part = words[k : k + n]
        code = code * base + part
        known &= part >= 0
    return np.where(known, code, -1)


def rare_seeds(items: Items, counts: np.ndarray, total: int, gram: int, bits: float) -> dict[int, tuple]:
    """Gram size -> (sorted codes, item of each, offset of each). Items below ``gram`` words are one gram."""
    base = max(2, len(items.vocabulary))
    size_of = min(gram, max(1, int(62 / np.log2(base))))
    information = -np.log2((counts + 1) / (total + len(counts) + 1))
    found = defaultdict(list)
    for i, words in enumerate(items.words):
        size = min(size_of, len(words))
        codes = _codes(words, size, base)
        info = sum(information[words[k : k + len(codes)]] for k in range(size))
        for at in np.flatnonzero(info >= min(bits, float(np.median(info)))):
            found[size].append((codes[at], i, at))
    return {size: tuple(np.array(x, np.int64) for x in zip(*sorted(seeds), strict=True)) for size, seeds in found.items()}


def best_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best score, and the item and passage positions where it ends."""
    slope = np.arange(1, len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        step = np.maximum(row[:-1] + np.where(passage == word, 1, -1), row[1:] - 1)
        np.maximum(step, 0, out=step)
        # A gap in the item costs 1 a word: a running maximum after adding the slope.
        row[1:] = np.maximum.accumulate(step + slope) - slope
        top = int(row[1:].argmax())
        if row[top + 1] > best[0]:
            best = (int(row[top + 1]), i, top)
    return best


def _aligned(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, least: float) -> list[tuple[float, int, int]]:
    """(score, first word, word after the last) of each passage around seeds that scores enough."""
    pad = len(item) // 2 + 2
    spans: list[list[int]] = []
    for start in np.unique(starts).tolist():
        low, high = max(0, start - pad), min(len(doc), start + len(item) + pad)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])
    out = []
    while spans:
        low, high = spans.pop()
        score, i, j = best_alignment(item, doc[low:high])
        if score < least * len(item):
            continue
        _, bi, bj = best_alignment(item[i::-1], doc[low : low + j + 1][::-1])
        first, end = low + j - bj, low + j + 1
        out.append((score / len(item), first, end))
        spans += [s for s in ([low, first], [end, high]) if s[1] - s[0] >= least * len(item)]
    return sorted(out, key=lambda x: x[1])


def contaminated_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = LEAST_SCORE,
    gram: int = GRAM,
    bits: float = SEED_BITS,
) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): each passage that copies a test item.

    Words are runs of letters and digits, ASCII letters lower-cased; positions count a document's
    words. Null and empty texts hold no passage; items without words match nothing; a repeated item
    or document row gives its rows again. Items travel to the tasks in blocks of ``BLOCK_BYTES``,
    each block scans the documents once for word counts and once for passages. Other columns are
    not read, empty tables give no rows.
    """
    spark = docs.sparkSession
    ids = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, score double, first_word int, end_word int"
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        counts, total = _word_counts(given, items.vocabulary)
        shared = spark.sparkContext.broadcast((items, rare_seeds(items, counts, total, gram, bits)))
        found = given.mapInArrow(_scan(shared, least), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else written(out, "passages")


def _scan(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = shared.value
        number, base = items.vocabulary, max(2, len(items.vocabulary))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = np.array([number.get(w, -1) for w in words_of(text.as_py())], np.int64)
                starts = defaultdict(list)
                for size, (codes, of, offset) in seeds.items():
                    own = _codes(doc, size, base)
                    at = np.flatnonzero(own >= 0)
                    low, high = np.searchsorted(codes, own[at]), np.searchsorted(codes, own[at], side="right")
                    for k in np.flatnonzero(low < high):
                        for s in range(low[k], high[k]):
                            starts[int(of[s])].append(int(at[k] - offset[s]))
                for i, where in starts.items():
                    rows += [(doc_id, items.ids[i], *x) for x in _aligned(doc, items.words[i], np.array(where), least)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            names = ["doc_id", "item_id", "score", "first_word", "end_word"]
            kinds = [batch.schema.field(0).type, None, pa.float64(), pa.int32(), pa.int32()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a copied passage, whatever their ids are."""
    rows = numbered(docs)
    found = contaminated_passages(rows, benchmark, **options | {"id_col": "__row"}).select("doc_id").distinct()
    return rows.join(found.withColumnRenamed("doc_id", "__row").hint("merge"), "__row", "left_anti").select(*docs.columns)
