"""Spelling variant grouping with k-d trees over letter counts.

One inserted, deleted or replaced code point changes the letter counts of a word by an L1 distance
of at most two. For every word length a split tree, fitted on a bounded sample, cuts the count
vectors into cells; a word lies in one cell and asks each cell whose box is within the distance, of
its own length (two) and of the length below (one). A cell holds a k-d tree of its words, is searched
by the same box pruning, and what is left is verified letter by letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import slices, written

MIN_LENGTH = 5
MIN_COUNT = 3
DAMAGE = 97  # an occurrence is damaged if this divides its checksum
SLICE = 16 << 20  # bytes of text counted at once
CELL = 32_768  # words of a cell, about
PER_CELL = 64  # words of the sample for each cell
SAMPLE = 1 << 20  # words of the sample at most: 16,384 cells
LEAF = 64  # words of a leaf inside a cell
ASKED = 4096  # words that search a cell's tree at once

#: Letters are a-z and U+00C0 to U+00FF, in UTF-8 the byte C3 and one more; A-Z become a-z.
_LOW = np.full(256, ord(" "), np.uint8)
_LOW[ord("a") : ord("z") + 1] = _LOW[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOW[0xC3] = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def runs(texts: pa.Array) -> pa.Array:
    """Lists of the letter runs of every text, A-Z in lower case."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    given = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    low = _LOW[given]
    second = np.flatnonzero(given[:-1] == 0xC3) + 1
    low[second] = given[second]
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(low.tobytes())])
    return pc.ascii_split_whitespace(clean)


def counted(ids: list[str], texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of some texts after damage, and how often each occurs."""
    found = runs(texts)
    coded = found.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    offsets = found.offsets.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    own = words.to_pylist()
    raw = [w.encode() for w in own]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    sums = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    # The checksum of "<id>:" and a word after it is that of the first, moved on by the bytes of the
    # word, xor that of the word.
    state = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), np.uint32, len(ids))
    value = np.zeros(len(at), np.uint32)
    sizes = size[at]
    order = np.argsort(sizes, kind="stable")
    ends = np.searchsorted(sizes[order], np.arange(65), "right")
    for n in range(1, 65):
        state = table[state & 0xFF] ^ (state >> 8)
        mine = order[ends[n - 1] : ends[n]]
        value[mine] = state[doc[mine]] ^ sums[at[mine]]
    for i in order[ends[64] :]:
        value[i] = zlib.crc32(f"{ids[doc[i]]}:{own[at[i]]}".encode())
    hit = np.flatnonzero((value % DAMAGE == 0) & (sizes > 0))
    n = np.bincount(at, minlength=len(own)) - np.bincount(at[hit], minlength=len(own))
    n[size == 0] = 0
    changed = []
    for i, h in zip(at[hit].tolist(), value[hit].tolist(), strict=True):
        word = own[i]
        changed.append(word[: h % len(word)] + word[h % len(word) + 1 :])
    kept = np.flatnonzero(n)
    return pa.concat_arrays([words.take(pa.array(kept)).cast(pa.string()), pa.array(changed, pa.string())]), np.r_[n[kept], np.ones(len(changed), np.int64)]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _crc_table()
        for batch in batches:
            ids, first = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1), SLICE):
                words, n = counted(ids[first : first + len(part)], part, table)
                first += len(part)
                long = pc.greater_equal(pc.utf8_length(words), MIN_LENGTH)
                yield pa.RecordBatch.from_arrays([words.filter(long), pa.array(n).filter(long)], ["word", "n"])

    given = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = given.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def coded(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each. All of them are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each code point occurs in each word."""
    n = len(codes)
    flat = np.repeat(np.arange(n) * 256, codes.shape[1]) + codes.ravel()
    return np.bincount(flat, minlength=n * 256).reshape(n, 256).astype(np.int32)


def grow(counts: np.ndarray, at: np.ndarray, leaf: int) -> tuple | np.ndarray:
    """A k-d tree: (letter, cut, tree of counts up to the cut, tree of the others), or the rows of a leaf.

    It is cut at the letter of the largest variance, near its median. Rows with the same counts stay
    in one leaf.
    """
    if len(at) <= leaf:
        return at
    mine = counts[at]
    letter = int(np.argmax(mine.var(0)))
    column = mine[:, letter]
    low, high = column.min(), column.max()
    if low == high:
        return at
    cut = min(int(np.median(column)), int(high) - 1)
    left = column <= cut
    return letter, cut, grow(counts, at[left], leaf), grow(counts, at[~left], leaf)


def reached(tree, counts: np.ndarray, radius: int) -> Iterator[tuple[tuple | np.ndarray, np.ndarray]]:
    """(leaf, rows of ``counts`` whose L1 distance to the leaf's box is at most ``radius``)."""
    everything = (-1, 1 << 30)
    stack = [(tree, np.arange(len(counts)), np.zeros(len(counts), np.int32), {})]
    while stack:
        node, rows, far, box = stack.pop()
        if not isinstance(node, tuple):
            yield node, rows
            continue
        letter, cut, left, right = node
        low, high = box.get(letter, everything)
        value = counts[rows, letter]
        rest = far - np.maximum(np.maximum(low - value, value - high), 0)
        for child, side in ((left, (low, cut)), (right, (cut + 1, high))):
            now = rest + np.maximum(np.maximum(side[0] - value, value - side[1]), 0)
            near = now <= radius
            if near.any():
                stack.append((child, rows[near], now[near], box | {letter: side}))


def _numbered(tree, first: int) -> tuple[object, int]:
    """The tree with the number of a cell in the place of each leaf."""
    if not isinstance(tree, tuple):
        return first, first + 1
    left, first = _numbered(tree[2], first)
    right, first = _numbered(tree[3], first)
    return (tree[0], tree[1], left, right), first


def split_trees(words: DataFrame) -> dict[int, object]:
    """For each length of a sampled word, a split tree whose leaves are cells.

    The sample has ``PER_CELL`` words for ``CELL`` words and at most ``SAMPLE``; a length that is not
    in it is one cell. It only decides how the work is cut: every word is in a cell and searched.
    """
    total = words.count()
    share = min(1.0, PER_CELL / CELL, SAMPLE / max(1, total)) if total > PER_CELL else 1.0
    bits = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    of: dict[int, list[str]] = {}
    for (word,) in words.where(bits < int(share * (1 << 30))).select("word").toLocalIterator():
        of.setdefault(len(word), []).append(word)
    trees = {}
    for length, sample in of.items():
        counts = letter_counts(coded(sample))
        trees[length], _ = _numbered(grow(counts, np.arange(len(sample)), PER_CELL), 0)
    return trees


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their code points) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, coded([words[i] for i in rows])


def _ask(shared) -> Callable:
    """One row for each cell that a word lies in or asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            rows, cells, home = [], [], []

            def add(length, radius, mine, counts, own):
                for leaf, near in reached(trees.get(length, 0), counts, radius):
                    rows.append(mine[near])
                    cells.append(np.full(len(near), length << 32 | leaf))
                    home.append(np.full(len(near), own))

            for length, mine, codes in _by_length(batch.column(0).to_pylist()):
                counts = letter_counts(codes)
                add(length, 0, mine, counts, True)
                add(length, 2, mine, counts, False)
                if length > MIN_LENGTH:
                    add(length - 1, 1, mine, counts, False)
            if rows:
                at = pa.array(np.concatenate(rows))
                columns = [pa.array(np.concatenate(cells)), pa.array(~np.concatenate(home)), *[c.take(at) for c in batch.columns]]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "asks", "word", "n"])

    return run


class Cell:
    """The words of a cell, all of one length, in a k-d tree."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = np.array(words, object), np.array(n, np.int64)
        self.codes = coded(words)
        counts = letter_counts(self.codes)
        self.tree = grow(counts, np.arange(len(words)), LEAF)
        self.signs = signs(counts)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``codes``, word of the cell) that are one edit apart."""
        same = codes.shape[1] == self.codes.shape[1]
        radius = 2 if same else 1
        counts = letter_counts(codes)
        own = signs(counts)
        asking, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for leaf, rows in reached(self.tree, counts, radius):
            for part in np.array_split(leaf, -(-len(leaf) // LEAF)):  # words of the same letters share a leaf
                close = np.bitwise_count(own[rows][:, None] ^ self.signs[part][None, :]) <= radius
                i, j = np.nonzero(close)
                i, j = rows[i], part[j]
                ok = (replaced if same else dropped)(codes[i], self.codes[j])
                asking.append(i[ok])
                found.append(j[ok])
        return np.concatenate(asking), np.concatenate(found)


def signs(counts: np.ndarray) -> np.ndarray:
    """Which letters occur an odd number of times, folded to 64 bits; they differ by at most the L1 distance."""
    odd = (counts & 1).astype(np.uint64)
    return np.bitwise_xor.reduce(odd.reshape(len(counts), 4, 64) << np.arange(64, dtype=np.uint64), axis=(1, 2))


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of the same length differ in one place."""
    return (a != b).sum(1) == 1


def dropped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a row of ``b`` is that of ``a`` without one place."""
    front = np.logical_and.accumulate(a[:, :-1] == b, axis=1).sum(1)
    back = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(1)
    return front + back >= b.shape[1]


def _best(rows: np.ndarray, words: np.ndarray, n: np.ndarray, to: np.ndarray, to_n: np.ndarray, found: list) -> None:
    """Adds (word, n, links, the linked word of largest n, that n) for every word in ``rows``."""
    if not len(rows):
        return
    _, rank = np.unique(to.astype(str), return_inverse=True)
    order = np.lexsort((rank, -to_n, rows))
    rows, to, to_n = rows[order], to[order], to_n[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    links = np.diff(np.r_[first, len(rows)])
    found.append((words[rows[first]], links, to[first], to_n[first]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, first the words that lie in it, then those that ask it."""
    cell, tree, words, n = None, None, [], []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        asks = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            if keys[start] != cell:
                cell, tree, words, n = keys[start], None, [], []
            if not asks[start]:
                words += part.column(2).to_pylist()
                n += part.column(3).to_pylist()
                continue
            if not words:  # a cell of the sample's tree in which no word lies
                continue
            tree = tree or Cell(words, n)
            asked, asked_n = np.array(part.column(2).to_pylist(), object), part.column(3).to_numpy()
            found = []
            for length, rows, codes in _by_length(asked.tolist()):
                for at in range(0, len(rows), ASKED):
                    mine = rows[at : at + ASKED]
                    i, j = tree.near(codes[at : at + ASKED])
                    i = mine[i]
                    _best(i, asked, asked_n, tree.words[j], tree.n[j], found)
                    if length != tree.codes.shape[1]:
                        _best(j, tree.words, tree.n, asked[i], asked_n[i], found)
            if found:
                word, links, to, to_n = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [pa.array(word, pa.string()), pa.array(links), pa.array(to, pa.string()), pa.array(to_n)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "links", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): how many words of ``words`` (word, n) are one edit away, and the most frequent.

    Only words that have such a word. Of equal n the smallest in code-point order is taken.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(split_trees(words))  # a few numbers for CELL words
    cells = sum(_numbered(t, 0)[1] for t in shared.value.values())
    asked = words.mapInArrow(_ask(shared), "cell long, asks boolean, word string, n long")
    dealt = asked.repartition(max(2 * spark.sparkContext.defaultParallelism, cells), "cell").sortWithinPartitions("cell", "asks")
    found = dealt.mapInArrow(_search, "word string, links long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    found = found.groupBy("word").agg(F.sum("links").alias("n_near"), best)
    return found.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of ``forms`` (word, form), follow forms to the last.

    A form has at least twice the n of its word, so there is no cycle, and doubling the step each
    round takes about the logarithm of the longest way. Each round is written.
    """
    step = written(forms.select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        moved = step.where("moved").limit(1).count()
        step = step.drop("moved")
        if not moved:
            return step


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words are maximal runs of a-z and U+00C0 to U+00FF, A-Z in lower case, some of them damaged by a
    checksum of document and word; those of at least five code points and three occurrences count. A
    word's form is the most frequent word one edit away (ties: the smallest in code-point order) if
    it is at least twice as frequent, and its root the last form on the way. A null or empty text
    has no words, a null id is an empty one, repeated rows count each, no words give no rows; other
    columns are not read. A cell keeps its words in memory, about ``CELL`` of them, or all of one
    length that have the very same letters; the words that ask it pass by in batches.
    """
    words = written(vocabulary(docs, id_col, text_col), "words")
    near = near_words(words)
    big = F.col("form_n") >= 2 * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(big, F.col("form")).alias("form"), F.when(big, F.col("form_n")).alias("form_n"),
    )
    found = written(joined, "spelling")
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
