"""Byte-pair encoding and decoding by a priority queue of merge ranks.

Texts are cut at white space, which no word of the tokenizer crosses, and every distinct chunk of a
batch is encoded once; the ids of the texts are gathered from them. The merges of a word are found
with a heap of (rank, place) over a doubly linked list of its symbols: a popped entry whose symbols
have changed since is stale and skipped.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmend.llm.common import gathered, slices

CACHED = 250_000  # words of a generation whose ids a worker remembers
LONG = 64  # longer words are not remembered
SLICE = 8 << 20  # bytes of text worked on at once

#: The word tokenizer's pre-tokenizer splits by letters, numbers and the rest; this is the same for
#: Latin characters, whose normal form is themselves (I with a dot has a lower case of two).
OTHER = re.compile("[^\x00-ɏ]|İ")
SPACE = "\t-\r \x85\xa0"


def latin_words() -> re.Pattern[str]:
    latin = [chr(c) for c in range(0x250)]
    letters = "".join(c for c in latin if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Bpe:
    """Vocabulary, merge ranks and the words of a tokenizer file."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or default_path()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        if model["type"] != "BPE" or given.get("decoder") or given.get("post_processor"):
            raise ValueError("a byte-level BPE tokenizer file without decoder and post-processor is expected")
        self.vocabulary = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in given.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        # Symbol pairs as one number -> rank; rank -> id of the merged symbol.
        self.rank: dict[int, int] = {}
        self.made = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocabulary[left] << 32 | self.vocabulary[right]] = rank
            self.made.append(self.vocabulary[left + right])
        # What splits a text into words is not the model's part: it is asked for any text that is not plain.
        self.tokenizer = Tokenizer.from_file(path)
        steps = [x["type"] for x in (given.get("normalizer") or {}).get("normalizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and self.suffix == "</w>"
        self.symbol, self.split = byte_symbols(), latin_words().findall
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.specials.items()}
        self.strings = pa.array([strings.get(i) for i in range(max(strings, default=-1) + 1)], pa.string())

    def merged(self, symbols: list[int]) -> list[int]:
        """Ids left when the pair of least rank, the leftmost first, is merged until none is left."""
        n, rank_of = len(symbols), self.rank.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []  # rank and place in one number
        for i in range(n - 1):
            if (rank := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n or rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale: one of the two was merged since
            symbols[i], symbols[j] = whole, _ = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(whole << 32 | symbols[k])) is not None:
                    heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbols[h] << 32 | whole)) is not None:
                heapq.heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def learnt(self, symbols: str) -> bytes:
        """Ids of a word, given as the symbols of its bytes; the last one carries the end-of-word suffix."""
        start = [self.vocabulary[s] for s in symbols[:-1]] + [self.vocabulary[symbols[-1] + self.suffix]]
        return np.array(self.merged(start), "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if (ids := self.known.get(word)) is None:
            if (ids := self.before.get(word)) is None:
                plain = word.isascii() and word.isprintable()
                ids = self.learnt(word if plain else "".join([self.symbol[b] for b in word.encode()]))
            if len(word) <= LONG:
                self.known[word] = ids
        return ids

    def split_by_file(self, text: str) -> list[bytes]:
        """Ids of the words of any text, as the file's own steps cut it; these come as symbols."""
        text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [self.learnt(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space, as little-endian unsigned 32-bit numbers."""
        if self.special is not None and self.special.search(chunk):
            parts = enumerate(self.special.split(chunk))
            return b"".join([np.array([self.specials[p]], "<u4").tobytes() if k % 2 else self.chunk(p) for k, p in parts if p])
        low = chunk.lower()
        if self.plain and (chunk.isascii() or not OTHER.search(chunk + low)):
            return b"".join(map(self.word, self.split(low)))
        return b"".join(self.split_by_file(chunk))

    def chunks(self, distinct: list[str]) -> list[bytes]:
        if len(self.known) > CACHED:  # two generations: what is asked for again moves on, the rest is forgotten
            self.before, self.known = self.known, {}
        return [self.chunk(c) for c in distinct]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of every text (null: none) as binary."""
        flat, bounds = gathered(texts, self.chunks, "<u4")
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(4 * bounds), pa.py_buffer(flat.tobytes())])

    def decode(self, ids: pa.Array) -> pa.Array:
        """Vocabulary strings of the ids, joined by spaces; ids that are no token give nothing."""
        column = pc.fill_null(ids.cast(pa.large_binary()), b"")
        sizes = pc.binary_length(column).to_numpy() // 4
        start = column.offset
        bounds = np.frombuffer(column.buffers()[1], np.int64)[start : start + len(column) + 1]
        data = column.buffers()[2]
        flat = np.frombuffer(data if data else b"", "<u4", int(sizes.sum()), int(bounds[0]) if data else 0)
        known = flat < len(self.strings)
        if not known.all():
            sizes = np.diff(np.r_[0, np.cumsum(known)][np.r_[0, np.cumsum(sizes)]])
            flat = flat[known]
        strings = self.strings.take(pa.array(flat))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), strings)
        if strings.null_count:
            lists = pa.array([[s for s in x if s is not None] for x in lists.to_pylist()], pa.list_(pa.string()))
        return pc.binary_join(lists, " ")


@lru_cache(maxsize=2)
def bpe(path: str | None = None) -> Bpe:
    """One instance for each file and Python worker, kept from task to task."""
    return Bpe(path)


def _mapped(df: DataFrame, column: str, made: dict[str, str], calls: list[str], path: str | None) -> DataFrame:
    """``df`` with new columns (name: type) at the end: what the ``calls`` of the tokenizer make of
    ``column`` and then of each other's result, in one Python pass."""
    at = df.columns.index(column)
    kinds = [pa.binary() if kind == "binary" else pa.string() for kind in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            first = 0
            for part in slices(batch.column(at), SLICE):
                columns = list(batch.slice(first, len(part)).columns)
                first += len(part)
                for call, kind in zip(calls, kinds, strict=True):
                    part = getattr(model, call)(part)
                    columns.append(part.cast(kind))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *made])

    fields = [f"`{c}` {t}" for c, t in [*df.dtypes, *made.items()]]
    return df.mapInArrow(run, ", ".join(fields))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text as little-endian unsigned 32-bit numbers, one row per row.

    Equal to the tokenizers library's ``encode`` without special tokens added; a special token that
    stands in a text gives its id. A null or empty text gives no ids; rows stay as often as they are,
    also with a null id; other columns are not read. Nothing is shuffled, and a text is worked on
    whole: memory is a few times the longest one. ``path`` names the tokenizer file, a byte-level BPE
    without decoder and post-processor; by default the word tokenizer of the installed package.
    """
    return _mapped(_texts(docs, id_col, text_col), "text", {"ids": "binary"}, ["encode"], path).select("id", "ids")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(id, ids) -> (id, text): the vocabulary strings of the ids, with spaces between them.

    Special tokens are kept, null or no ids give an empty text, and an id without a token gives nothing.
    """
    given = tokens.select("id", F.col("ids").cast("binary").alias("ids"))
    return _mapped(given, "ids", {"text": "string"}, ["decode"], path).select("id", "text")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, decoded): ``encode`` and ``decode`` of its ids in one pass."""
    made = {"ids": "binary", "decoded": "string"}
    return _mapped(_texts(docs, id_col, text_col), "text", made, ["encode", "decode"], path).select("id", *made)
