"""Lexical retrieval packing.

Documents become token ids. They are dealt to shards of bounded size by their rarest token in the
vocabulary's own order (merges learned later are rarer), so that documents which share it meet, and
every shard holds a BM25 inverted index of its own documents, weighted by counts over all.
A seed document asks it for its best unused neighbours, which fill the seed's window one after the
other; the last one is cut where the window ends, and what remains of it is used later.
"""

from __future__ import annotations

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

from lendmend.llm.common import batches_of, gathered, slices, taken, written

WINDOW = 2048
END = 1  # id that ends every document
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75  # usual BM25 constants
SPACE, LETTER, NUMBER, OTHER = range(4)
CACHED = 200_000  # words of a generation whose ids a worker remembers
SLICE = 4 << 20  # bytes of text coded at once
BATCH = 1000  # rows with whole texts that are handed to Python at once

#: Fixed pattern of the word tokenizer's pre-tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def kind_of(path: str | None) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path or default_path()).get_vocab_size() <= 1 << 16 else "<u4"


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text's begin, with the end."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    given = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return given, bounds - bounds[0]


def _any(data: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Which texts have a byte that is odd, or an I with a dot."""
    at = np.flatnonzero(odd[data])
    dotted = np.flatnonzero((data[:-1] == 0xC4) & (data[1:] == 0xB0))
    found = np.zeros(len(bounds) - 1, bool)
    found[np.searchsorted(bounds, np.r_[at, dotted], "right") - 1] = True
    return found


class TokenIds:
    """Token ids of texts. For tokenizers that split texts into words, a batch's distinct words are
    coded once, and their ids are remembered.

    The short way is taken for texts of Latin letters whose lower case and normal form are plain; of
    all others the distinct parts between white space are coded.
    """

    def __init__(self, path: str | None, kind: str = "<u4"):
        from tokenizers import Tokenizer

        path, self.kind = path or default_path(), kind
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        steps = [x["type"] for x in (given.get("normalizer") or {}).get("normalizers", [])]
        split = (given.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORD_PATTERN}
        self.specials = re.compile("|".join(re.escape(x["content"]) for x in given.get("added_tokens", [])) or r"(?!)")
        latin = [chr(c) for c in range(0x250)]
        letters = "".join(c for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        space = "\t-\r \x85\xa0"
        # I with a dot has a lower case of two characters.
        self.other = re.compile("[^\x00-ɏ]|[İ\x1c-\x1f]")
        self.words = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.spaces = re.compile(f"[{space}]+")
        # Kinds of bytes below 128, then of all characters of two bytes, from 256 on.
        kinds = [SPACE if self.spaces.match(c) else LETTER if c in letters else NUMBER if c in numbers else OTHER for c in map(chr, range(2048))]
        self.classes = np.array([*kinds[:128], *[OTHER] * 128, *kinds], np.uint8)
        # What the short way leaves to the tokenizer: characters from U+0240 on, I with a dot, some
        # control characters, and what may be a special token.
        self.odd = np.zeros(256, bool)
        self.odd[0xC9:] = self.odd[0x1C:0x20] = True
        self.odd[[ord(x["content"][0]) for x in given.get("added_tokens", []) if x["content"].isascii()]] = True
        vocabulary = self.tokenizer.get_vocab()
        suffix = given["model"].get("end_of_word_suffix")
        self.by_word &= bool(suffix)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        # Two generations: when one is full, what is asked for again moves on, the rest is forgotten.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned numbers of the asked kind."""
        return self.encode(pa.array([text], pa.string()))[0].tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's begin, with the end."""
        if not self.by_word:
            ids = [self.whole(x or "") for x in texts.to_pylist()]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize
            return np.frombuffer(b"".join(ids), self.kind), np.r_[0, np.cumsum(size)]
        words, ends, plain = self.split(texts)
        coded = words.dictionary_encode()
        ids = self.of_words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize
        at = coded.indices.to_numpy()
        flat = taken(np.frombuffer(b"".join(ids), self.kind), (np.cumsum(size) - size)[at], size[at])
        bounds = np.r_[0, np.cumsum(size[at])][ends]
        if not plain.all():
            rest, rest_bounds = gathered(texts.filter(pa.array(~plain)), self.parts, self.kind)
            flat, sizes = np.insert(flat, np.repeat(bounds[:-1][~plain], np.diff(rest_bounds)), rest), np.diff(bounds)
            sizes[~plain] = np.diff(rest_bounds)
            bounds = np.r_[0, np.cumsum(sizes)]
        return flat, bounds

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words of plain texts in lower case, and white space between them; where each text's begin,
        with the end; and which texts are plain. The others have none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        raw, low = _bytes(texts), pc.utf8_lower(texts)
        plain = ~(_any(raw[0], raw[1], self.odd) | _any(*_bytes(low), self.odd))
        low = pc.if_else(pa.array(plain), low, "")
        data, bounds = _bytes(low)
        kind = self.classes[data]
        lead = np.flatnonzero(data >= 0xC2)
        kind[lead] = kind[lead + 1] = self.classes[256 + ((data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F)]
        starts = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)][: len(data)]
        starts[lead + 1] = False
        first = bounds[:-1][np.diff(bounds) > 0]
        starts[first] = True
        # 's, 't, 'm, 'd, 're, 've and 'll are words where the apostrophe begins a run.
        fresh = np.zeros(len(data) + 3, bool)
        fresh[first] = True
        fresh[len(data) :] = True
        after = np.r_[data, np.zeros(3, np.uint8)]
        mark = np.flatnonzero((data == ord("'")) & starts)
        mark = mark[~fresh[mark + 1]]
        one = np.isin(after[mark + 1], np.frombuffer(b"stmd", np.uint8))
        pair = after[mark + 1].astype(np.int64) << 8 | after[mark + 2]
        two = ~fresh[mark + 2] & np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        starts[mark[one | two] + 1] = False
        stop = np.r_[mark[one] + 2, mark[two] + 3]
        starts[stop[stop < len(data)]] = True
        at = np.flatnonzero(starts)
        offsets = np.r_[at, len(data)]
        words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
        return words, np.searchsorted(at, bounds), plain

    def of_words(self, distinct: list[str]) -> list[bytes]:
        if len(self.known) > CACHED:
            self.before, self.known = self.known, {}
        out = [*map(self.known.get, distinct)]
        if None in out:
            self._learn({w for w, ids in zip(distinct, out, strict=True) if ids is None and not self.spaces.fullmatch(w)})
            out = [self.known.get(w, b"") for w in distinct]
        return out

    def parts(self, distinct: list[str]) -> list[bytes]:
        """Ids of texts without white space."""
        split, new = [], set()
        for part in distinct:
            low = part.lower()
            words = None
            if not self.other.search(part + low) and not self.specials.search(part):
                words = self.words.findall(low)
                new.update([w for w in words if w not in self.known])
            split.append(words)
        self._learn(new)
        return [self.whole(p) if w is None else b"".join(map(self.known.__getitem__, w)) for p, w in zip(distinct, split, strict=True)]

    def _learn(self, words: set[str]) -> None:
        """Ids of words new to this generation, all at once; the last token of each is known by its form."""
        new = []
        for w in words:
            if (ids := self.before.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = ids
        if not new:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.kind)
        data, at = ids.tobytes(), 0
        for w, end in zip(new, (ids.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
            self.known[w] = data[at:end]
            at = end


@lru_cache(maxsize=2)
def _token_ids(path: str | None, kind: str) -> TokenIds:
    """One instance for each Python worker, kept from task to task."""
    return TokenIds(path, kind)


def tokenized(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, kind: str = "<u4"
) -> DataFrame:
    """(id, row, tokens binary, anchor): ids as unsigned numbers of ``kind`` with ``END`` after them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, width = _token_ids(path, kind), np.dtype(kind).itemsize
        for batch in batches:
            first = 0
            for part in slices(batch.column(2), SLICE):
                flat, bounds = ids.encode(part)
                flat = np.insert(flat, bounds[1:], END)
                bounds = bounds + np.arange(len(bounds))
                ends = width * bounds
                tokens = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])
                anchors = np.maximum.reduceat(flat, bounds[:-1]).astype(np.int64)
                rows = batch.slice(first, len(part))
                first += len(part)
                columns = [*rows.columns[:2], tokens.cast(pa.binary()), pa.array(anchors)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "tokens", "anchor"])

    given = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, row long, tokens binary, anchor long")


def _ids(x, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(x.as_py(), kind)


def document_frequencies(tokens: DataFrame, kind: str = "<u4") -> np.ndarray:
    """In how many documents each token id occurs; one number for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            for x in batch.column(0):
                ids = _ids(x, kind)
                if (top := int(ids.max()) + 1) > len(total):
                    total, held = np.append(total, np.zeros(top - len(total), np.int64)), np.zeros(top, bool)
                held[ids] = True
                at = np.flatnonzero(held)
                total[at] += 1
                held[at] = False
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": at, "n": total[at]})

    found = tokens.select("tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.toPandas()  # at most a row for each id of the vocabulary
    out = np.zeros(int(rows.token.max()) + 1 if len(rows) else 1, np.int64)
    out[rows.token] = rows.n
    return out


class Shard:
    """BM25 inverted index of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, owners, weights = [], [], []
        for i, ids in enumerate(docs):
            term, tf = np.unique(ids, return_counts=True)
            useful = idf[term] > 0
            term, tf = term[useful], tf[useful]
            terms.append(term)
            owners.append(np.full(len(term), i))
            weights.append(idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        self.of = terms
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.owners, self.weights = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for the seed's terms."""
        low, high = self.starts[self.of[seed]], self.starts[self.of[seed] + 1]
        sizes = high - low
        if not sizes.sum():
            return np.zeros(self.n)
        at = np.repeat(low - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        return np.bincount(self.owners[at], self.weights[at], minlength=self.n)


def packed_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). All but the last few fill their window.

    What is left at the end is cut into sequences whose lengths are powers of two.
    """
    index = Shard(docs, idf, mean)
    at = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    sequences: list[list[tuple[int, int, int]]] = []
    for seed in range(len(docs)):
        while left[seed] >= window:
            sequences.append([(seed, int(at[seed]), window)])
            at[seed] += window
            left[seed] -= window
        if not left[seed]:
            continue
        open_ = [(seed, int(at[seed]), int(left[seed]))]
        room = window - int(left[seed])
        at[seed] += left[seed]
        left[seed] = 0
        unused = np.flatnonzero(left)
        for n in unused[np.argsort(-index.scores(seed)[unused], kind="stable")] if room else []:
            take = min(room, int(left[n]))
            open_.append((int(n), int(at[n]), take))
            at[n] += take
            left[n] -= take
            room -= take
            if not room:
                break
        if not room:
            sequences.append(open_)
            continue
        # Nothing is left to fill this window.
        total = window - room
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                need, part = 1 << bit, []
                while need:
                    doc, start, length = open_.pop(0)
                    take = min(need, length)
                    part.append((doc, start, take))
                    need -= take
                    if take < length:
                        open_.insert(0, (doc, start + take, length - take))
                sequences.append(part)
    return sequences


def _pack(shared, window: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        idf, mean = shared.value
        table = table.sort_by("row")
        docs = [_ids(x, kind) for x in table.column("tokens")]
        own, shard = table.column("id").to_pylist(), table.column("shard")[0].as_py()
        rows = []
        for k, sequence in enumerate(packed_shard(docs, idf, mean, window)):
            offset = 0
            for doc, start, length in sequence:
                rows.append((own[doc], start, length, docs[doc][start : start + length].astype("<u4").tobytes(), len(docs[doc]), (shard << 32) + k, offset))
                offset += length
        kinds = [table.schema.field("id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """(id, start, length, ids binary, doc_tokens, sequence_id, offset): one row per piece.

    Every id of every document, the end id included, lies in exactly one piece; a null or empty text
    is the end id alone. Rows stay as often as they are, also with a null id. Sequences fill the
    window but for the last ones of a shard, whose lengths are powers of two. An empty table gives
    no rows; other columns are not read. A task holds the ids of a shard, ``shard_tokens`` or one very
    long document more. ``path`` names the tokenizer file; by default the word
    tokenizer of the installed package.
    """
    spark = docs.sparkSession
    kind = kind_of(path)
    width = np.dtype(kind).itemsize
    with batches_of(spark, BATCH):
        tokens = written(tokenized(docs, id_col, text_col, path, kind), "tokens")
    n_docs, n_tokens = tokens.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("tokens") / width), F.lit(0)).cast("long")).first()
    df = document_frequencies(tokens, kind)
    idf = np.maximum(0, np.log((n_docs - df + 0.5) / (df + 0.5)))
    shared = spark.sparkContext.broadcast((idf, max(1.0, n_tokens / max(1, n_docs))))  # as long as the vocabulary
    # Anchors are laid end to end by their tokens and cut at equal lengths: a common anchor spans
    # many shards, and its documents are spread over them by hash.
    size = F.sum(F.octet_length("tokens") / width).cast("long").alias("size")
    sizes = tokens.groupBy("anchor").agg(size).toPandas().sort_values("anchor")
    ends = sizes["size"].cumsum()
    lookup = spark.createDataFrame(
        list(zip(sizes["anchor"].tolist(), (ends - sizes["size"]).tolist(), sizes["size"].tolist(), strict=True)),
        "anchor long, begin long, size long",
    )
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20)
    shard = F.floor((F.col("begin") + share * F.col("total")) / shard_tokens).cast("long")
    dealt = tokens.join(F.broadcast(lookup.withColumnRenamed("size", "total")), "anchor")
    dealt = dealt.select("id", "row", "tokens", shard.alias("shard"))
    out = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    id_kind = tokens.schema["id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(_pack(shared, window, kind), f"id {id_kind}, {out}")
