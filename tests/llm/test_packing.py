import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lendmend.llm import packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "It's we'LL 'S !'s don’t İstanbul ǅ ªº²¼ a\x1cb\x85c\xa0d x<|endoftext|>y", "中文 ΑΣ ΟΔΟΣ", "''s'", "", None, "  \n ",
    "\x00a\x01 b_c-d'tt 12 3.5", "ŉ ß SS é é", "one", "one", "word " * 5000, "Été À LA plage, 50% naïve café",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_equal_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 50)
    ids = packing.TokenIds(None)
    rng = random.Random(1)
    alphabet = "aZé' ’.,-_!0٣ßçñ\n\t&😀<|中ª"
    more = ["".join(rng.choice(alphabet) for _ in range(80)) for _ in range(300)]
    for text in [t or "" for t in TEXTS] + more:
        assert np.frombuffer(ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_go_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode("Some text, twice.", add_special_tokens=False).ids
    assert np.frombuffer(packing.TokenIds(path)("Some text, twice."), "<u4").tolist() == want


def check(rows, wanted, window=2048):
    """Every id in exactly one piece; sequences gapless, full or of a power of two."""
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(wanted)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = wanted[doc][at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["doc_tokens"] == len(wanted[doc])
            at += r["length"]
        assert at == len(wanted[doc])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


def test_query_loses_no_id(spark, saved, tokenizer):
    path = saved(documents=([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], DOCS))
    wanted = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    check([r.asDict() for r in queries.op4_packing(spark, path).collect()], wanted)
    assert queries.op4_packing(spark, saved(documents=([], DOCS))).count() == 0


def test_many_shards(spark, docs, tokenizer):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", f"x{rng.randrange(99)}"]) for _ in range(rng.randrange(90))) for _ in range(120)]
    got = packing.pack(docs(list(enumerate(texts))), window=64, shard_tokens=1000).withColumn("ids_crc32", F.crc32("ids")).withColumnRenamed("id", "doc_id")
    wanted = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert len({k >> 32 for k in check([r.asDict() for r in got.collect()], wanted, 64)}) > 3


def test_neighbours_share_words():
    """The seed's window is filled from the documents that share its rare words."""
    docs = [np.array(x) for x in ([5, 5, 9, 9], [1, 2, 3, 4], [5, 9, 9], [1, 3, 2, 4], [7, 8, 7, 8])]
    idf = np.ones(10)
    index = packing.Shard(docs, idf, 4.0)
    assert index.scores(0).argmax() == 0 and np.argsort(-index.scores(0))[1] == 2
    sequences = packing.packed_shard(docs, idf, 4.0, 7)
    assert sequences[0] == [(0, 0, 4), (2, 0, 3)] and sequences[1][:2] == [(1, 0, 4), (3, 0, 3)]


def test_repeated_and_null_ids(docs):
    got = packing.pack(docs([(None, "a b"), (3, "a b"), (3, "a b")])).collect()
    assert sum(r.length for r in got) == 9 and sorted(str(r.id) for r in got if r.start == 0) == ["3", "3", "None"]
