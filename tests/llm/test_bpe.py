import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lendmend.llm import bpe
from lendmend.llm.queries import op12_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe()


def same(model, library, texts):
    got = model.encode(pa.array(texts, pa.string()))
    back = model.decode(got).to_pylist()
    for text, ids, decoded in zip(texts, got.to_pylist(), back, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert decoded == library.decode(want, skip_special_tokens=False), repr(text)


def test_edges(model, library):
    same(model, library, [
        None, "", "  ", " a  b\n", "Hello World! it's we'LL I'd've", "<|endoftext|>a<|ENDOFTEXT|>", "x<|startoftext|>y <|startoftext|> <|endof text|>",
        "\x00\x01a\x1c b\x0b\x85\xa0c", "é ́ İstanbul ΣΑΣ Ǆ Ɓ K Å ẞ 你好世界!", "!?" * 3000, "''s't'", "a" * 5000, "ab" * 700 + " " + "the" * 500,
        "\U0001f600\U0001f600 ​ x", "12345 1a2b", "<", "<|", "1" * 100,
    ])


def test_random_texts(model, library):
    random.seed(5)
    parts = ["a", "B", "'", "s", "ing", "1", "!", "<", "|", "é", "é", " ", "\n", "\x1f", "\x85", "\xa0", "İ", "Σ", "ß", "中", "\U0001f600", "<|endoftext|>", "\x7f", "Ɓ", "​"]
    same(model, library, ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(3000)])


def test_every_basic_character(model, library):
    same(model, library, [f"a{chr(c)}b {chr(c)}1" for c in range(0x10000) if not 0xD800 <= c < 0xE000])


def test_slices_and_offsets(model, library):
    texts = pa.array(["skip this", None, "one two", "", "three"], pa.string())
    assert model.encode(texts.slice(1)).to_pylist() == model.encode(pa.array(texts.to_pylist()[1:], pa.string())).to_pylist()
    ids = model.encode(texts)
    assert model.decode(ids.slice(2, 2)).to_pylist() == model.decode(ids).to_pylist()[2:4]
    assert model.decode(pa.array([None, b"", np.array([5_000_000, 320], "<u4").tobytes()], pa.binary())).to_pylist() == ["", "", "a</w>"]


def test_forgotten_chunks_are_learnt_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    model = bpe.Bpe()
    for _ in range(2):
        same(model, library, ["one two three", "four five six seven", "one two eight"])


def test_query(spark, saved, library):
    rows = [(1, "A cat's tail, 12 cats!", "x"), (1, "A cat's tail, 12 cats!", "x"), (None, "zwei Wörter", "y"), (2, None, "z"), (3, "", "z"), (4, "long " * 20_000, "z")]
    path = saved(documents=(rows, "doc_id long, text string, ids string"))
    import hashlib

    def want(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = op12_bpe(spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((want(i, t) for i, t, _ in rows), key=str)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    tokens = bpe.encode(docs)
    assert sorted(map(tuple, bpe.decode(tokens).join(tokens, "id").select("id", "ids", "text").collect()), key=str) == sorted(
        ((r.id, r.ids, r.decoded) for r in bpe.round_trip(docs.where("doc_id is not null")).collect() for _ in range(2 if r.id == 1 else 1)), key=str
    )
    empty = saved(documents=([], "doc_id long, text string"))
    assert op12_bpe(spark, empty).collect() == []
