import random

import numpy as np

from lendmend.llm import decontaminate as d
from lendmend.llm import queries

BENCH = "item_id long, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def align(item, passage):
    """Smith-Waterman by its table: best score."""
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def make():
    rng = random.Random(12)
    common = [f"c{i}" for i in range(15)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(4000)}"
    items = [" ".join(word() for _ in range(rng.randint(12, 40))) for _ in range(10)]
    docs = []
    for k in range(60):
        words = [word() for _ in range(rng.randint(0, 120))]
        if k % 2:
            copy = items[k % 10].split()
            for _ in range(k % 5):  # substitutions, deletions, insertions
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            words[len(words) // 2 : len(words) // 2] = copy
        docs.append(" ".join(words))
    return items, docs


def test_finds_what_full_alignment_finds(spark, saved):
    items, docs = make()
    path = saved(documents=([(i, t, "en", "s", 1) for i, t in enumerate(docs)], DOCS), benchmark=(list(enumerate(items)), BENCH))
    got = {(r.doc_id, r.item_id): r.score for r in queries.op10_decontaminate(spark, path).collect()}
    want = {}
    for i, t in enumerate(docs):
        for j, x in enumerate(items):
            score = align(x.split(), t.split()) / len(x.split())
            if score >= d.LEAST_SCORE:
                want[i, j] = score
    assert got == want and len(want) >= 25


def test_alignment_equals_the_table():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        score, i, j = d.best_alignment(a, b)
        assert score == align(a, b) and (not score or align(a[: i + 1], b[: j + 1]) == score)


def test_every_copy_in_a_document_and_case(docs, spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "other words entirely of nothing known here")], BENCH)
    text = f"{item.upper()}! filler one two three four five six seven {item.replace('fox', 'cat')}."
    got = d.contaminated_passages(docs([(5, text), (None, item), (6, None), (7, ""), (8, "The quick brown")]), bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.first_word) for r in got) == sorted([("5", 1, 0), ("5", 1, 22), ("None", 1, 0)] * 2)
    kept = d.without_contaminated(docs([(5, text), (None, item), (6, None), (7, "")]), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["6", "7"]  # rows go by row, a null id does not keep one


def test_blocks_and_empty_tables(docs, spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 60)
    items = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), BENCH)
    got = d.contaminated_passages(docs([(i, f"x y {t} z") for i, t in enumerate(items)]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(5)]
    assert d.contaminated_passages(docs([]), bench).count() == 0
    assert d.contaminated_passages(docs([(1, "x")]), bench.where("false")).count() == 0
    assert d.contaminated_passages(docs([(1, "ab cd")]), spark.createDataFrame([(1, "ab cd"), (2, "!!")], BENCH)).count() == 1


def test_rows_are_dropped_by_row_not_by_id(spark, docs):
    item = " ".join(f"item{i}" for i in range(30))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"a b {item}"), (None, "clean"), (7, f"{item} c"), (7, "also clean"), (8, None)]
    kept = d.without_contaminated(docs(rows), benchmark).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("7", "also clean"), ("8", "None"), ("None", "clean")]
