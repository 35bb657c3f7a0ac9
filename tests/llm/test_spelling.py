import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lendmend.llm import spelling
from lendmend.llm.queries import op13_spelling

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for word in WORD.findall(text or ""):
            word = word.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def words(seed, count):
    """Words that are edits of few stems, with a wide range of frequencies."""
    rng = random.Random(seed)
    letters = "abcdeéÿ÷ß"
    stems = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(40)] + ["aaaaaaa", "a" * 80]
    out = []
    for _ in range(count):
        w = rng.choice(stems[: rng.randint(1, len(stems))])
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        out.append(w)
    return out


def documents(seed):
    rng, every = random.Random(seed), words(seed, 12_000)
    rows = []
    while every:
        k = rng.randint(1, 200)
        rows.append((len(rows), rng.choice([" ", ", ", "1", "\n"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in every[:k])))
        every = every[k:]
    rows += [rows[3]] * 30 + [(None, rows[4][1]), (900, None), (901, ""), (902, "Ābc Ăbcde naïveté — ÉCOLE École 中文 abcdeŒabcde"), (903, "x" * 300_000)]
    return rows


def test_equals_brute_force(docs):
    rows = documents(1)
    got = sorted((tuple(r) for r in spelling.spelling_variants(docs(rows)).collect()), key=lambda r: r[0])
    assert got == brute(rows)
    assert any(r[2] not in (r[0], r[1]) and r[1] for r in got), "some way has two steps"


def test_small_cells_and_leaves(docs, monkeypatch):
    rows = documents(2)
    monkeypatch.setattr(spelling, "PER_CELL", 8)
    monkeypatch.setattr(spelling, "CELL", 8)
    got = sorted((tuple(r) for r in spelling.spelling_variants(docs(rows)).collect()), key=lambda r: r[0])
    assert got == brute(rows)


def test_a_length_outside_the_sample_and_empty_cells(docs, monkeypatch):
    rows = documents(3)
    real = spelling.split_trees

    def other(found):
        trees = real(found)
        trees.pop(6, None)
        trees[7] = (ord("z"), 3, 0, (ord("a"), 2, 1, 2))
        return trees

    monkeypatch.setattr(spelling, "split_trees", other)
    got = sorted((tuple(r) for r in spelling.spelling_variants(docs(rows)).collect()), key=lambda r: r[0])
    assert got == brute(rows)


def test_box_pruning_reaches_every_leaf_within_the_radius():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, (500, 6)).astype(np.int32)
    tree = spelling.grow(counts, np.arange(500), 8)
    for radius in (0, 1, 2):
        found = {(int(q), int(p)) for leaf, rows in spelling.reached(tree, counts[:50], radius) for q in rows for p in leaf}
        far = np.abs(counts[:50, None] - counts[None]).sum(2)
        assert {(int(q), int(p)) for q, p in zip(*np.nonzero(far <= radius), strict=True)} <= found
        assert len(found) < 50 * 500


def test_anagrams_share_a_leaf():
    same = ["abcde", "abced", "edcba"] * 50
    counts = spelling.letter_counts(spelling.coded(same))
    assert len(spelling.grow(counts, np.arange(150), 8)) == 150
    cell = spelling.Cell(same, [1] * 150)
    assert len(cell.near(spelling.coded(["abcde"]))[0]) == 0
    assert len(cell.near(spelling.coded(["abcdx"]))[0]) == 50
    assert len(cell.near(spelling.coded(["abcdee", "xabcde"]))[0]) == 100


def test_runs_of_sliced_texts():
    texts = pa.array(["drop", "Ab1cÄ", None, "é×÷ÿĀz"], pa.string())
    found = [[w for w in x if w] for x in spelling.runs(texts.slice(1)).to_pylist()]
    assert found == [["ab", "cÄ"], [], ["é×÷ÿ", "z"]]


def test_query(spark, saved):
    text = "hello hello hello hello hello hello hallo hallo hallo hallow hallow hallow"
    path = saved(documents=([(1, text, 5, "w"), (2, None, 1, None)], "doc_id long, text string, n long, word string"))
    got = op13_spelling(spark, path)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute([(1, text)])
    assert op13_spelling(spark, saved(documents=([], "doc_id long, text string"))).collect() == []
