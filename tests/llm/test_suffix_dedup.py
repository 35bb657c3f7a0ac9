import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lendmend.llm import queries, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, length=200):
    """(remaining bytes, removed, maximal removed runs) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(b for b, g in zip(x, gone, strict=True) if not g), sum(gone), runs))
    return out


def texts():
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefg hijklm") for _ in range(n))
    shared = [some(n) for n in (199, 200, 201, 260, 700, 1500)]
    out = []
    for _ in range(50):
        t = some(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(shared) + some(rng.randint(0, 60))
        out.append(t)
    out += ["", None, "a" * 1000, "a" * 150, "ab" * 400, "a" * 450 + "b", "é" * 300, "é" * 99 + "x" + "é" * 101]
    return out + [out[5], out[5][:300], out[6][3:], "Queon " * 90, shared[3][:250] + shared[4][:230]]


def test_query_equals_brute_force(spark, saved):
    given = texts()
    path = saved(documents=([(i, t, "en", "s", 1) for i, t in enumerate(given)], DOCS))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, path).collect()}
    want = brute(given)
    assert got == {i: (len((t or "").encode()), n, k, hashlib.sha256(x).hexdigest()) for i, (t, (x, n, k)) in enumerate(zip(given, want, strict=True))}


@pytest.mark.parametrize(("hot", "run_bytes"), [(1, 24_000_000), (200_000, 20_000)])
def test_hot_suffixes_and_many_runs(docs, monkeypatch, hot, run_bytes):
    """Dealt by string position, and with many small runs to merge."""
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run_bytes)
    given = texts()
    got = {r.id: bytes(r.kept) for r in suffix_dedup.drop_repeated_bytes(docs(list(enumerate(given))), hot=hot).collect()}
    assert got == {i: x for i, (x, _, _) in enumerate(brute(given))}


def test_edge_cases(docs):
    long = "".join(random.Random(1).choice("xyz ") for _ in range(300))
    got = suffix_dedup.drop_repeated_bytes(docs([(None, long), (7, long), (7, "alone"), (8, "")])).collect()
    assert sorted((str(r.id), r.n_removed) for r in got) == [("7", 0), ("7", 300), ("8", 0), ("None", 300)]
    assert suffix_dedup.drop_repeated_bytes(docs([])).count() == 0
    assert suffix_dedup.drop_repeated_bytes(docs([(1, None)])).first().n_bytes == 0


def test_merge_is_ordered_and_prefixes_are_right():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    parts = [sorted(keys[k::7]) for k in range(7)]
    runs = [(p, [0, *(suffix_dedup._common(a, b, 0) for a, b in zip(p, p[1:], strict=False))]) for p in parts]
    order = list(suffix_dedup.merged(runs))
    got = [runs[r][0][i] for r, i, _ in order]
    assert got == sorted(keys)
    assert [k for *_, k in order[1:]] == [suffix_dedup._common(a, b, 0) for a, b in zip(got, got[1:], strict=False)]
    for p in parts:
        assert suffix_dedup.decoded(*suffix_dedup.front_coded(p)) == p


def test_repeats_are_cut_where_splits_shift(docs, shifting):
    shifting(suffix_dedup)
    rows = [(i, "".join(f"w{i % 20}.{k} " for k in range(60)) if i % 2 else f"lone {i}") for i in range(40)]
    got = {r.id: r.n_removed for r in suffix_dedup.drop_repeated_bytes(docs(rows)).collect()}
    assert got == {i: len(t) if i % 2 else 0 for i, t in rows}


def test_merge_groups_grow_with_the_repeated_suffixes(spark, docs, monkeypatch):
    asked = []
    real = suffix_dedup._sorted_runs
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "_sorted_runs", lambda *args: asked.append(args[2]) or real(*args))
    text = " ".join(f"w{k}" for k in range(2000))
    got = suffix_dedup.drop_repeated_bytes(docs([(1, text), (2, text), (3, "lone")])).collect()
    assert {r.id: r.n_removed for r in got} == {1: len(text), 2: len(text), 3: 0}
    assert asked[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_equal_keys_of_unlike_strings_do_not_count():
    """Keys only bring strings together; their bytes decide."""
    right = np.array([1, 1, 1, 2, 3, 3])
    left = np.array([[1, 2], [1, 3], [1, 2], [1, 2], [5, 5], [5, 5]], np.uint8)
    rows = np.arange(6)
    want = [True, False, True, False, True, True]
    assert suffix_dedup._twice(np.zeros(6, np.uint64), right, left, rows).tolist() == want
    own = np.array([7, 8, 7, 9, 4, 4], np.uint64)
    assert suffix_dedup._twice(own, right, left, rows).tolist() == want
    assert suffix_dedup._twice(own[:0], right[:0], left, rows[:0]).tolist() == []
