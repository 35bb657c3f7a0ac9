import random

import pytest

from lendmend.llm import line_dedup

W = 12


def brute(rows, least=W):
    """Deletes a shortest run of lines with ``least`` words whose lines occurred before, in order."""
    seen, gone = {}, [set() for _ in rows]
    for d, text in enumerate(rows):
        lines = [x.strip() for x in (text or "").split("\n")]
        words = [len(x.split()) for x in lines]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(words[i:j]) >= least:
                    seen.setdefault(tuple(lines[i:j]), (d, i, j))
                    first = seen[tuple(lines[i:j])]
                    if first[:2] != (d, i):
                        low = max(i, first[2]) if first[0] == d else i
                        gone[d] |= set(range(low, j))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in zip(rows, gone, strict=True)]


def sample():
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 2, 3, 6, 15])))
    shared = [[line() for _ in range(rng.randint(1, 8))] for _ in range(6)]
    out = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += [line() for _ in range(rng.randint(0, 4))]
            if rng.random() < 0.6:
                part = rng.choice(shared)
                a = rng.randrange(len(part))
                lines += part[a : a + rng.randint(1, 8)]
        out.append("\n".join(lines))
    return out + ["", None, "\n\n", "x " * 30, "x " * 30, "\n".join(["same line of words here"] * 12), " pad " + "y " * 20 + "\nend", "y " * 20]


def test_equals_brute_force(docs):
    given = sample()
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs(list(enumerate(given))).coalesce(1), least=W).collect()}
    want = brute(given)
    assert {i: got[i].text for i in got} == dict(enumerate(want))
    assert all(got[i].n_lines == (0 if t is None else t.count("\n") + 1) for i, t in enumerate(given))


@pytest.mark.parametrize("copies", [1, 2])
def test_long_passages(docs, copies):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"intro one\n{passage}\nends"), (2, f"other intro\n{passage}\nother end"), (3, "short line\nshort line")] * copies
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(docs(rows)).collect()]
    assert (2, "other intro\nother end", 1) in got and (3, "short line\nshort line", 0) in got
    assert (1, rows[0][1], 0) in got and len(got) == len(rows)


def test_edge_cases(spark, docs):
    assert line_dedup.drop_repeated_lines(docs([])).count() == 0
    from pyspark.sql import functions as F

    long = "z " * 60
    clash = docs([(None, long), (5, long), (5, None)]).withColumn("row", F.lit("r")).withColumn("cuts", F.lit("c")).withColumn("n_removed", F.lit("old"))
    got = line_dedup.drop_repeated_lines(clash)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "cuts", "n_lines", "n_removed"]
    assert sorted((str(r.doc_id), str(r.text).strip()[:1], r.n_removed, r.row, r.cuts) for r in got.collect()) == [
        ("5", "", 1, "r", "c"), ("5", "N", 0, "r", "c"), ("None", "z", 0, "r", "c"),
    ]
