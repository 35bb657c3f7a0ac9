import math
import random

from lendmend.llm import queries, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, divisor=50, k=5):
    import numpy as np

    valid = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(valid):
        if i % divisor == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in valid if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_query_equals_brute_force(spark, saved, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(8)], 0) for i in range(301)]
    rows += [(400, None, 0), (450, [1.0, None] + [0.0] * 6, 0), (500, [float("nan")] * 8, 0), (550, [float("inf")] + [0.0] * 7, 0)]
    rows += [(600, [0.0] * 8, 0), (601, rows[7][1], 0), (602, rows[7][1], 0), (None, rows[7][1], 0)]  # ties and zeros
    got = queries.op7_top_k(spark, saved(embeddings=(rows, VECTORS)))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_rows_and_repeats(spark, saved):
    assert queries.op7_top_k(spark, saved(embeddings=([], VECTORS))).count() == 0
    assert queries.op7_top_k(spark, saved(embeddings=([(0, [1.0], 1)], VECTORS))).count() == 0
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (3, [], 1), (4, [0.5], 1)]
    got = sorted(map(tuple, queries.op7_top_k(spark, saved(embeddings=(rows, VECTORS))).collect()))
    assert got == sorted([(0, 1, 4, 32768), (0, 2, 3, 0)] * 2)


def test_large_numbers_stay_exact(spark):
    rows = [(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [-1e6, 0.0]), (3, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 1, 256**2 * (10**12 + 3)), (0, 3, 2, -(256**2) * 10**12)]


def test_components_beyond_32_bits_take_part(spark, saved, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    rng = random.Random(2)
    rows = [(i, [rng.choice([9e6, -9e6, 0.5, 0.0]), rng.choice([0.5, -3.0, 1.0])], 0) for i in range(120)]
    got = queries.op7_top_k(spark, saved(embeddings=(rows, VECTORS)))
    assert sorted(map(tuple, got.collect())) == brute(rows)
