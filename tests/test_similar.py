import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lendmend.operators.customers import case_vote
from lendmend.operators.factors import dense_ids, weighted_value
from lendmend.operators import similar as S
from lendmend.operators.similar import probed_share, similar, similar_probed, top_k_similar
from lendmend.sources.zones import shared_dir


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame(
        [(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "customer_id bigint, v array<double>"
    )


def brute(q, qid, c, cid, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sim = unit(q) @ unit(c).T
    out = set()
    for i, row in zip(qid, sim):
        near = sorted(((round(-s, 9), j) for s, j in zip(row, cid) if j != i))[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("cells", [(10_000, 10_000), (40, 10_000), (40, 60), (7, 30)])
def test_every_layout_is_exact(spark, cells):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    x = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8))
    x[:100] = centres[0] + rng.normal(size=(100, 8)) * 0.2  # a third in one spot
    df = table(spark, x)
    got = similar(df, df, "v", 4, block_rows=cells[0], cell_rows=cells[1])
    assert {(r["customer_id"], r["neighbour"], r["rank"]) for r in got.collect()} == brute(
        x, range(300), x, range(300), 4
    )


def test_probed_cells(spark):
    """In clusters a few cells hold the neighbours; with all cells probed the answer is the exact one."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 16))
    x[:400] = centres[0] + rng.normal(size=(400, 16))  # a third in one cluster
    df = table(spark, x)
    triples = lambda got: {(r["customer_id"], r["neighbour"], r["rank"]) for r in got.collect()}
    exact = brute(x, range(1200), x, range(1200), 5)
    few = triples(similar_probed(df, df, "v", 5, probes=4, cell_rows=30, block_rows=64))
    pairs = lambda t: {(a, b) for a, b, _ in t}
    assert len(pairs(few) & pairs(exact)) >= 0.95 * len(exact)
    assert probed_share(df, df, "v", probes=4, cell_rows=30) < 0.25
    assert triples(similar_probed(df, df, "v", 5, probes=40, cell_rows=30, block_rows=64)) == exact
    assert triples(similar_probed(df, df, "v", 5, probes=1, cell_rows=5000)) == exact
    assert similar_probed(df.limit(0), df, "v", 5, cell_rows=30).isEmpty() and similar_probed(df, df.limit(0), "v", 5).isEmpty()


def test_fewer_candidates_than_k(spark):
    q, c = table(spark, [[1.0, 0.0]], [9]), table(spark, [[1.0, 1.0], [0.0, 1.0]], [1, 2])
    got = [(r["neighbour"], round(r["similarity"], 6)) for r in similar(q, c, "v", 5).collect()]
    assert sorted(got) == [(1, 0.707107), (2, 0.0)]


def test_zero_vectors_do_not_lose_neighbours(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.zeros((1, 4)), rng.normal(size=(80, 4))])
    got = similar(table(spark, x[:1]), table(spark, x), "v", 3, block_rows=10, cell_rows=20)
    assert sorted(r["neighbour"] for r in got.collect()) == [1, 2, 3]


def test_ties_go_to_the_smaller_id(spark):
    df = table(spark, [[1.0, 0.0]] * 5)
    got = similar(df, df, "v", 2)
    assert {r["neighbour"] for r in got.where("customer_id = 4").collect()} == {0, 1}
    again = top_k_similar(similar(df, df, "v", 4).drop("rank"), 1)
    assert {(r["customer_id"], r["neighbour"]) for r in again.collect()} == {
        (0, 1), (1, 0), (2, 0), (3, 0), (4, 0)
    }


def test_pairs_of_blocks_are_not_shuffled_and_copies_go(spark):
    """Only the result stays on disk, and each vector is moved once for all the blocks it meets."""
    rng = np.random.default_rng(6)
    df = table(spark, rng.normal(size=(120, 4)))
    packed = S._packed(S._vectors(df, "customer_id", "v").withColumns({"_cell": F.lit(0), "_block": F.lit(0)}), 20, "test-blocks")
    assert packed.count() >= 6
    plan = S._search(packed, packed, 3, ("float64", "float64"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    had = set(os.listdir(shared_dir(spark)))
    similar(df, df, "v", 3, cell_rows=30).count()
    similar_probed(df, df, "v", 3, probes=2, cell_rows=30).count()
    left = set(os.listdir(shared_dir(spark))) - had
    assert sorted(name.rsplit("-", 1)[0] for name in left) == ["probed", "similar"]


@pytest.mark.parametrize("cell_rows", [10_000, 40])
def test_repeated_ids_and_vectors_without_numbers(spark, cell_rows):
    """A repeated id is asked for each of its rows and is no neighbour of itself; what has no direction is left out."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4))
    ids = [i // 2 for i in range(90)]  # each id has two vectors
    odd = spark.createDataFrame(
        [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan"), 1.0, 0.0, 0.0])], "customer_id bigint, v array<double>"
    )
    df = table(spark, x, ids).unionByName(odd)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(45):
        rows = [(round(-s, 9), ids[j]) for a in (2 * i, 2 * i + 1) for j, s in enumerate(unit[a] @ unit.T) if ids[j] != i]
        want |= {(i, j, round(-s, 6), r + 1) for r, (s, j) in enumerate(sorted(rows)[:3])}
    got = similar(df, df, "v", 3, block_rows=16, cell_rows=cell_rows).collect()
    assert {(r["customer_id"], r["neighbour"], round(r["similarity"], 6), r["rank"]) for r in got} == want


def test_many_equal_vectors_go_by_id(spark):
    """A tile of equals is cut by id, and what is above them stays."""
    x = np.tile([[3.0, 1.0, 2.0]], (700, 1))
    x[650] = [3.0, 1.0, 2.1]
    vecs = S._units(x)
    top = S._Top(pa.array([-1]), S._units(np.array([[3.0, 1.0, 2.2]])), None, 4)
    top.meet(pa.array(np.arange(700)), vecs, np.arange(1))
    assert top.result().column("_cid").to_pylist() == [650, 0, 1, 2]


def test_names_and_null_ids(spark):
    """Ids of any type; a null id is asked as well, and is no other's."""
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), (None, [1.0, 0.2]), ("d", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "customer_id string, v array<float>")
    got = {(r["customer_id"], r["neighbour"]) for r in similar(df, df, "v", 1).collect()}
    assert got >= {("a", "b"), ("d", None)} and {x for x, _ in got} == {"a", "b", None, "d"}


def test_weighted_value(spark):
    near = spark.createDataFrame(
        [("t", "a", 0.5), ("t", "b", 0.25), ("t", "c", 0.25), ("t", "d", -0.9)],
        "customer_id string, neighbour string, similarity double",
    )
    seen = spark.createDataFrame(
        [("a", "s", 700.0), ("b", "s", 600.0), ("c", "s", 650.0), ("d", "s", 1.0)],
        "customer_id string, feature string, value double",
    )
    assert weighted_value(near, seen).first()["value"] == pytest.approx(662.5)


@pytest.mark.parametrize("bad, advice", [(1, "approve"), (2, "review"), (3, "caution")])
def test_votes(spark, bad, advice):
    df = spark.createDataFrame(
        [("t", 1 if i < bad else 0) for i in range(5)], "customer_id string, loan_default int"
    )
    assert case_vote(df).first()["advice"] == advice


def test_dense_ids(spark):
    df = spark.range(0, 5000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("customer_id"))
    got = sorted(r["user"] for r in dense_ids(df, buckets=16).collect())
    assert got == list(range(df.count()))
