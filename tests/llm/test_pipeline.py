import random

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from lendmend.llm import queries
from workload.compare import connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    path = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, path).toPandas()
    want = connect(path).execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES if q != "pipeline"}
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]


@pytest.fixture(scope="module")
def planted(spark, saved):
    """Clean documents and one planted case of each kind for every stage."""
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    docs, labels = {}, []
    for i in range(400):
        docs[i] = "\n".join(prose(rng.randint(20, 60)) for _ in range(rng.randint(2, 6)))
    for i in range(1000, 1200):  # half of them labelled
        words = prose(80).split()
        for _ in range(4):
            words[rng.randrange(80)] = rng.choice(["idiot", "moron"])
        docs[i] = " ".join(words)
    labels = [(i, 1, 0) for i in range(300)] + [(i, 1, 1) for i in range(1000, 1100)]
    passage = prose(60)
    docs |= {2000: f"{prose(40)}\n{passage}\n{prose(30)}", 2001: f"{prose(40)}\n{passage}\n{prose(30)}"}
    docs[2100] = "\n".join(prose(40) for _ in range(4))
    words = docs[2100].split(" ")
    words[7], words[100] = "changed", "twice"
    docs[2101] = " ".join(words)
    docs[2102] = docs[2100]
    items = [prose(30) for _ in range(3)]
    copy = items[1].split()
    copy[4] = "edited"
    docs |= {2200: f"{prose(50)} {items[0]} {prose(20)}", 2201: f"{prose(50)} {' '.join(copy)}"}
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(None, None, None, None, None), (3000, "", "en", "s", 0)]
    path = saved(documents=(rows, DOCS), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(list(enumerate(items)), "item_id long, text string"))
    return path, docs


def test_each_stage_decides(spark, planted, tmp_path):
    path, docs = planted
    table = spark.read.parquet(f"{path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, path)
        if name != "packing":
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r for r in table.collect()}
    clean = set(range(400))
    assert all(clean <= set(rows) for rows in left.values())
    assert len({i for i in left["quality"] if i and 1000 <= i < 1200}) <= 10
    assert "2001" not in docs and left["line_dedup"][2000].text == docs[2000]
    assert left["line_dedup"][2001].text == "\n".join(docs[2001].split("\n")[::2])
    assert left["line_dedup"][2001].n_chars == len(left["line_dedup"][2001].text)
    assert 2102 not in left["line_dedup"]
    assert {2100, 2101} & set(left["near_dedup"]) == {2100}
    assert {2200, 2201} <= set(left["near_dedup"]) and not {2200, 2201} & set(left["decontaminate"])
    assert all(left["decontaminate"][i].text == docs[i] for i in clean)


def test_run_equals_its_stages(spark, planted):
    path, docs = planted
    rows = corpus_pipeline.run(spark, path).collect()
    assert set(range(400)) <= {r.doc_id for r in rows}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


def test_empty_tables(spark, saved):
    path = saved(documents=([], DOCS), labels=([], "doc_id long, quality int, toxic int"), benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0
