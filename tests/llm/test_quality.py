import random

from pyspark.sql import functions as F

from lendmend.llm import quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    """Good prose, junk of marks, and prose with insults; labels for two thirds."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(800)]
    docs, labels, bad = [], [], set()
    for i in range(n):
        kind = rng.choice(["good"] * 6 + ["junk", "toxic"])
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if kind == "junk":
            text = [w + rng.choice(["%%%", "$$$", "|"]) for w in text]
        if kind == "toxic":
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["idiot", "moron", "scum"])
        bad |= {i} if kind != "good" else set()
        source = "spam" if kind == "junk" and rng.random() < 0.8 else rng.choice("abc")
        docs.append((i, " ".join(text), "en", source, 400))
        if i % 3:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels, bad


def test_held_out_accuracy(spark, saved):
    docs, labels, bad = corpus()
    path = saved(documents=(docs, DOCS), labels=(labels, LABELS))
    got = {r.doc_id: r for r in queries.op6_quality(spark, path).collect()}
    assert len(got) == len(docs)
    unseen = [i for i in got if not i % 3]
    right = [got[i].keep == (i not in bad) for i in unseen]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= x <= 1 for r in got.values() for x in (r.p_text, r.p_meta, r.p_bad))
    # The metadata view learnt what junk's source tells.
    spam = [r.p_meta for i, r in got.items() if docs[i][3] == "spam"]
    assert min(spam) > max(r.p_meta for i, r in got.items() if docs[i][3] != "spam")


def test_pseudo_labels_change_the_other_view(spark, saved):
    docs, labels, _ = corpus()
    path = saved(documents=(docs, DOCS), labels=(labels, LABELS))
    tables = [spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels")]
    alone, together = (
        {r.id: r.p_text for r in quality.score_documents(*tables, rounds=n).collect()} for n in (0, 2)
    )
    assert any(abs(alone[i] - together[i]) > 1e-9 for i in alone)


def test_edge_rows_are_scored(spark, saved):
    docs, labels, _ = corpus()
    odd = [(5000, None, None, None, None), (5001, "", "en", "a", 0), (None, "word1 word2", "en", "a", 9), (1, docs[1][1], "en", "a", 9), (5002, "word3 " * 100_000, "en", "a", 1)]
    labels += [(None, 1, 0), (5000, None, 1), (1, 0, 0)]
    path = saved(documents=(docs + odd, DOCS), labels=(labels, LABELS))
    got = queries.op6_quality(spark, path).collect()
    assert len(got) == len(docs) + 5 and all(r.p_bad is not None and r.keep is not None for r in got)


def test_without_labels_all_stay(spark, saved):
    docs, labels, _ = corpus(60)
    for given in ([], [x for x in labels if x[1] == 1 and x[2] == 0]):
        path = saved(documents=(docs, DOCS), labels=(given, LABELS))
        got = queries.op6_quality(spark, path).collect()
        assert len(got) == 60 and all(r.keep and r.p_bad is None for r in got)
    empty = saved(documents=([], DOCS), labels=(labels, LABELS))
    assert queries.op6_quality(spark, empty).count() == 0


def test_keep_good_keeps_columns(spark, saved):
    docs, labels, bad = corpus()
    path = saved(documents=(docs, DOCS), labels=(labels, LABELS))
    tables = [spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels")]
    kept = quality.keep_good(tables[0].withColumn("row", F.lit("own")), tables[1])
    assert kept.columns == [*tables[0].columns, "row"]
    rows = kept.collect()
    assert len({r.doc_id for r in rows} & bad) < 0.05 * len(bad) and {r.row for r in rows} == {"own"}


def test_keep_good_where_splits_shift(spark, saved, shifting):
    docs, labels, bad = corpus()
    path = saved(documents=(docs, DOCS), labels=(labels, LABELS))
    tables = [spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels")]
    shifting(quality)
    kept = {r.doc_id for r in quality.keep_good(*tables, rounds=0).collect()}
    assert len(kept & bad) < 0.05 * len(bad) and len(kept - bad) > 0.95 * (len(docs) - len(bad))
