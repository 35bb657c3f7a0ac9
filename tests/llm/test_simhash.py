import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lendmend.llm import queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts):
    fps = []
    for text in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)))
    root = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    return fps, root


def test_query_equals_brute_force(spark, saved):
    base = " ".join(f"word{i}" for i in range(90))
    texts = [base, base + " x", base.upper(), None, "", " \t\n", "one", "One", "été ÉTÉ", "a b c d", base * 3, base + " y z"]
    texts += [base.replace(f"word{i} ", "") for i in (3, 40, 77)] + ["z" * 50_000, "q w " * 20_000]
    got = queries.op1_simhash(spark, saved(documents=([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)))
    fps, root = brute(texts)
    assert sorted(map(tuple, got.collect())) == [(i, f"{fps[i]:016x}", root[i]) for i in range(len(texts))]


def test_empty_table_and_null_ids(spark, saved):
    assert queries.op1_simhash(spark, saved(documents=([], DOCS))).count() == 0
    rows = [(None, "a b", None, None, None), (4, "a b", None, None, None), (4, "a b", None, None, None)]
    got = queries.op1_simhash(spark, saved(documents=(rows, DOCS))).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {4}


@pytest.mark.parametrize("most", [2_000_000, 30_000])
def test_links_of_near_fingerprints(spark, monkeypatch, most):
    """A chain in steps of four bits, a dense ball, and strangers; also with every bucket dealt again."""
    import random

    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(5)
    chain = [rng.getrandbits(64)]
    for k in range(8):
        flips = sum(1 << i for i in rng.sample(range(64), 4))
        chain.append(chain[-1] ^ flips)
    ball = [centre := rng.getrandbits(64), *(centre ^ (1 << i) ^ (1 << (i * 7 + 3) % 64) for i in range(40))]
    lone = [rng.getrandbits(64) for _ in range(50)]
    rows = [(x - (x >> 63 << 64),) for x in {*chain, *ball, *lone}]
    links = simhash.ball_links(spark.createDataFrame(rows, "fp long"))
    got = {r.node: r.root for r in simhash.components(links).collect()}
    same = lambda xs: {got.get(x - (x >> 63 << 64)) for x in xs}
    assert len(same(chain)) == len(same(ball)) == 1 and same(chain) != same(ball)
    assert len(got) == len({*chain, *ball})


def edited(rng, text, words):
    out = text.split()
    for i in rng.sample(range(len(out)), words):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def test_near_duplicates_equal_brute_force(docs):
    """Near copies at a similarity of 0.8 and more are grouped, others are not."""
    import random

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(12)]
    texts += [edited(rng, texts[k % 4], 1 + k % 4) for k in range(16)]
    texts += [edited(rng, texts[5], 60), texts[6].upper(), texts[6].replace(" ", "\n"), None, "", "short text", "short text two"]
    got = {r.id: r for r in simhash.near_duplicates(docs(list(enumerate(texts)))).collect()}
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(shingles):
            for j, y in enumerate(shingles):
                if len(x & y) >= 0.8 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: r.group for i, r in got.items()} == dict(enumerate(root))
    assert {i for i, r in got.items() if r.keep} == set(root)


def groups_by_brute_force(texts):
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i, x in enumerate(shingles):
        for j, y in enumerate(shingles[:i]):
            if root[i] != root[j] and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def test_near_copies_behind_an_unlike_text_of_the_same_words(docs):
    """Equal word sets: the first text is unlike both later ones, which are near copies of each other."""
    words = [f"w{i}" for i in range(200)]
    near = [*reversed(words)]
    moved = [*near[:100], near[101], near[100], *near[102:]]
    texts = [" ".join(x) for x in (words, near, moved)]
    got = {r.id: r.group for r in simhash.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert got == groups_by_brute_force(texts) == {0: 0, 1: 1, 2: 1}


def test_near_copies_just_above_the_similarity(docs):
    import random

    rng = random.Random(3)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(words)
        for i in (20, 70, 120, 170):
            other[i] = f"new{rng.random()}"
        texts += [" ".join(words), " ".join(other)]
    got = {r.id: r.group for r in simhash.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert got == groups_by_brute_force(texts) and len(set(got.values())) == 150


def test_near_copies_among_pages_of_a_template(docs, monkeypatch):
    """All pages share shingles of their prefixes, and most centres are unlike most members."""
    import random

    monkeypatch.setattr(simhash, "FREQUENT", 1 << 40)
    monkeypatch.setattr(simhash, "CENTRES", 2)
    rng = random.Random(4)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for k in range(20):
        own = [f"p{k}.{i}" for i in range(25)]
        texts.append(" ".join(template + own))
        for step in range(k % 4):  # chains: each a near copy of the one before
            own[4 * step + 2] = f"new{rng.random()}"
            texts.append(" ".join(template + own))
    rng.shuffle(texts)
    got = {r.id: r.group for r in simhash.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert got == groups_by_brute_force(texts) and len(set(got.values())) == 20


def test_near_copies_are_found_by_ball_hashing(docs, monkeypatch):
    """Without any prefix, texts at most four bits apart are still grouped, and unlike ones are not."""
    import random

    real = simhash._prefixes

    def no_tokens(*args):
        run = real(*args)

        def without(batches):
            for batch in run(batches):
                none = pa.array([[]] * len(batch), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], none], batch.schema.names)

        return without

    monkeypatch.setattr(simhash, "_prefixes", no_tokens)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(600)) for _ in range(20)]
    texts += [f"{t} one more" for t in texts[:10]]
    texts += ["same " * 50 + " ".join(f"a{i}" for i in range(30)), "same " * 50 + " ".join(f"b{i}" for i in range(30))]  # one fingerprint
    near = {i + 20 for i in range(10) if (fp(texts[i]) ^ fp(texts[i + 20])).bit_count() <= 4}
    assert len(near) >= 8 and fp(texts[-1]) == fp(texts[-2])
    got = {r.id: r.group for r in simhash.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert got == {i: i - 20 if i in near else i for i in range(len(texts))}


def fp(text, size=5):
    words = text.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_near_duplicates_edge_cases(spark, docs):
    rows = [(None, "a b c"), (3, "a b c"), (3, "A b  c"), (1, None), (2, "")]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert sorted((str(r.id), r.keep) for r in got) == [("1", True), ("2", False), ("3", False), ("3", False), ("None", True)]
    assert simhash.near_duplicates(docs([])).count() == 0
    kept = simhash.drop_near_duplicates(docs(rows).withColumn("row", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("keep", F.lit(0)))
    assert kept.count() == 2 and kept.columns[-3:] == ["row", "fp", "keep"]


def test_copies_are_dropped_where_splits_shift(docs, shifting):
    shifting(simhash)
    rows = [(i, " ".join(f"w{i % 20}.{k}" for k in range(30))) for i in range(40)]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs(rows)).collect()) == list(range(20))


def counted(texts):
    """(bins, shingles) of each text, as the pairs are given them."""

    class shared:
        value = (pa.array([], pa.uint64()).to_numpy(), pa.array([], pa.int64()).to_numpy())

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], ["row", "text"])
    (out,) = simhash._prefixes(5, 0.8, shared)([batch])
    return out.column("bins")


def pairs_left(texts, pairs):
    bins = counted(texts)
    a, b = (pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1))
    batch = pa.RecordBatch.from_arrays([a, b, bins.take(a), bins.take(b)], ["a", "b", "x", "y"])
    (out,) = simhash._possible(0.8)([batch])
    return list(zip(*(out.column(c).to_pylist() for c in "ab"), strict=True))


def test_counts_rule_out_long_unlike_texts():
    """The whole sets of such pairs are not to be shuffled; by 128 counts, any texts of 5000 shingles look alike."""
    import random

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(n)) for n in (300, 300, 1000, 1000, 5000, 5000, 5000, 20_000, 20_000)]
    unlike = [(0, 1), (2, 3), (4, 5), (5, 6), (7, 8), (0, 8)]
    texts += [edited(rng, t, len(t.split()) // 100) for t in texts]
    near = [(i, i + 9) for i in range(9)]
    assert pairs_left(texts, unlike + near) == near


def test_counts_of_different_numbers_of_bins():
    """Near copies on either side of a step of the number of bins stay; a full bin rules nothing out."""
    import random

    rng = random.Random(7)
    texts, near = [], []
    for n in (250, 300, 500, 600, 1000, 1200, 4000, 4600):
        words = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        near.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(words[: int(0.83 * n)])]
    assert {len(x) != len(y) for x, y in (counted([texts[a], texts[b]]).to_pylist() for a, b in near)} == {True, False}
    assert pairs_left(texts, near) == near
    full = pa.array([bytes([255] * 128), bytes(128)])
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), full.take([0]), full.take([1])], ["a", "b", "x", "y"])
    assert [len(b) for b in simhash._possible(0.8)([batch])] == [1]


def test_copies_on_the_way_are_deleted(spark, docs):
    """The caller's write needs the numbered rows and the list of copies only."""
    import os

    from lendmend.llm import common

    given = docs([(i, " ".join(f"w{i % 6}.{k}" for k in range(40)) + f" x{i}") for i in range(18)])
    begin = common.mark()
    out = simhash.drop_near_duplicates(given)
    left = [f for f in common.since(begin) if os.path.exists(f.removeprefix("file:").replace("//", "/"))]
    assert sorted(os.path.basename(f).split("-")[1] for f in left) == ["copies", "rows"]
    assert sorted(r.doc_id for r in out.collect()) == list(range(6))


def test_shuffles_are_freed_inside_only(spark):
    from lendmend.llm import common

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    with common.shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
