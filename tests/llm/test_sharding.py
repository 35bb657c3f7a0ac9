from collections import Counter

import pytest

from lendmend.llm import sharding

NAMES = [f"s{i}" for i in range(7)]


def test_shards_take_turns():
    """Against a plain reading of the rule: whole preference lists, one claim a turn."""
    import hashlib

    size = 101
    orders = []
    for name in NAMES:
        d = hashlib.md5(name.encode()).digest()
        at, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1
        orders.append([(at + k * skip) % size for k in range(size)])
    owner: dict[int, int] = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            if len(owner) < size:
                owner[next(s for s in order if s not in owner)] = i
    assert sharding.lookup(NAMES, size) == [owner[s] for s in range(size)]


def test_even_and_stable():
    full, less = sharding.lookup(NAMES), sharding.lookup(NAMES[:-1])
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 6)
    assert moved < 0.12 * len(full)
    heavy = Counter(sharding.lookup(["a", "b"], weights=[3, 1]))
    assert abs(heavy[0] / heavy[1] - 3) < 0.01


@pytest.mark.parametrize("args", [([], 101), (["a", "a"], 101), (["a"], 100), (["a", "b", "c"], 2)])
def test_bad_arguments(args):
    with pytest.raises(ValueError):
        sharding.lookup(*args)


def test_place_keeps_every_row(spark, docs):
    rows = [(1, "a"), (1, "a"), (None, None), (2, ""), (2**60, "x" * 1000)]
    given = docs(rows).withColumnRenamed("lang", "slot").withColumnRenamed("source", "owner")
    got = sharding.place(given, "doc_id", NAMES)
    assert got.columns == ["doc_id", "text", "owner", "n_chars", "slot", "shard"]
    found = got.collect()
    assert len(found) == 5 and all(r.shard in NAMES and 0 <= r.slot < sharding.SLOTS for r in found)
    assert len({(r.doc_id, r.slot, r.shard) for r in found}) == 4
    assert sharding.place(docs([]), "doc_id", NAMES).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan
