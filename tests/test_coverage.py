"""Every operator of the inventory is registered, or covered by a test named here."""

from workload.catalog import REGISTRY

COUNTS = {"S": 13, "P": 13, "J": 10, "A": 21, "W": 12, "U": 3, "F": 18, "E": 12, "R": 16, "M": 19, "C": 13, "T": 9, "G": 2}

# Sinks that need a database: see test_sources.py.
BY_TEST = {
    "S4": "test_jdbc_options", "S13": "test_jdbc_options",
    "S11": "test_relational_sink_skips_rows_already_there",
}


def test_every_operator_is_covered():
    wanted = {f"{k}{i}" for k, n in COUNTS.items() for i in range(1, n + 1)}
    have = {i for q in REGISTRY.values() for i in q.ids.split()} | set(BY_TEST)
    assert len(wanted) == 161
    assert wanted - have == set() and have - wanted == set()


def test_named_tests_exist():
    import test_sources
    import test_streaming

    assert all(hasattr(test_sources, name) or hasattr(test_streaming, name) for name in BY_TEST.values())
