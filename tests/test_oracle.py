"""Every registered query that has oracle SQL, at the smallest scale."""

import pytest

from workload.catalog import REGISTRY
from workload.compare import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = [n for n, q in REGISTRY.items() if q.sql is not None]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, duck, name):
    verdict, detail, _ = compare(spark, duck, SF, REGISTRY[name])
    assert verdict == "ok", detail


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
