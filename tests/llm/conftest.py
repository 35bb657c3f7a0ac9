"""Shares the session of the other tests."""

import itertools

import pytest

from lendmend.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def saved(spark, tmp_path_factory):
    """Writes tables as Parquet into a new folder: saved(documents=(rows, schema), ...) -> folder."""

    def save(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return save


@pytest.fixture(scope="session")
def docs(spark, saved):
    """A documents table read back from Parquet: docs([(id, text), ...])."""

    def make(rows, schema=DOCS):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        return spark.read.parquet(f"{saved(documents=(full, schema))}/documents.parquet")

    return make


@pytest.fixture
def shifting(spark, monkeypatch):
    """Cuts tables into other splits after each copy that a module writes, as after a lost executor."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def shift(*modules):
        real, sizes = common.written, itertools.cycle(["600", before])

        def write(*args, **options):
            out = real(*args, **options)
            spark.conf.set(key, next(sizes))
            return out

        for module in (common, *modules):
            monkeypatch.setattr(module, "written", write)

    yield shift
    spark.conf.set(key, before)
