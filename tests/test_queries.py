"""Every query against its SQL in DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

import docloom.queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return "None" if v != v else f"{v:.6g}"
        return f"{float(v):.6g}" if isinstance(v, int) and abs(v) < 1 << 40 else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, DATA)
    want = duck.sql(core.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)


def test_entry_without_what_the_corpus_operators_need(monkeypatch):
    """Any failing import there leaves the other queries."""
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "zstandard", None)
    for name in [m for m in sys.modules if m.startswith("docloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    assert set(__spark_entry__.queries()) == set(core.QUERIES) and set(__spark_entry__.oracle_sql()) == set(core.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
