"""Every query without a hidden table against its SQL, on the smallest tables, where they are there."""

import os

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def registries():
    from importlib import import_module

    import __spark_entry__ as e

    return [import_module(m) for m in e.MODULES]


def names():
    return sorted(n for m in registries() for n in m.SQL)


@pytest.fixture(scope="module")
def con():
    import duckdb

    from compare import TABLES

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{D}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names() if os.path.isdir(D) else [])
def test_query_equals_sql(spark, con, name):
    from compare import tidy

    query = next(m.QUERIES[name] for m in registries() if name in m.QUERIES)
    sql = next(m.SQL[name] for m in registries() if name in m.SQL)
    got, want = tidy(query(spark, D).toPandas()), tidy(con.execute(sql).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_egress_below_a_registered_suffix(spark, monkeypatch):
    from nichelens.plans import signal_queries

    urls = ["https://a.example/x", "https://x.a.example/", "https://x.y.b.example/", "https://b.example/", None]
    monkeypatch.setattr(signal_queries, "lake", lambda *_: spark.createDataFrame([("s", u) for u in urls], "source_id string, url string"))
    monkeypatch.setattr(signal_queries, "table", lambda *_: spark.createDataFrame([(["a.example", "*.b.example", "*.y.b.example"],)], "domains array<string>"))
    assert [tuple(r) for r in signal_queries.egress_allowed(spark, "").collect()] == [("s", 5, 4, 2)]
