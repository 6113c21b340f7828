"""Every registered query of the library against its DuckDB equivalent on the smallest tables."""

import duckdb
import pytest

from tamarack.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return int(v) if v == int(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(core.queries()))
def test_query(spark, sf, duck, name):
    frame = core.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["uid", "q", "a"]
    assert set(core.oracle_sql()) <= set(__spark_entry__.queries())
