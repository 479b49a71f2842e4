"""Every registered query against its SQL twin, and what no plan may contain."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
STREAMED = [n for n in QUERIES if n.endswith("_stream")]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    rel = duck.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["seed_id", "song_id"] and df.count() > 0
