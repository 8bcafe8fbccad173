"""Every registered query against its DuckDB statement (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from packetlake.plans import catalog
from tests.conftest import SF001
from tools.check_oracle import TABLES, TYPE_PAIRS, canon

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    types = {c[0]: str(c[1]) for c in res.description}
    expected = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert {f.name: TYPE_PAIRS.get(f.dataType.simpleString()) for f in df.schema.fields} == types
    assert len(rows) == len(expected)
    assert canon(df.columns, rows) == canon(cols, expected)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["index", "timestamp"] and df.count() >= 0
