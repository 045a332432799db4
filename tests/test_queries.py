"""Every registered query against its SQL twin on the given tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lakewright.sources.tables import TABLES

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = _sorted(df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLES:
        assert rows
        return
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == _sorted([r[i] for i in at] for r in found.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "method" and df.count() == 5


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
