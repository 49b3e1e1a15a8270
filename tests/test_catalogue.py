"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from factloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(rows):
    shown = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(shown, key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, tables, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = tables.sql(catalogue.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    other = [tuple(dict(zip(result.columns, r, strict=True))[c] for c in columns) for r in result.fetchall()]
    assert plain(frame.select(*columns).collect()) == plain(other)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).columns
