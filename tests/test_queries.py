"""Every query that has SQL against DuckDB over the same tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from graftwork import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = plans.queries()[name](spark, SF)
    want = db.sql(plans.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    place = [want.columns.index(c) for c in order]
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=str)
    assert a == b


def test_all_have_sql_or_are_known():
    assert set(plans.oracle_sql()) <= set(plans.queries())
    assert set(driver.queries()) >= set(plans.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
