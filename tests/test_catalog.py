"""Every registered query against its SQL twin on the smallest driver tables."""

from multiprocessing.pool import ThreadPool

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from tools.check import TABLES, table

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def results(spark):
    """Rows of every query; small jobs run a few at a time."""

    def run(name):
        try:
            df = QUERIES[name](spark, SF)
            return name, (df.columns, df.collect())
        except Exception as e:  # reported by the test of that query
            return name, e

    with ThreadPool(6) as pool:
        return dict(pool.map(run, sorted(ORACLES), chunksize=1))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(results, con, name):
    if isinstance(results[name], Exception):
        raise results[name]
    cols, mine = table(*results[name])
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want_cols, want = table(names, cur.fetchall())
    assert cols == want_cols
    assert mine == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == 72
