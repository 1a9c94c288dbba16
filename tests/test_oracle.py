"""Every registered query against its DuckDB oracle (row count, column names
and an order-insensitive value hash), on the smallest scale factor.  The
full sf0.01 sweep is ``python tools/oracle_check.py``."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from polyglint.plans.queries import QUERIES
from tools.oracle_check import TABLES, digest

ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle_or_is_rows_only():
    from polyglint.plans.queries import ROWS_ONLY
    assert set(QUERIES) == set(ORACLES) | ROWS_ONLY


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 13 and df.columns == ["dim_ord", "dimension", "P0", "P1", "P2", "P3", "total"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
