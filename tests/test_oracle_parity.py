"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same check at sf0.01), and entry() smoke."""

import math
import os

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as se
from earnlens.sources.tables import TABLES


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = se.entry(spark)
    assert df.count() > 0 and "mean_income" in df.columns


def test_every_oracle_key_is_a_query():
    assert set(se.oracle_sql()) <= set(se.queries())


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_oracle(spark, duck, name):
    df = se.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(se.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, s_rows) == _rows(d_cols, res.fetchall())
