"""Every query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tests.conftest import DATA
from tidemark.plans import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = core.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    out = db.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in out.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_others_run(spark, name):
    assert core.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == core.POINT
    assert set(e.oracle_sql()) <= set(e.queries())
