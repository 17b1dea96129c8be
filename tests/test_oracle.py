"""Every registered query against its DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from vitrine.plans import catalog
from vitrine.plans.fixtures import TABLES

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _sorted(rows):
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["p_type", "mean_extendedprice"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = _sorted([tuple(_norm(r[c]) for c in cols) for r in sdf.collect()])
    rel = con.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = _sorted([tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()])
    assert srows == drows
