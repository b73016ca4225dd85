"""Every registered query against its DuckDB twin; those without one must run and keep their columns."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def one(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if isinstance(v, int) else str(v)


def rows(pdf):
    cols = [[one(v) for v in pdf[c].astype(object)] for c in sorted(pdf.columns)]
    return sorted(zip(*cols), key=lambda r: tuple((v is None, str(type(v) is bool), float(v) if isinstance(v, (int, float)) else 0.0, str(v)) for v in r))


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got.columns) == len(set(got.columns)) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) <= 1e-6 * max(1, abs(v))) for u, v in zip(x, y)), (x, y)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_production_windows_and_horizons_are_registered(spark, sf_dir):
    from tickloom.operators import features

    cols = QUERIES["wn_flow_ms"](spark, sf_dir).columns
    assert {f"ofi_{w}ms" for w in features.WINDOWS_MS} <= set(cols)
    assert {f"fwd_return_{h}ms" for h in features.HORIZONS_MS} <= set(QUERIES["aj_fwd_return_ms"](spark, sf_dir).columns)
    assert all(f"{q}_ms" in QUERIES for q in list(QUERIES) if q.startswith("wn_") and not q.endswith("_ms"))
