"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from undula.plans import evaluation, signals, spectra, tables

PLANS = {n: (p.QUERIES[n], p.SQL[n]) for p in (signals, spectra, evaluation, tables) for n in p.SQL}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return plain(v.item()) if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(PLANS))
def test_same_rows(spark, duck, sf, name):
    query, sql = PLANS[name]
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in result.fetchall()), key=repr)
    assert got == want
