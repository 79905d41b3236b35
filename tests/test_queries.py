"""Every query of the engine against its DuckDB twin on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from strata.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.date):  # datetimes too
        return v.isoformat()
    return float(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got[1]
