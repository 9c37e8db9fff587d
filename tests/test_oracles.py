"""Every query of the usage engine against its SQL."""

import datetime
import math

import duckdb
import pytest

from meterlake.guard_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v) if not isinstance(v, datetime.datetime) else v.isoformat()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, (r[c] for c in cols))) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    rel = sql.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    assert got == want
