"""Every search query against its SQL on the smallest driver tables."""

import math
import os

import pytest

from sparkseek import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    assert rows or name in ("is_stale",)
    if name in registry.oracle_sql():
        got = duck.execute(registry.oracle_sql()[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in got.fetchall())


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()
