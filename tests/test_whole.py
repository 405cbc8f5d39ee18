"""Searches against SQL that leaves no rank or query out before fusion, on the smallest tables."""

import os

import pytest

from sparkseek import registry
from tests.test_oracle import SF, canon, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def compared(spark, duck, name, sql):  # noqa: F811
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    return sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()), sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in got.fetchall())


@pytest.mark.parametrize("name", ["rrf_fuse", "rrf_min_arms", "hybrid_strong", "hybrid_weak", "dedupe_by_path", "global_hit_count"])
def test_all_lexical_ranks_are_fused(spark, duck, name):  # noqa: F811
    sql = registry.oracle_sql()[name]
    assert "rank <= 100" not in sql
    rows, want = compared(spark, duck, name, sql)
    assert rows == want


def test_engine_arms_are_whole(spark, tmp_path):
    from sparkseek.engine import Engine

    e = Engine(spark, str(tmp_path))
    chunks = spark.range(600).selectExpr("concat('d', id, '-0') id", "concat('/a/d', id, '.txt') path", "0 ordinal", "'some words' content", "cast(null as array<float>) embedding", "named_struct('kind', 'page', 'start', 1, 'end', 1, 'symbol', '') locator", "false transient")
    e.store.commit(chunks=chunks)
    arms = e._lexical(e.queries(["words", "d"]), chunks)
    assert arms["bm25"].where("query_id = 0").count() == 600 and arms["path"].where("query_id = 1").count() == 600


def test_two_phase_takes_all_queries(spark, duck):  # noqa: F811
    rows, want = compared(spark, duck, "two_phase_search", registry.oracle_sql()["two_phase_search"])
    assert rows == want


def test_phase_two_without_lexical_match(spark):
    from pyspark.sql import functions as F

    from sparkseek.operators import fuse
    from sparkseek.plans import catalog

    arms = catalog._arms(spark, SF)
    vec = arms["vec"].where("query_id = 1")
    vec = vec.unionByName(vec.withColumn("query_id", F.lit(6)))  # the one query without a word that occurs
    got = fuse.two_phase({k: arms[k] for k in ("path", "bm25")}, vec)
    assert {tuple(r.arms) for r in got.where("query_id = 1").collect()} == {("bm25",)} and {tuple(r.arms) for r in got.where("query_id = 6").collect()} == {("vec",)}


def test_pages_are_sniffed_whole(spark, tmp_path):
    pages = [(1, "x" * 3000 + "\0" + "x" * 9000), (2, "x" * 9000 + "\0"), (3, "x" * 8191 + "é" * 100), (4, "a\0"), (5, None), (6, "x" * (1 << 20) + "x"), (7, "x" * 9000)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r.page_id for r in registry.queries()["admit_filter"](spark, str(tmp_path)).collect()) == [3, 5, 7]
