"""Postings and scores without an index: what is shuffled, and how often texts are cut."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import lexical
from sparkseek.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    """Documents of which some share their id, and odd texts; the SQL's rows on them."""
    rows = [(1, "the cat the CAT", "en", "src1"), (1, "the dog, the (dog)", "en", "src1"), (2, None, "en", "src1"), (3, "", "de", "src2"), (4, "x " * 500 + "de la ouvi", "fr", "src1"), (4, "de la", "fr", "src1"), (5, "and the retition of erenth", "en", "src1"), (5, "and the retition of erenth", "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), lambda name: sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall())


def test_postings_of_repeated_ids(spark, tables):
    d, sql = tables
    assert sorted(map(tuple, catalog.QUERIES["postings"](spark, d).collect())) == sql("postings")


def test_postings_are_counted_in_place(spark):
    """Rows of terms are shuffled for chunks with a repeated id only."""
    plan = catalog.QUERIES["postings"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    once, again = plan.split("hashpartitioning(term")  # one exchange by term
    assert "Anti" in once and "Semi" in again and "Semi" not in once


def test_unindexed_search_cuts_texts_once(spark, tables, monkeypatch):
    d, sql = tables
    assert sorted(map(tuple, catalog.QUERIES["bm25_unindexed"](spark, d).collect())) == sql("bm25_unindexed")
    texts = spark.read.parquet(f"{d}/documents.parquet")
    count = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        count.add(1)
        return x

    own = texts.selectExpr("concat('i', monotonically_increasing_id()) id", "'/p' path", "coalesce(text, '') content").withColumn("content", seen("content"))
    q = spark.createDataFrame([(1, "the cat", ""), (2, "de la", "")], "query_id int, query string, scope string")
    assert lexical.bm25(q, own).count() > 3
    assert count.value == texts.count()
