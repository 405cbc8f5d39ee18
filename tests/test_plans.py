"""What the plans look like: pushed filters, pruned columns, no joins that grow with the product of their sides."""

import os

import pytest

from sparkseek import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plan(spark, name):
    df = registry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    p = plan(spark, "where_equality")
    assert "EqualTo(source,src1)" in p and "EqualTo(lang,en)" in p and "n_chars" not in p


@pytest.mark.parametrize("name", ["token_estimate", "human_bytes"])
def test_columns_are_pruned(spark, name):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, name)


@pytest.mark.parametrize("name", ["bm25_topk", "postings", "dir_counts", "change_classify", "orphans", "rrf_fuse"])
def test_no_product_of_tables(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    if name != "rrf_fuse":  # the vector arm holds every chunk against the broadcast queries
        assert p.count("BroadcastNestedLoopJoin") <= (1 if name == "bm25_topk" else 0)  # one row of statistics


@pytest.mark.parametrize("name", ["tokenize_counts", "chunk_ids", "line_explode", "excerpt_render", "intent_conversations"])
def test_row_work_needs_no_shuffle_of_texts(spark, name):
    p = plan(spark, name)
    assert p.count("Exchange hashpartitioning") <= (1 if name == "line_explode" else 0)
