"""Ranks of whole arms, BM25 by blocks and vectors by clusters against plain versions of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import blocks, lexical, ranks, vector
from sparkseek.session import materialise

CHUNK = "id string, path string, content string, embedding array<float>"


def rows(df, *cols):
    return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


def test_exact_ranks(spark):
    r = random.Random(5)
    hits = [(q, f"i{k:05d}", f"/p{k}", r.choice([1.0, 2.0, 2.0000000001, r.random()])) for q, n in ((1, 3000), (2, 1), (7, 400)) for k in range(n)]
    arm = spark.createDataFrame(hits, "query_id int, id string, path string, score double").repartition(6)
    got = ranks.exact_ranks(arm, small=100)
    assert rows(ranks.exact_ranks(arm), "query_id", "id", "rank") == rows(got, "query_id", "id", "rank")
    assert got.columns == [*arm.columns, "rank"]
    assert rows(got, "query_id", "id", "rank") == rows(lexical.ranked(arm), "query_id", "id", "rank")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert ranks.exact_ranks(arm.limit(0)).count() == 0


def test_no_window_over_all_hits(spark):
    """One query that meets every row is numbered by all tasks."""
    arm = spark.range(20_000).selectExpr("1 query_id", "concat('i', id) id", "'/p' path", "rand(3) score")
    numbered = ranks.exact_ranks(arm, small=0)
    assert numbered.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (1, 20_000, 20_000)
    dealt = materialise(arm, "t").withColumn("_rounded", F.round("score", 6)).repartitionByRange(4, "query_id", F.desc("_rounded"), "id")
    sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4


def corpus(n, seed=2):
    """Chunks of three vocabularies, as they come from directories."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind = "abc"[k * 3 // n]
        words = r.choices([f"{kind}{j}" for j in range(40)] + ["the", "of"], [1 / (j + 1) for j in range(40)] + [1, 1], k=r.randint(0, 60))
        out.append((f"id{k:05d}", f"/{kind}/d{k % 7}/f{k}.txt", " ".join(words) + r.choice(["", ".", " x"]), None))
    return out


QUERIES = [(1, "a1 a30 the", ""), (2, "b2 b2 b39", ""), (3, "the of the", "/a/d1"), (4, "c39", "/a"), (5, "nothing-here", ""), (6, "", ""), (7, "the", "/b/d2/"), (8, "A1, (C1)", "/c/d3/f1"), (9, "x", None)]


@pytest.mark.parametrize("chunks,k", [(16, 5), (2048, 12)])
def test_blocks_are_exact(spark, monkeypatch, chunks, k):
    monkeypatch.setattr(blocks, "QUERIES", 4)
    own = spark.createDataFrame([*corpus(700), ("idx", "/a/d1/x", None, None), ("idy", "/a/d1/y", "", None)], CHUNK)
    q = spark.createDataFrame(QUERIES, "query_id int, query string, scope string")
    index = materialise(blocks.build(own), "blocks")
    want = lexical.ranked(lexical.bm25(q, own))
    assert rows(blocks.whole_arm(q, index), "query_id", "id", "path", "score") == rows(want, "query_id", "id", "path", "score")
    got = blocks.top_k(q, index, k)
    assert rows(got, "query_id", "id", "score", "rank") == rows(want.where(F.col("rank") <= k), "query_id", "id", "score", "rank")
    assert blocks.top_k(q, index.limit(0), k).count() == 0 and blocks.top_k(q.limit(0), index, k).count() == 0


def test_row_groups_of_an_index_are_small(spark, monkeypatch):
    """Rows of an index are megabytes: neither its writer nor its readers hold a hundred of them at once."""
    import glob

    import pyarrow.parquet as pq

    from sparkseek import session
    from sparkseek.plans import catalog

    paths = []
    monkeypatch.setattr(session, "GROUP_BYTES", 100_000, raising=False)
    monkeypatch.setattr(session._written, "paths", paths, raising=False)
    monkeypatch.setattr(blocks, "TOKENS", 4000)
    index = catalog._index(spark, "/root/testdata/sf0.01")
    files = [pq.read_metadata(f) for f in glob.glob(paths[-1].removeprefix("file://") + "/*.parquet")]
    groups = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    assert index.count() > 20 and sum(groups) > 2_000_000 and max(groups) < 400_000


def test_blocks_are_left_out(spark):
    own = spark.createDataFrame(corpus(3000), CHUNK).coalesce(1)
    index = materialise(own.select("id", "path", "content").transform(lambda df: blocks.build(df.repartitionByRange(30, "id"))), "blocks")
    q = spark.createDataFrame([(1, "a30 a39", ""), (2, "b39 b5", ""), (3, "c7 c39", "")], "query_id int, query string, scope string")
    found, _ = blocks.hits_of_block(q, index, 3)
    met, used = found.where("query = -1").selectExpr("sum(score)", "sum(cast(path as long))").first()
    assert index.count() == 30 and met == 90 and used <= 40  # of each vocabulary a third of the blocks has any
    assert rows(blocks.top_k(q, index, 3), "query_id", "id", "rank") == rows(lexical.ranked(lexical.bm25(q, own), 3), "query_id", "id", "rank")


def plain_cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return 0.0
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return 0.0
    n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return float((a * b).sum() / n) if n else 0.0


def vectors(n, groups, seed=4):
    g = np.random.default_rng(seed)
    middles = g.normal(size=(groups, 16))
    return [(f"id{k:05d}", f"/{'ab'[k % 2]}/f{k}", "", (middles[k % groups] + g.normal(size=16) * 0.15).tolist()) for k in range(n)]


@pytest.mark.parametrize("block", [16, 512])
def test_vectors_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "QUERIES", 5)
    own = vectors(600, 9)
    own += [("z0", "/a/z0", "", [0.0] * 16), ("z1", "/a/z1", "", [1.0] * 7), ("z2", "/a/z2", "", []), ("z3", "/a/z3", "", None), ("z4", "/b/z4", "", [*own[0][3][:15], None]), ("z5", "/b/z5", "", [float("nan")] * 16)]
    own += [(f"s{k}", "/b/same", "", own[5][3]) for k in range(200)]  # one vector, many times
    asked = [(1, own[5][3], ""), (2, own[8][3], "/a"), (3, [0.0] * 16, "/b"), (4, [2.0] * 7, ""), (5, [], "/a/z2"), (6, own[1][3], "/b/f1"), (7, own[2][3], None), (8, [-x for x in own[3][3]], "/b/")]
    df = spark.createDataFrame(own, CHUNK).repartition(5)
    q = spark.createDataFrame(asked, "query_id int, embedding array<float>, scope string")
    want = []
    for i, v, s in asked:
        hit = sorted((-round(plain_cosine(v, e), 6), c) for c, p, _, e in own if e is not None and ranks.in_scope(p, s))[:8]
        want += [(i, c, k, -x + 0.0) for k, (x, c) in enumerate(hit, 1)]
    shown = lambda got: sorted((r.query_id, r.id, r["rank"], round(r.score, 6) + 0.0) for r in got.collect())
    assert shown(vector.vector_arm(q, df, 8)) == sorted(want)
    assert shown(vector.top_k(q, materialise(vector.build(df), "clusters"), 8)) == sorted(want)
    assert vector.top_k(q, materialise(vector.build(df.limit(0)), "clusters"), 8).count() == 0 and vector.vector_arm(q, df.limit(0), 8).count() == 0


def test_blocks_of_queries_do_not_meet_in_a_task(spark, monkeypatch):
    """Each block of queries is ranked and written by itself: one task over all of them would keep a sort of each."""
    monkeypatch.setattr(vector, "QUERIES", 5)
    df = spark.createDataFrame(vectors(400, 9), CHUNK)
    q = df.where("cast(substr(id, 3) as int) % 40 = 0").select(F.expr("cast(substr(id, 3) as int)").alias("query_id"), "embedding", F.lit("").alias("scope"))
    windows = lambda got: got._jdf.queryExecution().executedPlan().toString().count("Window [")
    index = materialise(vector.build(df), "clusters")
    got, arm = vector.top_k(q, index, 3), vector.vector_arm(q, df, 3)
    assert windows(got) == 0 and windows(arm) == 1
    assert rows(got, "query_id", "id", "rank", "score") == rows(arm, "query_id", "id", "rank", "score") and got.count() == 10 * 3


def test_many_queries_share_a_pass(spark, monkeypatch):
    """The stored form is read a bounded number of times, not once for each thousand queries; and queries of one vector are one."""
    own = vectors(3000, 9)
    df = spark.createDataFrame(own + [(f"same{k:04d}", "/b/same", "", own[5][3]) for k in range(600)], CHUNK)
    q = df.select(F.expr("cast(substr(xxhash64(id), 2, 9) as int)").alias("query_id"), "embedding", F.lit("").alias("scope"))
    index = materialise(vector.build(df), "clusters")
    passes, real = [], vector.hits_of_block

    def counted(asked, *a):
        passes.append(len(asked.ids))
        return real(asked, *a)

    monkeypatch.setattr(vector, "hits_of_block", counted)
    got = vector.top_k(q, index, 3)
    assert passes == [3000]  # 600 of the 3,600 have the vector of another
    assert rows(got, "query_id", "id", "rank", "score") == rows(vector.vector_arm(q, df, 3), "query_id", "id", "rank", "score")


@pytest.mark.parametrize("most", [1, 7])
def test_passes_are_bounded(spark, monkeypatch, most):
    monkeypatch.setattr(vector, "QUERIES", 5)
    monkeypatch.setattr(vector, "TOGETHER", most)
    df = spark.createDataFrame(vectors(400, 9), CHUNK)
    q = df.where("cast(substr(id, 3) as int) % 20 = 0").select(F.expr("cast(substr(id, 3) as int)").alias("query_id"), "embedding", F.lit("").alias("scope"))
    got = vector.top_k(q, materialise(vector.build(df), "clusters"), 3)
    assert rows(got, "query_id", "id", "rank", "score") == rows(vector.vector_arm(q, df, 3), "query_id", "id", "rank", "score") and got.count() == 20 * 3


@pytest.mark.parametrize("scopes", [("",), ("", "/a", "/b/f1", "/none")])
def test_a_task_cuts_what_it_holds(spark, monkeypatch, scopes):
    """Rows of a task are cut to the k best of each query again and again, with ties, equal vectors, zeros and lengths."""
    monkeypatch.setattr(vector, "HELD", 10)
    monkeypatch.setattr(vector, "COSINES", 100)
    own = vectors(300, 5)
    own += [(f"s{k:03d}", f"/{'ab'[k % 2]}/same", "", own[5][3]) for k in range(90)] + [(f"z{k:03d}", "/b/z", "", [0.0] * 16) for k in range(40)] + [(f"w{k}", "/a/w", "", [1.0] * 7) for k in range(5)]
    index = vector.build(spark.createDataFrame(own, CHUNK)).toArrow().combine_chunks().to_batches()
    asked = [(k, v, s) for k, (v, s) in enumerate((v, s) for v in [x[3] for x in own[:20]] + [[0.0] * 16, [2.0] * 7, [1.0] * 3, []] for s in scopes)]
    a = vector._asked(spark.createDataFrame(asked, "query_id int, q_embedding array<float>, scope string"))
    found = {}
    for b in vector._compared(a, 4, np.full(len(a.ids), -np.inf), None)(iter(index)):
        for r in b.to_pylist():
            for i in a.ids[r["query"]] if r["query"] >= 0 else []:
                found.setdefault(i, []).append((-round(r["score"], 6) + 0.0, r["id"]))
    for i, v, s in asked:
        want = sorted((-round(plain_cosine(v, e), 6) + 0.0, c) for c, p, _, e in own if ranks.in_scope(p, s))[:4]
        assert sorted(found.get(i, [])) == want, (i, s)


def test_clusters_are_left_out(spark):
    df = spark.createDataFrame(vectors(4000, 40), CHUNK)
    index = materialise(vector.build(df), "clusters")
    assert index.selectExpr("sum(size(ids))").first()[0] == 4000 and index.selectExpr("max(size(ids))").first()[0] <= vector.VECTORS
    q = df.where("cast(substr(id, 3) as int) % 20 = 0").select(F.expr("cast(substr(id, 3) as int)").alias("query_id"), F.col("embedding").alias("q_embedding"), F.lit("").alias("scope"))
    met, used = vector.hits_of_block(vector._asked(q), index, 10).where("query = -1").selectExpr("sum(score)", "sum(cast(path as long))").first()
    assert met == 200 * 4000 and used < 0.2 * met


def test_best_alignment():
    import itertools

    from sparkseek.operators import paths as P

    def best(q, p):
        """Over all alignments."""
        top = None
        for at in itertools.combinations(range(len(p)), len(q)):
            if any(p[i].lower() != c for i, c in zip(at, q.lower(), strict=True)):
                continue
            score, run = max(P.LEADING_MOST, P.LEADING * at[0]), 0
            for k, i in enumerate(at):
                run = run + 1 if k and at[k - 1] == i - 1 else 0
                score += P.ADJACENT * run + (P.FIRST if i == 0 else P.AFTER_SEPARATOR if p[i - 1] in P.SEPARATORS else P.CAMEL if p[i].isupper() and p[i - 1].islower() else 0)
            top = score if top is None else max(top, score)
        return -len(p) if top is None else top - (len(p) - len(q))

    r = random.Random(9)
    for _ in range(400):
        p = "".join(r.choice("aAbB/_. ") for _ in range(r.randint(1, 11)))
        q = "".join(r.choice("abAB/") for _ in range(r.randint(1, 5)))
        assert P.fuzzy_score(q, p) == best(q, p), (q, p)
    # The first occurrence of each character isn't the best: the run in the name is.
    assert P.fuzzy_score("doc", "/d/o/c/doc.md") == best("doc", "/d/o/c/doc.md") > best("doc", "/d/o/c/dxoxc.md")
    assert P.fuzzy_score("x" * 300, "x" * 400) > 0 and P.fuzzy_score("a", "") == 0
