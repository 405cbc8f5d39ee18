"""Retrieval and intent metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.scalars import excerpt_correct, intent_params_ok, path_matches
from sparkseek.operators.percentiles import percentile
from sparkseek.operators.router import route


def intent_metrics(cases: DataFrame, model=None) -> DataFrame:
    """One row: n, action_accuracy, param_accuracy, tier1_rate (percent), and how many tiers were as expected. cases: input, expected, tier."""
    got = route(cases.withColumnRenamed("tier", "expected_tier"), "input", model)
    e, a = "expected", "intent"
    action = F.coalesce(F.col(f"{e}.action") == F.col(f"{a}.action"), F.lit(False))
    params = intent_params_ok(*[F.col(f"{a}.{x}") for x in ("path", "query", "lines")], *[F.col(f"{e}.{x}") for x in ("path", "query", "lines")])
    share = lambda c: F.coalesce(F.avg(c.cast("int")) * 100, F.lit(0.0))
    return got.agg(
        F.count(F.lit(1)).alias("n"), share(action).alias("action_accuracy"), share(action & params).alias("param_accuracy"), share(F.col("tier") == 1).alias("tier1_rate"),
        F.count_if(F.col("tier") == F.col("expected_tier")).alias("tier_matches"),
    )


def hits_at(cases: DataFrame, results: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """query_id and hit_<k>: whether one of the first k files of a ranking is the expected one. results: query_id, path, rank."""
    first = results.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "path")))
    j = cases.select("query_id", "expect_path").join(placed.where(F.col("place") <= max(ks)), "query_id", "left")
    ok = F.coalesce(path_matches(F.col("path"), F.col("expect_path")), F.lit(False))
    return j.groupBy("query_id").agg(*[F.max(ok & (F.col("place") <= k)).alias(f"hit_{k}") for k in ks])


def chunk_excerpt_hits(cases: DataFrame, results: DataFrame, k: int = 3) -> DataFrame:
    """query_id, excerpt_ok: whether one of the first k chunks has the expected text. results: query_id, rank, excerpt."""
    j = cases.select("query_id", "expected_text").join(results.where(F.col("rank") <= k), "query_id", "left")
    return j.groupBy("query_id").agg(F.max(F.coalesce(excerpt_correct(F.col("excerpt"), F.col("expected_text")), F.lit(False))).alias("excerpt_ok"), F.first("expected_text").alias("expected_text"))


def locate_metrics(rows: DataFrame) -> DataFrame:
    """One row of percentages and latencies. rows: hit_1, hit_3 (global), scoped_1, scoped_3, bm25_3, vec_3, excerpt_ok, expected_text, latency_ms."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("int")) * 100, F.lit(0.0))
    has_text = F.coalesce(F.col("expected_text"), F.lit("")) != ""
    out = [share(c).alias(a) for c, a in (("hit_1", "recall_1"), ("hit_3", "recall_3"), ("scoped_1", "scoped_recall_1"), ("scoped_3", "scoped_recall_3"), ("bm25_3", "bm25_recall_3"), ("vec_3", "vec_recall_3"))]
    got = rows.agg(
        F.count(F.lit(1)).alias("n"), *out, F.coalesce(F.avg(F.when(has_text, F.col("excerpt_ok").cast("int"))) * 100, F.lit(0.0)).alias("excerpt_accuracy"),
        percentile("latency_ms", 0.5).alias("p50_ms"), percentile("latency_ms", 0.95).alias("p95_ms"),
    )
    return got.withColumn("delta_1", F.col("scoped_recall_1") - F.col("recall_1")).withColumn("delta_3", F.col("scoped_recall_3") - F.col("recall_3"))
