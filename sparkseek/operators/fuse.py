"""Reciprocal rank fusion, strong and weak results, two-phase search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.sizes import if_small
from sparkseek.session import materialise

RRF_K, MIN_ARMS, FUSE_CAP, SINGLE_ARM_RANK, STRONG_CAP, WEAK_CAP = 60, 1, 500, 5, 8, 3
ARM_ORDER = ("path", "bm25", "vec")


def union_arms(arms: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [a.select("query_id", "id", "path", "rank", F.lit(name).alias("arm")) for name, a in arms.items()])


def fuse(arms: dict[str, DataFrame], rrf_k: int = RRF_K, min_arms: int = MIN_ARMS, cap: int = FUSE_CAP) -> DataFrame:
    """query_id, id, path, score, n_arms, arms, best_rank, rank. An id that an arm lists twice counts twice. Ties: best rank, then id."""
    got = union_arms(arms).groupBy("query_id", "id", "path").agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"), F.count(F.lit(1)).cast("int").alias("n_arms"), F.collect_set("arm").alias("arms"), F.min("rank").alias("best_rank")
    )
    order = F.filter(F.array(*[F.lit(a) for a in ARM_ORDER]), lambda a: F.array_contains(F.col("arms"), a))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "best_rank", "id")
    return got.where(F.col("n_arms") >= min_arms).withColumn("arms", order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def classify(fused: DataFrame, k: int = STRONG_CAP, min_arms: int = MIN_ARMS) -> DataFrame:
    """Adds class: strong with two arms, or one arm at rank 5 or better; else weak. Each is ranked anew and cut (k and 3)."""
    strong = (F.col("n_arms") >= min_arms) & ((F.col("n_arms") >= 2) | (F.col("best_rank") <= SINGLE_ARM_RANK))
    w = Window.partitionBy("query_id", "class").orderBy("fused_rank")
    out = fused.withColumnRenamed("rank", "fused_rank").withColumn("class", F.when(strong, "strong").otherwise("weak")).withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= F.when(F.col("class") == "strong", k).otherwise(WEAK_CAP)).drop("fused_rank")


def dedupe_by_path(results: DataFrame) -> DataFrame:
    """The best row of each file and class, ranked anew."""
    first = Window.partitionBy("query_id", "class", "path").orderBy("rank")
    again = Window.partitionBy("query_id", "class").orderBy("rank")
    return results.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("rank", F.row_number().over(again))


def strong_hits(arms: dict[str, DataFrame], k: int = STRONG_CAP) -> DataFrame:
    """query_id, hits: files among the strong results, for the message of an empty search."""
    return classify(fuse(arms), k).where("class = 'strong'").groupBy("query_id").agg(F.count_distinct("path").alias("hits"))


def two_phase(lexical: dict[str, DataFrame], vector: DataFrame | Callable[[DataFrame], DataFrame], k: int = STRONG_CAP) -> DataFrame:
    """Lexical results where a query has strong ones; the others are fused again with the vector arm. vector: the arm, or what makes it
    from the query_ids that are done. Nothing of a query that is done goes into the second fusion."""
    first = materialise(classify(fuse(lexical), k), "first")
    # Joined by query alone, where one query may have most rows of an arm: sent to the arms where it is small.
    done = if_small(first.where("class = 'strong'").select("query_id").distinct())
    arms = {**lexical, "vec": vector(done) if callable(vector) else vector}
    second = classify(fuse({name: arm.join(done, "query_id", "left_anti") for name, arm in arms.items()}), k)
    return first.join(done, "query_id", "left_semi").unionByName(second)
