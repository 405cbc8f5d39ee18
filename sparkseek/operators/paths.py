"""Path arm: the query is a case-insensitive subsequence of the path; each file stands for its first chunk."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.scalars import under_scope
from sparkseek.functions.sizes import blocks

FIRST, AFTER_SEPARATOR, CAMEL, ADJACENT, LEADING, LEADING_MOST = 10, 20, 20, 5, -5, -15
SEPARATORS = frozenset("/-_ .\\")


def files(chunks: DataFrame) -> DataFrame:
    """path and its first chunk."""
    return chunks.groupBy("path").agg(F.min_by("id", "ordinal").alias("id"))


def subsequence_pattern(query: F.Column) -> F.Column:
    """A regular expression for the characters in order with anything between."""
    chars = F.filter(F.split(F.lower(query), ""), lambda c: c != "")
    return F.concat(F.lit("(?s)"), F.array_join(F.transform(chars, lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")), ".*"))


def matches(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, query, path, id of all files in scope that match. Queries are broadcast, in blocks if there are many."""
    q = queries.where(F.length("query") > 0).withColumn("pattern", subsequence_pattern(F.col("query")))
    own = files(chunks)
    found = [own.join(F.broadcast(b), under_scope(F.col("path"), F.col("scope")) & F.expr("lower(path) rlike pattern")) for b in blocks(q, "query_id", 4096)]
    return reduce(DataFrame.unionByName, found).select("query_id", "query", "path", "id")


def fuzzy_score(query: str, path: str) -> int:
    """The score of the best alignment of the query's characters with characters of the path, in order.

    Bonuses for the first character, starts of words and runs (the n-th further character of a run gets n times `ADJACENT`); a cost for
    what is skipped before the first hit and for unmatched characters. The best over all alignments, by a table of (place of the last
    character, length of its run) that goes on from one character of the query to the next."""
    q, n = list(query.lower()), len(path)
    low = np.array([c.lower()[:1] for c in path], dtype=object)
    place = np.array([FIRST if i == 0 else AFTER_SEPARATOR if path[i - 1] in SEPARATORS else CAMEL if path[i].isupper() and path[i - 1].islower() else 0 for i in range(n)], float)
    if not q or not n:
        return -n
    none = float("-inf")
    # best[r, i]: the query so far ends at place i, with r characters of its run before that one.
    best = np.where(low == q[0], place + np.maximum(LEADING_MOST, LEADING * np.arange(n)), none)[None]
    for c in q[1:]:
        apart = np.full(n, none)
        apart[2:] = np.maximum.accumulate(best.max(0))[:-2]
        run = np.full((len(best), n), none)
        run[:, 1:] = best[:, :-1] + ADJACENT * np.arange(1, len(best) + 1)[:, None]
        best = np.where(low == c, np.vstack([apart, run]) + place, none)
    top = best.max()
    return int(top) - (n - len(q)) if top > none else -n


def path_arm(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, id, path, score."""

    @F.pandas_udf("double")
    def score(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([float(fuzzy_score(a, b)) for a, b in zip(q, p, strict=True)], dtype="float64")

    return matches(queries, chunks).select("query_id", "id", "path", score("query", "path").alias("score"))
