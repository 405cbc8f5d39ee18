"""Ranks: exact ones of whole arms, dealt out over all tasks, and the best few of each query in a task."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.sizes import SMALL, if_small
from sparkseek.session import materialise

#: Places that scores are compared at, so that sums in another order rank alike.
PLACES = 6
HIT = "query int, id string, path string, score double"


def exact_ranks(arm: DataFrame, small: int = SMALL) -> DataFrame:
    """Adds rank within the query, by score (rounded) and id.

    The arm is written and counted. Up to `small` rows are numbered by a window over each query. Of more, no task gets a query as a whole: rows are dealt out by ranges of (query, score, id) and numbered within their range, and a range adds
    how many rows of the query lie in the ranges before it. The numbered rows are written, so that a range that is worked out again
    after a loss does not get other numbers than those that were counted."""
    by = ["query_id", F.desc("_rounded"), "id"]
    own = materialise(arm.withColumn("_rounded", F.round("score", PLACES)), "arm")  # the ranges are found from a sample of it
    if own.count() <= small:
        w = Window.partitionBy("query_id").orderBy(*by)
        return own.select(*arm.columns, F.row_number().over(w).alias("rank"))
    dealt = own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id())
    numbered = materialise(dealt, "numbered").withColumn("_range", F.shiftright("_n", 33))
    ranges = numbered.groupBy("query_id", "_range").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("query_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = ranges.select("query_id", "_range", (before - F.col("_first")).alias("_start"))
    return numbered.join(if_small(start), ["query_id", "_range"]).select(*arm.columns, (F.col("_n") + F.col("_start") + 1).cast("int").alias("rank"))


class Best:
    """The k best rows of each query so far, by score (rounded), then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(queries)]

    def floor(self, query: int) -> float:
        """What a row has to reach to be among them."""
        own = self.rows[query]
        return -own[-1][0] if len(own) == self.k else float("-inf")

    def add(self, query: int, rows: Iterable[tuple[float, str, str]]) -> None:
        """rows: score, id, path."""
        self.rows[query] = sorted([*self.rows[query], *((-round(s, PLACES), i, p, s) for s, i, p in rows)])[: self.k]

    def batch(self) -> pa.RecordBatch:
        rows = [(q, i, p, s) for q, own in enumerate(self.rows) for _, i, p, s in own]
        return hits(*(list(zip(*rows, strict=True)) or [[]] * 4))


def hits(query, ids, paths, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["query", "id", "path", "score"])


def in_scope(path: str, scope: str | None) -> bool:
    """As `scalars.under_scope`."""
    s = (scope or "").removesuffix("/")
    return not scope or path == s or path.startswith(s + "/")
