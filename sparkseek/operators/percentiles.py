"""Exact percentiles of groups of any size, with bounded state in every task.

Spark's own exact percentile keeps the distinct values of a group in one task. Here that serves only groups of up to `EXACT` values.
For larger ones each round takes quantiles of the values that are still possible from a sketch, as pivots, together with the least and
the greatest one; counts below and at each pivot, exact ones, tell between which two the wanted rank lies, or that it is a pivot. What
lies between is written and is the next round's input, about a `PIVOTS`th. The sketch decides how fast that goes, and never what comes out: the least and the
greatest value are ruled out or found in every round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.sizes import if_small
from sparkseek.session import materialise, settled

#: Values of a group up to which they are held together; quantiles that a round takes; the sketch's accuracy (1/error).
EXACT, PIVOTS, ACCURACY = 100_000, 32, 500


def percentile(column: str, p: float) -> Column:
    """Nearest rank: the value at place ceil(p n); p of 0 or less is the least, of 1 or more the greatest; 0 without values."""
    return F.expr(f"coalesce(percentile_disc({_share(p)}) within group (order by {column}), 0)")


def _share(p: float) -> float:
    return min(1.0, max(0.0, p))


def _join(rows: DataFrame, few: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """On equal keys, nulls being equal; of `few` the keys are dropped."""
    own = few.select(*[F.col(c).alias(f"_of_{k}") if c in by else F.col(c) for k, c in enumerate(few.columns)])
    names = {c: f"_of_{k}" for k, c in enumerate(few.columns) if c in by}
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(names[c])) for c in by])
    out = rows.join(own, on, how)
    return out if how == "left_anti" else out.drop(*names.values())


def percentiles(df: DataFrame, by: list[str], column: str, wanted: dict[str, float], exact: int = EXACT) -> DataFrame:
    """One row for each group: its keys, and a column for each name in `wanted` with that percentile, as `percentile` defines it. Nulls are
    left out of a group's values; a null key is a group; NaN is the greatest value. Results are doubles, as those of Spark's own percentile;
    whole numbers are ranked as they are."""
    direct = lambda rows: rows.groupBy(*by).agg(*[percentile(column, p).alias(name) for name, p in wanted.items()])
    hot = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > exact)
    if hot.isEmpty():
        return direct(df)
    return settled(df.sparkSession, "percentiles", lambda: _large(df, by, column, wanted, exact, materialise(hot, "hot"), direct))


def _large(df: DataFrame, by: list[str], column: str, wanted: dict[str, float], exact: int, hot: DataFrame, direct) -> DataFrame:
    cold = direct(_join(df, if_small(hot), by, "left_anti"))
    ranks = F.array(*[F.struct(F.lit(k).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(_share(p)) * F.col("_n"))).cast("bigint").alias("r")) for k, p in enumerate(wanted.values())])
    # Keys, which percentile, its rank among the values that are still possible, and how many these are.
    open_ = materialise(hot.select(*by, F.inline(ranks), F.col("_n").alias("_left")), "open")
    values = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    rows = _join(values, if_small(open_.select(*by, "p")), by)
    found = []
    keys = [*by, "p"]
    while not open_.isEmpty():
        small = open_.where(F.col("_left") <= exact)
        w = Window.partitionBy(*keys).orderBy("_v")
        found.append(materialise(_join(rows, if_small(small.select(*keys, "r")), keys).withColumn("_at", F.row_number().over(w)).where("_at = r").select(*keys, "_v"), "found"))
        large = open_.where(F.col("_left") > exact)
        if large.isEmpty():
            break
        own = _join(rows, if_small(large.select(*keys, "r")), keys)
        shares = F.array(*[F.lit(k / PIVOTS) for k in range(1, PIVOTS)])
        sketch = own.groupBy(*keys).agg(F.percentile_approx("_v", shares, ACCURACY).alias("_q"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        pivots = materialise(sketch.select(*keys, F.array_sort(F.array_distinct(F.concat(F.array("_least"), "_q", F.array("_most")))).alias("_pivots")), "pivots")
        placed = _join(own, if_small(pivots), keys)
        # Place of a value: 2k for the k-th pivot itself (from 0), 2k - 1 for what lies before it and after the one before.
        below = reduce(lambda a, b: a + b, [F.coalesce((F.get("_pivots", F.lit(k)) < F.col("_v")).cast("int"), F.lit(0)) for k in range(PIVOTS + 1)])
        placed = placed.withColumn("_k", below).withColumn("_place", 2 * F.col("_k") - F.when(F.get("_pivots", F.col("_k")) == F.col("_v"), 0).otherwise(1))
        counts = placed.groupBy(*keys, "_place").agg(F.count(F.lit(1)).alias("_c"), F.first("r").alias("r"), F.min("_v").alias("_v"))
        up_to = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_place"))
        hit = materialise(counts.withColumn("_up", up_to).where((F.col("_up") >= F.col("r")) & (F.col("_up") - F.col("_c") < F.col("r"))), "hit")
        found.append(hit.where("_place % 2 = 0").select(*keys, "_v"))
        open_ = materialise(hit.where("_place % 2 <> 0").select(*keys, (F.col("r") - F.col("_up") + F.col("_c")).alias("r"), F.col("_c").alias("_left"), "_place"), "open")
        left = _join(placed.drop("r").withColumnRenamed("_place", "_own"), if_small(open_.select(*keys, "_place")), keys)
        rows = materialise(left.where("_own = _place").select(*keys, "_v"), "left")
    all_found = reduce(DataFrame.unionByName, found)
    kind = cold.schema[next(iter(wanted))].dataType
    out = all_found.groupBy(*by).agg(*[F.max(F.when(F.col("p") == k, F.col("_v"))).cast(kind).alias(name) for k, name in enumerate(wanted)])
    return cold.unionByName(out)
