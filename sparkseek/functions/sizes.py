"""Checks of size before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a caller's table that are broadcast at most.
SMALL = 20_000


def few(df: DataFrame, most: int = SMALL) -> bool:
    """Whether a table has so many rows at most; looks at no more than that."""
    return df.limit(most + 1).count() <= most


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """For joins on equal keys: broadcast if small, else joined as Spark sees fit."""
    return F.broadcast(df) if few(df, most) else df


def blocks(df: DataFrame, key: str, most: int = SMALL) -> list[DataFrame]:
    """For joins that aren't on equal keys: parts of a table, of about `most` rows at most, each to be broadcast in its turn."""
    if few(df, most):
        return [df]
    n = -(-2 * df.count() // most)
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]
