"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for rows that no label may be learnt from: crc32(doc_id as text) mod 4 is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce((F.crc32(c.cast("string").cast("binary")) % 4) == 2, F.lit(False))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet (upper and lower case count as the same)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def by_place(df: DataFrame, column: str, new: Iterable[str] = ()) -> tuple[DataFrame, list[str], int]:
    """For operators that add the columns `new` by Arrow code: the table without columns of such a name (upper and lower case count
    as the same), with its columns called `_0`, `_1` and so on; what they were called; and the place of `column`.

    `toDF` with those names and the new ones gives the names back. So no name of the input can clash, be ambiguous or need quotes."""
    out = {n.lower() for n in new}
    kept = [(i, c) for i, c in enumerate(df.columns) if c.lower() not in out]
    names = [c for _, c in kept]
    at = names.index(column) if column in names else [c.lower() for c in names].index(column.lower())
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[f"_{i}" for i, _ in kept])
    return plain.toDF(*[f"_{i}" for i in range(len(kept))]), names, at


_CACHES: dict[str, Callable[[], None]] = {}
_CURRENT = ""


def caches(owner: str, clear: Callable[[], None]) -> None:
    """Names what frees the memory that an operator keeps in a worker from task to task."""
    _CACHES[owner] = clear


def task_of(owner: str) -> None:
    """Called where a task begins: a worker that served another operator gives back what that one kept."""
    global _CURRENT
    if _CURRENT == owner:
        return
    _CURRENT = owner
    for name, clear in _CACHES.items():
        if name != owner:
            clear()
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
