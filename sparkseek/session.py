"""Session helpers: code shipping and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
#: Bytes of a row group of a table whose rows are megabytes.
GROUP_BYTES = 8 << 20
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once per application.

    The zip goes through Spark's own file server, so executors need no shared folder and a
    replacement for a lost executor fetches it again."""
    bounded_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_sparkseek_shipped", False):
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for top, dirs, names in os.walk(os.path.join(_ROOT, "sparkseek")):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(top, n)
                    z.write(p, os.path.relpath(p, _ROOT))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkseek-"), "sparkseek_code.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._sparkseek_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python workers and come back are bounded by bytes, not by rows alone: rows here are whole texts.
    A smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").strip().lower()
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = now.removesuffix("b")
    size = int(number[:-1]) * unit[number[-1]] if number[-1:] in unit else int(number)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own
    only where that is unset and all run on this machine; on a cluster that is an error."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not got:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="sparkseek-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(got)
    return got.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one) in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written = threading.local()


def materialise(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors,
    and keeps column pruning and filters for the readers. Inside `scratch()` the table goes when that ends.

    wide: rows may be of megabytes. Parquet looks at sizes after 100 rows only, and a reader takes a row group of up to 4,096 rows
    as one batch; so sizes are looked at from the first row on, and row groups are small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkseek-{name}-{uuid.uuid4().hex}"
    if getattr(_written, "paths", None) is not None:
        _written.paths.append(path)
    small = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    df.write.options(**small if wide else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Parts of a table, made and written one after the other, and read as one. A union of them would bring the same partition of all parts
    into one task where these are dealt out alike, and such a task keeps the memory of each part's sort until it ends."""
    paths: list[str] = []
    for k, df in enumerate(parts):
        if not k:
            top = f"{shared_dir(df.sparkSession)}/sparkseek-{name}-{uuid.uuid4().hex}"
            if getattr(_written, "paths", None) is not None:
                _written.paths.append(top)
        paths.append(f"{top}/{k}")
        df.write.parquet(paths[-1])
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result that is written while the tables it was made from are there; these are deleted then."""
    path = f"{shared_dir(spark)}/sparkseek-{name}-{uuid.uuid4().hex}"
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end; results have to be written by then."""
    outer, _written.paths = getattr(_written, "paths", None), []
    try:
        yield
    finally:
        paths, _written.paths = _written.paths, outer
        for path in paths:
            delete(spark, path)
