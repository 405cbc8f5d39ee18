"""Streaming ingestion of text files, and windowed counts over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators.chunking import Chunking, chunk_files


def stream_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path and content of files as they arrive. Spark's listing leaves out names that begin with _ or a dot."""
    raw = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("content"))


def ingest(spark: SparkSession, folder: str, checkpoint: str, add: Callable[[DataFrame], None], pattern: str = "*.txt", how: Chunking = Chunking()) -> None:
    """Chunks what has arrived since the last run and hands each batch to `add`. A batch that is repeated after a failure comes with
    the same ids, so an upsert takes it."""
    def each(batch: DataFrame, _: int) -> None:
        add(chunk_files(batch, how))

    stream_files(spark, folder, pattern).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Per window and type: events and the sum of their values. Works on a stream (with a watermark) and on a table."""
    base = events.withWatermark("ts", late) if events.isStreaming else events
    return base.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")
