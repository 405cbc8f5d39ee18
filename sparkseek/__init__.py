"""Spark-first hybrid document search: ingest, chunk, sync, rank, fuse, evaluate."""
