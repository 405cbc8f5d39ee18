"""Embedding: a protocol for plug-ins and a deterministic hashing embedder that needs no model."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

DOCUMENT, QUERY = "search_document: ", "search_query: "
BATCH = 100
#: Queries whose embeddings are kept on the driver.
CACHED = 128


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashes of words and their character trigrams, normalised. The prefix of a text is left out, as it says nothing here."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashing-{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", t.removeprefix(DOCUMENT).removeprefix(QUERY).lower()):
                for part, weight in [(w, 1.0), *((w[i : i + 3], 0.3) for i in range(len(w) - 2))]:
                    h = zlib.crc32(part.encode())
                    out[k, h % self.dim] += weight if h >> 31 else -weight
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def embed_chunks(chunks: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """Adds embedding, in batches of `BATCH` texts."""
    fields = [f for f in chunks.schema.fields if f.name != "embedding"]
    names = [f.name for f in fields]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                part = b.slice(a, BATCH)
                v = embedder.embed([DOCUMENT + (t or "") for t in part.column(names.index(text)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(np.asarray(v, np.float32)), pa.list_(pa.float32()))], [*names, "embedding"])

    return chunks.select(*names).mapInArrow(go, StructType([*fields, StructField("embedding", ArrayType(FloatType()))]))


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """Adds embedding to a table with a column query."""
    names = queries.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                part = b.slice(a, BATCH)
                v = embedder.embed([QUERY + (t or "") for t in part.column(names.index("query")).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(np.asarray(v, np.float64)), pa.list_(pa.float64()))], [*names, "embedding"])

    return queries.mapInArrow(go, StructType([*queries.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


class QueryCache:
    """The last query embeddings."""

    def __init__(self, embedder: Embedder, size: int = CACHED):
        self.get = lru_cache(size)(lambda q: tuple(float(x) for x in embedder.embed([QUERY + q])[0]))
