"""An embedder learnt from the corpus: randomised SVD of the matrix of chunks by terms.

Terms are hashed into `FEATURES` features, so whatever goes to the driver or to all tasks has that many rows at most, however large the
corpus; every term of every chunk counts. An entry is (1 + ln count) * idf, rows have length 1. Each pass multiplies the matrix and its
transpose by an orthonormal basis of `dim` + `MORE` columns: a task adds up its own rows' share, the shares are summed by feature, and the
driver makes the result orthonormal again. The last pass turns the basis into singular vectors (Rayleigh-Ritz). The shares of a task are
`FEATURES` rows at most, and there are three tasks a core at most, fewer where there is little to multiply; so what a pass shuffles has a bound; terms are cut and hashed once, and stored, and
`learnt` makes the vectors of the chunks from what is stored. Terms of many texts are cut, hashed and counted at once, as arrays of bytes; products go column by
column, so that what they look up stays in the cache.

Defined results: null and empty texts, and texts of unseen terms alone, have a vector of zeros; so has every text if there was nothing to
learn from, and so have columns beyond the rank of the matrix; repeated chunks count each time. Sums of floats may differ in their last
digits from run to run."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType

from sparkseek.functions.scalars import DELIMITERS
from sparkseek.operators.embed import DOCUMENT, QUERY
from sparkseek.session import materialise, scratch

FEATURES = 1 << 15
DIM, MORE, PASSES, SEED = 32, 8, 4, 7
#: Entries of the matrix that are multiplied at once, and texts that are embedded at once.
ENTRIES, TEXTS = 1 << 17, 1000
#: Features whose sums go through a shuffle as one row; entries of a task of a product at least, as the sums of a task are as large however few it has.
SLICE, LEAST = 1 << 10, 1 << 22
#: Bytes of text that are cut at once, and of a term that is hashed along with others.
BYTES, LONG = 1 << 19, 48
_CUT = re.compile(DELIMITERS)
_WIDE = [chr(c) for c in range(0x80, 0x10000) if _CUT.match(chr(c))]
_BLANK = np.array([c < 0x80 and _CUT.match(chr(c)) is not None for c in range(256)])
TABLE = "feature int, idf double, vector array<float>"
SUMS = "start int, sums binary"


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def counted(text: str | None, features: int) -> Counter:
    """How often each feature occurs."""
    out: Counter = Counter()
    for term, n in Counter(x for x in _CUT.split((text or "").lower()) if x).items():
        out[zlib.crc32(term.encode("utf-8", "surrogatepass")) % features] += n
    return out


def _lowered(text: str | None) -> bytes:
    """In lower case, delimiters beyond ASCII replaced by spaces."""
    low = (text or "").lower()
    if not low.isascii():
        for c in _WIDE:
            if c in low:
                low = low.replace(c, " ")
    return low.encode("utf-8", "surrogatepass")


def _hashed(said: bytes, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each term of lower-case text starts, and its feature; the same as `counted` has."""
    raw = np.frombuffer(b" " + said + b" ", np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    long = np.minimum(ends - starts, LONG + 1)
    order = np.argsort(long.astype(np.int16), kind="stable")
    at, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    cut = np.searchsorted(long[order], np.arange(LONG + 2), side="right")
    for j in range(LONG):  # terms of more than j bytes are the last ones
        if cut[j] == len(order):
            break
        c = crc[cut[j] :]
        crc[cut[j] :] = _CRC[(c ^ raw[at[cut[j] :] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty(len(order), np.int64)
    out[order] = (crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(features)
    for k in order[cut[LONG] :].tolist():
        out[k] = zlib.crc32(raw[starts[k] : ends[k]]) % features
    return starts - 1, out


def _pieces(said: bytes) -> Iterator[bytes]:
    """A long text, cut where no term is cut."""
    raw, at = np.frombuffer(said, np.uint8), 0
    while at < len(said):
        z = at + BYTES
        while z < len(said):
            blank = np.flatnonzero(_BLANK[raw[z : z + BYTES]])
            if len(blank):
                z += int(blank[0])
                break
            z += BYTES
        yield said[at:z]
        at = z


def _counts(said: list[bytes], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many features each text has, and all of them in order, with how often each occurs."""
    if len(said) == 1 and len(said[0]) > BYTES:
        n = np.zeros(features, np.int64)
        for piece in _pieces(said[0]):
            n += np.bincount(_hashed(piece, features)[1], minlength=features)
        f = np.flatnonzero(n)
        return np.array([len(f)]), f, n[f]
    starts, f = _hashed(b" ".join(said), features)
    ends = np.cumsum([len(x) + 1 for x in said])
    key = np.sort(np.searchsorted(ends, starts, side="right") * features + f)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n, key = np.diff(np.append(first, len(key))), key[first]
    return np.bincount(key // features, minlength=len(said)), key % features, n


def _lists(texts: Iterable[str | None], features: int) -> pa.RecordBatch:
    """Features and counts of each text, some texts at a time."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        said = _lowered(t)
        if held and size + len(said) > BYTES:
            parts.append(_counts(held, features))
            held, size = [], 0
        held.append(said)
        size += len(said) + 1
    if held:
        parts.append(_counts(held, features))
    many, f, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
    ends = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (f, n)], ["features", "counts"])


def _packed(lists: pa.ListArray) -> pa.BinaryArray:
    """Lists as bytes: the form in which they are stored, as Spark takes lists apart number by number."""
    ends = lists.offsets.to_numpy()
    raw = lists.values.to_numpy()[ends[0] : ends[-1]].astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(((ends - ends[0]) * 4).astype(np.int32)), pa.py_buffer(raw)])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row starts and ends, and all their numbers: of lists, or of such bytes."""
    if pa.types.is_list(column.type):
        return column.offsets.to_numpy(), column.values.to_numpy()
    _, ends, raw = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    return ends // 4, np.frombuffer(raw, "<i4", int(ends[-1]) // 4) if ends[-1] else np.zeros(0, np.int32)


def _rows(b: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of the matrix that aren't empty, some at a time: their places, where each starts, its features and its entries."""
    (ends, all_f), (n_ends, all_n) = _numbers(b.column("features")), _numbers(b.column("counts"))
    shift = int(n_ends[0]) - int(ends[0]) if len(n_ends) else 0
    place = np.flatnonzero(np.diff(ends))
    at = 0
    while at < len(place):
        first = int(ends[place[at]])
        z = max(at + 1, int(np.searchsorted(ends[place + 1], first + ENTRIES, side="right")))
        own, last = place[at:z], int(ends[place[z - 1] + 1])
        starts, f = ends[own] - first, all_f[first:last].astype(np.int64)
        w = (1 + np.log(all_n[first + shift : last + shift])) * idf[f]
        length = np.sqrt(np.add.reduceat(w * w, starts))
        yield own, starts, f, w / np.repeat(np.where(length > 0, length, 1), np.diff(np.append(starts, len(f))))
        at = z


def _frequencies(features: int):
    """In how many rows each feature occurs, and at feature -1 how many rows have any."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(features, np.int64), 0
        for b in batches:
            ends, f = _numbers(b.column("features"))
            n += np.bincount(f[ends[0] : ends[-1]], minlength=features)
            rows += int(np.count_nonzero(np.diff(ends)))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at).astype(np.int32)), pa.array(np.append(rows, n[at]))], ["feature", "n"])

    return go


def _sums(columns: np.ndarray, starts: np.ndarray, f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows of the matrix times columns that are given as rows: a row of each."""
    return np.stack([np.add.reduceat(w * c[f], starts) for c in columns])


def _product(shared, width: int, features: int):
    """A task's share of the transposed matrix times the matrix times the basis, `SLICE` features a row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, idf = shared.value
        columns = np.ascontiguousarray(basis.T)
        total, met = np.zeros((width, features)), np.zeros(features, bool)
        for b in batches:
            for _, starts, f, w in _rows(b, idf):
                long = np.diff(np.append(starts, len(f)))
                for k, c in enumerate(_sums(columns, starts, f, w)):
                    total[k] += np.bincount(f, w * np.repeat(c, long), features)
                met[f] = True
        for a in range(0, features, SLICE):
            if met[a : a + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([total[:, a : a + SLICE].tobytes()], pa.binary())], ["start", "sums"])

    return go


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of a slice added up: as bytes, since a sum of each of their numbers takes longer than the product."""
    out: dict[int, np.ndarray] = {}
    for b in batches:
        for a, x in zip(b.column("start").to_pylist(), b.column("sums").to_pylist(), strict=True):
            own = np.frombuffer(x)
            out[a] = out[a] + own if a in out else own
    for a, x in out.items():
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["start", "sums"])


def _multiplied(rows: DataFrame, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    features, width = basis.shape
    shared = rows.sparkSession.sparkContext.broadcast((basis, idf))  # `FEATURES` rows
    shares = rows.select("features", "counts").mapInArrow(_product(shared, width, features), SUMS)
    t = shares.repartition("start").mapInArrow(_added, SUMS).toArrow()
    shared.destroy()
    out = np.zeros(basis.shape)
    for a, x in zip(t.column("start").to_pylist(), t.column("sums").to_pylist(), strict=True):
        out[a : a + SLICE] = np.frombuffer(x).reshape(width, -1).T
    return out


@dataclass
class LatentEmbedder:
    """Frozen: idf of each feature, and its row of right singular vectors."""

    name: str
    idf: np.ndarray
    vectors: np.ndarray

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for a in range(0, len(texts), TEXTS):
            b = _lists([t.removeprefix(DOCUMENT).removeprefix(QUERY) for t in texts[a : a + TEXTS]], len(self.idf))
            out[a : a + b.num_rows] = self.of_counts(b)
        return out.astype(np.float32)

    def of_counts(self, b: pa.RecordBatch) -> np.ndarray:
        """Vectors of texts whose features are counted."""
        out, columns = np.zeros((b.num_rows, self.dim)), np.ascontiguousarray(self.vectors.T)
        for place, starts, f, w in _rows(b, self.idf):
            out[place] = _sums(columns, starts, f, w).T
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    def table(self, spark: SparkSession) -> DataFrame:
        """feature, idf, vector: the form in which it is stored."""
        return spark.createDataFrame([(k, float(self.idf[k]), self.vectors[k].tolist()) for k in range(len(self.idf))], TABLE)


def from_table(rows: DataFrame, name: str) -> LatentEmbedder:
    t = rows.orderBy("feature").collect()  # a row for each feature
    return LatentEmbedder(name, np.array([r.idf for r in t]), np.array([r.vector for r in t], np.float32))


def _stored(chunks: DataFrame, features: int, text: str) -> DataFrame:
    """The chunks with their counted features in place of their text, written."""
    fields = [f for f in chunks.schema.fields if f.name not in (text, "features", "counts")]
    names = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, TEXTS):
                part = b.slice(a, TEXTS)
                own = _lists(part.column(len(names)).to_pylist(), features)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *map(_packed, own.columns)], [*names, "features", "counts"])

    kind = StructType([*fields, StructField("features", BinaryType()), StructField("counts", BinaryType())])
    return materialise(chunks.select(*names, F.col(text).cast("string").alias("_text")).mapInArrow(cut, kind), "features")


def _fitted(rows: DataFrame, dim: int, passes: int, features: int) -> LatentEmbedder:
    most = 3 * rows.sparkSession.sparkContext.defaultParallelism
    seen = rows.select("features").coalesce(most).mapInArrow(_frequencies(features), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    at, n = seen.column("feature").to_numpy(), seen.column("n").to_numpy()
    df = np.zeros(features, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    rows = rows.coalesce(max(1, min(most, -(-int(df.sum()) // LEAST))))
    idf = np.where(df > 0, np.log((n[at < 0].sum() + 1) / np.maximum(df, 1)), 0.0)
    name = f"latent-{dim}-{zlib.crc32(df.tobytes() + bytes([passes])):08x}"
    basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(features, min(features, dim + MORE))))[0]
    for _ in range(passes - 1):
        basis = np.linalg.qr(_multiplied(rows, basis, idf))[0]
    squared, turn = np.linalg.eigh(basis.T @ _multiplied(rows, basis, idf))
    squared, turn = squared[::-1][:dim], turn[:, ::-1][:, :dim]
    vectors = (basis @ turn) * (squared > max(squared[0], 0) * 1e-9)
    vectors = np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))
    top = vectors[np.abs(vectors).argmax(0), np.arange(dim)]
    return LatentEmbedder(name, idf, (vectors * np.where(top < 0, -1, 1)).astype(np.float32))


def learn(chunks: DataFrame, dim: int = DIM, passes: int = PASSES, features: int = FEATURES, text: str = "content") -> LatentEmbedder:
    """From all chunks. Its name tells which corpus it was learnt from, so that a store made with another one is seen to differ."""
    with scratch(chunks.sparkSession):
        return _fitted(_stored(chunks.select(text), features, text), dim, passes, features)


def learnt(chunks: DataFrame, dim: int = DIM, passes: int = PASSES, features: int = FEATURES, text: str = "content") -> tuple[LatentEmbedder, DataFrame]:
    """`learn`, and the chunks with their embedding in place of their text, which is read and cut but once. Such a text is no query: one
    that begins as `QUERY` keeps these words."""
    rows = _stored(chunks.drop("embedding"), features, text)
    m = _fitted(rows, dim, passes, features)
    fields = [f for f in rows.schema.fields if f.name not in ("features", "counts")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * m.dim)
            flat = pa.array(m.of_counts(b).astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], pa.ListArray.from_arrays(ends, flat)], [*(f.name for f in fields), "embedding"])

    return m, rows.mapInArrow(go, StructType([*fields, StructField("embedding", ArrayType(FloatType()))]))
