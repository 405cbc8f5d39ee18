"""Language ID by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts, order `ORDER` down to 0, with frozen counts from a bounded sample
of labelled texts. A byte's code length is that of the longest context in which it was seen, plus the escapes from the
longer ones (method C: a context with n bytes of d kinds gives kind counts c/(n+d) and its escape d/(n+d); contexts never
seen cost nothing), and 8 bits where no context knows it. Exclusion is left out. Statistics being frozen, a code length
depends on the last `ORDER`+1 bytes alone; so distinct ones are looked up once per batch, and a document's length is an
exact sum. The shortest code wins; the score is its posterior among the languages.

Texts are scored lower case, in UTF-8, whole, after `ORDER` line feeds. Defined results: `und` with score 0 for null, empty
and letterless texts, and for all if there is nothing to learn from; ties go to the language first by name; extra columns
pass through (of a name that clashes with an output, the output stays); very long texts are scored whole, piece by piece; rows may repeat; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkseek.llm.common import by_place, held_out, table, task_of

ORDER = 4
#: Bounds of the labelled sample of each language: documents, and their characters (of longer ones, the beginning is taken); and of all
#: languages together, which bounds the model. Many languages share it: first by shorter beginnings, `LEAST_CHARS` at least, then by fewer documents.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL, LEAST_CHARS = 400, 20_000, 32_000_000, 2_000
#: Languages whose code lengths share a table; each table has a column for each, so more of them would waste memory.
GROUP = 8
#: Languages whose shares of the sample (a row each) are broadcast; beyond, they are joined.
MANY = 10_000
#: Bytes scored at once.
PIECE = 1 << 20
UND = "und"


def grams(data: np.ndarray) -> np.ndarray:
    """For each byte after the first `ORDER`, it and the bytes before it as one number; its own byte is lowest."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with their leading line feeds as one byte array, and where each starts."""
    raw = [b"\n" * ORDER + t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends


class Model:
    """Code lengths of all languages, in groups of `GROUP`: for each order, sorted grams with a row of bits (inf: not seen) and sorted contexts with a row of escape bits."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.groups = [self._levels([counts[k] for k in self.languages[i : i + GROUP]]) for i in range(0, len(self.languages), GROUP)]

    @classmethod
    def _levels(cls, counts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
        levels = []
        for order in range(ORDER, -1, -1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            per = []
            for g, n in counts:
                keys, inverse = np.unique(g & mask, return_inverse=True)
                c = np.bincount(inverse, weights=n.astype(np.float64))
                ctx, first = np.unique(keys >> np.uint64(8), return_index=True)
                total = np.add.reduceat(c, first)
                kinds = np.diff(np.append(first, len(keys)))
                bits = np.log2(np.repeat(total + kinds, kinds) / c)
                per.append((keys, bits, ctx, np.log2((total + kinds) / kinds)))
            levels.append((*cls._merged([(p[0], p[1]) for p in per], np.inf), *cls._merged([(p[2], p[3]) for p in per], 0.0)))
        return levels

    @staticmethod
    def _merged(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([p[0] for p in parts]))
        table_ = np.full((len(keys) + 1, len(parts)), missing, np.float32)  # the last row: keys that nobody has
        for k, (own, v) in enumerate(parts):
            table_[np.searchsorted(keys, own), k] = v
        return keys, table_

    @staticmethod
    def _rows(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, asked)
        return np.where(keys[np.minimum(at, len(keys) - 1)] == asked, at, len(keys))

    def _bits(self, gram: np.ndarray, levels: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Code lengths of grams (sorted ones are looked up faster), by language of a group."""
        out = np.zeros((len(gram), levels[0][1].shape[1]), np.float64)
        open_ = np.ones(out.shape, bool)
        for order, (keys, bits, contexts, escapes) in zip(range(ORDER, -1, -1), levels, strict=True):
            part = gram & np.uint64((1 << 8 * (order + 1)) - 1)
            b = bits[self._rows(keys, part)]
            seen = open_ & np.isfinite(b)
            out += np.where(seen, b, 0.0)
            open_ &= ~seen
            out += np.where(open_, escapes[self._rows(contexts, part >> np.uint64(8))], 0.0)
        return out + np.where(open_, 8.0, 0.0)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths in bits of whole texts, by language."""
        out = np.zeros((len(texts), len(self.languages)))
        batch: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            batch.append(i)
            size += len(t)
            if size >= PIECE or i + 1 == len(texts):
                out[batch] = self._lengths([texts[k] for k in batch])
                batch, size = [], 0
        return out

    def _lengths(self, texts: list[str]) -> np.ndarray:
        data, ends = _joined(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        starts = np.concatenate([[0], ends[:-1]])
        for a in range(0, max(len(data) - ORDER, 0), PIECE):  # a very long text comes in several pieces
            g = grams(data[a : a + PIECE + ORDER])
            uniq, inverse = np.unique(g, return_inverse=True)
            at = np.arange(a + ORDER, a + ORDER + len(g))
            doc = np.searchsorted(ends, at, side="right")
            own = at - starts[doc] >= ORDER  # not the line feeds before a text
            doc, inverse = doc[own], inverse[own]
            if len(doc) == 0:
                continue
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            for i, levels in enumerate(self.groups):
                cost = self._bits(uniq, levels)
                for k in range(cost.shape[1]):
                    sums[doc[first], i * GROUP + k] += np.add.reduceat(cost[inverse, k], first)
        return sums


def sample_size(n_languages: int) -> tuple[int, int]:
    """Documents of each language, and their characters, so that all languages keep within `SAMPLE_ALL`."""
    chars = max(LEAST_CHARS, min(SAMPLE_CHARS, SAMPLE_ALL // (SAMPLE_DOCS * max(1, n_languages))))
    return max(1, min(SAMPLE_DOCS, SAMPLE_ALL // (chars * max(1, n_languages)))), chars


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Counts over at most `SAMPLE_DOCS` labelled texts of each language that aren't held out; None if there are none."""
    size = F.length(text)
    known = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id) & (F.col(lang) != UND) & (size > 0))
    n_languages = known.agg(F.count_distinct(lang)).first()[0]
    n_docs, n_chars = sample_size(n_languages)
    # Twice the sample by a threshold, so that the exact choice sorts a bounded number of rows. A language has one row here.
    per = known.groupBy(F.col(lang).alias("lang")).agg(F.least(F.lit(1.0), 2.0 * n_docs / F.count(F.lit(1))).alias("share"))
    order = F.xxhash64(F.col(doc_id).cast("string"), F.lit(17))
    piece = F.substring(F.col(text), 1, n_chars)
    per = F.broadcast(per) if n_languages <= MANY else per
    some = known.select(F.col(lang).alias("lang"), piece.alias("text"), (size > n_chars).alias("long"), order.alias("order")).join(per, "lang")
    some = some.where(F.pmod("order", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    # Beginnings of long texts where there are too few others.
    ranked = some.select("lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy("long", "order", "text")).alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lang_ in sorted(set(langs)):
                data, ends = _joined([t for own, t in zip(langs, texts, strict=True) if own == lang_])
                g = grams(data)
                at = np.arange(ORDER, len(data))
                starts = np.concatenate([[0], ends[:-1]])
                g = g[at - starts[np.searchsorted(ends, at, side="right")] >= ORDER]
                keys, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = ranked.where(F.col("n") <= n_docs).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return None
    return Model({k: (x["gram"].to_numpy().astype(np.uint64), x["n"].to_numpy()) for k, x in got.groupby("lang")})


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and bits_per_byte (of the winner)."""
    names = ("lang_pred", "score", "bits_per_byte")
    base, kept, at = by_place(docs, text, names)
    schema = T.StructType(
        [*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    flag = base.withColumn("letters", F.coalesce(F.col(f"_{at}").rlike(r"\p{L}"), F.lit(False)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("langid")
        m = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            use = np.flatnonzero(b.column(len(kept)).to_numpy(zero_copy_only=False)).tolist() if m is not None else []
            pred, score, rate = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if use:
                bits = m.lengths([texts[i] for i in use])
                best = bits.argmin(1)
                least = bits[np.arange(len(use)), best]
                score[use] = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(1)
                rate[use] = least / np.array([max(1, len(texts[i].lower().encode("utf-8", "surrogatepass"))) for i in use])
                for i, k in zip(use, best.tolist(), strict=True):
                    pred[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], [*b.schema.names[: len(kept)], *names]
            )

    return flag.mapInArrow(go, schema).toDF(*kept, *names)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")


QUERIES = {"op1_langid": op1_langid}
