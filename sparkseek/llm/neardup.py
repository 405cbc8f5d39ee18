"""Near-duplicate detection by ProbMinHash, banding and verification.

Shingles of `WORDS` words (case and punctuation aside), weighted by how often they occur, are taken as independent Poisson
processes whose rate is the weight. Each arrival falls on a random component of the signature, which keeps the element that
arrives first; a document's processes end as soon as they are later than all of its components (early termination). Two
signatures then agree in a component with the probability Jaccard similarity of the weighted sets as chance. `BANDS` bands of
`ROWS` components find candidates, and every link is verified by the exact probability Jaccard of the texts, `SIMILAR` or more.

Texts with the same words are one node, with the least doc_id. In a bucket of a band each node is compared with one centre
only, the least; nodes that this leaves in different components are then compared pair by pair. So buckets of alike texts,
however large, give a row per node, and no link between nodes that share a bucket is lost as far as classes go.

Defined results: a class is named by its least doc_id; texts of fewer than `WORDS` words are one shingle; texts without words
(null, empty, punctuation only) are a class together; a null doc_id has a null class; rows that share a doc_id share its class;
extra columns are ignored by `classes` and kept by `deduplicate`, whatever their names; very long texts are used whole, and
compared in blocks that hold few of them; empty tables give empty results; links whose components haven't settled after 60
rounds (each at least halves long chains) raise RuntimeError.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import caches, fresh_name, table, task_of
from sparkseek.llm.components import components
from sparkseek.session import materialise

WORDS, SIMILAR = 5, 0.8
#: A pair at similarity 0.8 shares no band with a chance of 0.672^26 = 3e-5.
BANDS, ROWS = 26, 5
#: Components that agree of 130, for nodes in different components: five deviations below what similarity 0.8 gives.
ALIKE = 80
#: Nodes of a bucket, and characters of their texts, compared with each other in one task.
BLOCK, BLOCK_CHARS = 2048, 16 << 20
#: Characters of text whose signatures are made together.
PIECE = 1 << 20
_WORD = re.compile(r"\w+")
_U = np.uint64
#: Hashes of words met before; dropped when they are many, and when the worker turns to another operator.
_HASHES: dict[str, int] = {}
caches("neardup", _HASHES.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashed(words: list[str]) -> list[int]:
    if len(_HASHES) > 100_000:
        _HASHES.clear()
    get = _HASHES.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return out


def shingles(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of all texts' weighted shingles, in order. Elements have 44 bits."""
    n = np.array([len(w) for w in texts], np.int64)
    every = np.array(_hashed([w for t in texts for w in t]), _U)
    if not len(every):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0)
    start = np.cumsum(n) - n
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(texts)), count)
    first = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    h = np.zeros(len(first), _U)
    length = np.minimum(n, WORDS)[text]
    for k in range(WORDS):
        w = every[np.minimum(first + k, len(every) - 1)]
        h = np.where(k < length, h * _U(0x9E3779B97F4A7C15) + _mix(w + _U(k + 1)), h)
    key, weight = np.unique((text.astype(_U) << _U(44)) | (_mix(h) >> _U(20)), return_counts=True)
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1), weight.astype(np.float64)


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n rows of m components, each an element; rows of texts without elements are 0."""
    first = np.full(n * m, np.inf)
    out = np.zeros(n * m, _U)
    latest = np.full(n, np.inf)
    seed, at = _mix(element + _U(1)), np.zeros(len(element))
    r, step = 1, 1
    text, weight = text.copy(), weight.copy()
    with np.errstate(over="ignore"):
        while len(text):
            bits = _mix(seed[:, None] + np.arange(r, r + step, dtype=_U) * _U(0x9E3779B97F4A7C15))
            gap = -np.log(((bits >> _U(24)).astype(np.float64) + 0.5) / (1 << 40)) / weight[:, None]
            when = at[:, None] + np.cumsum(gap, 1)
            slot = text[:, None] * m + (((bits & _U((1 << 24) - 1)) * _U(m)) >> _U(24)).astype(np.int64)
            soon = when <= latest[text][:, None]
            k, x = slot[soon], when[soon]
            np.minimum.at(first, k, x)
            won = x == first[k]
            out[k[won]] = np.broadcast_to(element[:, None], when.shape)[soon][won]
            touched = np.unique(text)
            latest[touched] = first.reshape(n, m)[touched].max(1)
            at = when[:, -1]
            go = at <= latest[text]
            text, weight, seed, at, element = text[go], weight[go], seed[go], at[go], element[go]
            r, step = r + step, min(step * 2, 64)
    return out.reshape(n, m)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band."""
    h = np.zeros((len(sig), BANDS), _U)
    rows = sig.reshape(len(sig), BANDS, ROWS)
    for k in range(ROWS):
        h = h * _U(0x9E3779B97F4A7C15) + _mix(rows[:, :, k] + _U(k + 1))
    return _mix(h + np.arange(1, BANDS + 1, dtype=_U)).view(np.int64)


def weighted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    _, e, w = shingles([words])
    return e, w


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared elements d of 1 / sum over all elements e of max(x_e/x_d, y_e/y_d)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    both = np.flatnonzero((x > 0) & (y > 0))
    at = np.searchsorted(ratio, ratio[both])  # from here on x decides, before it y
    above = np.append(np.cumsum(x[::-1])[::-1], 0)[at]
    below = np.append(0, np.cumsum(y))[at]
    return float((1 / (above / x[both] + below / y[both])).sum())


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (of the text's words), band keys (null for a text without words) and the signature with a byte for each component."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("neardup")
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size, words = i, 0, []
                while j < len(texts) and (j == i or size + len(texts[j] or "") < PIECE):
                    words.append(words_of(texts[j]))
                    size += len(texts[j] or "")
                    j += 1
                keys = [hashlib.md5(" ".join(w).encode("utf-8", "surrogatepass")).digest() for w in words]
                sig = signatures(*shingles(words), len(words))
                bands, short = bands_of(sig), (_mix(sig) & _U(255)).astype(np.uint8)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(words) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()), mask=pa.array([not w for w in words])
                )
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(keys, pa.binary()), flat, pa.array([r.tobytes() for r in short], pa.binary()), pa.array([len(t or "") for t in texts[i:j]], pa.int64())], ["doc_id", "key", "bands", "short", "size"])
                i = j

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(go, "doc_id long, key binary, bands array<long>, short binary, size long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose texts (node, text) are similar, with the similarity."""
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}

        def own(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if node not in known:
                if len(known) >= 2000:
                    known.clear()
                known[node] = weighted(words_of(text))
            return known[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i, j, s, t in zip(a, b, ta, tb, strict=True):
                p = probability_jaccard(own(i, s), own(j, t))
                if p >= SIMILAR:
                    out.append((i, j, p))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(go, "a long, b long, similarity double")


def links(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row with a doc_id, and verified links between nodes that connect what is similar."""
    sig = materialise(signed(docs, text).where(F.col("doc_id").isNotNull()), "signed")
    nodes = sig.groupBy("key").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("short", "doc_id").alias("short"), F.max("size").alias("size"))
    nodes = materialise(nodes, "nodes")
    members = sig.select("doc_id", "key").join(nodes.select("key", "node"), "key").select("doc_id", "node")
    rows = nodes.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("band"))
    centres = rows.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").select("band", "centre")
    near = materialise(rows.join(centres, "band"), "buckets")  # only buckets of several nodes
    some = near.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col(text).alias("text")).join(some, "node", "left_semi")
    # A doc_id that occurs with several texts keeps the one by which it is a node, if any.
    texts = materialise(texts, "texts")
    star = near.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    found = materialise(verified(star, texts), "verified")
    comp = components(found)
    # What one centre could not tell: nodes of a bucket in different components.
    placed = near.join(comp.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    placed = placed.join(nodes.select("node", "short", "bands", "size"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_CHARS))
    mixed = placed.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), blocks.alias("blocks")).where("c0 < c1").select("band", "blocks")
    left = placed.join(mixed, "band").join(texts, "node").select("band", "blocks", "node", "c", "short", "bands", "text")
    return members, found.unionByName(materialise(_joined_up(left), "verified"))


def _joined_up(rows: DataFrame) -> DataFrame:
    """Verified links between nodes of one bucket and different components: all that are needed to connect them.

    Pairs whose signatures agree in `ALIKE` components or more are verified, the most alike first, unless links found before
    already connect them; each in the first bucket that they share. Buckets of more than `BLOCK` nodes or `BLOCK_CHARS` characters are cut
    into blocks at random, and each pair of blocks is compared by itself."""
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("node", F.lit(5)), blocks)
    data = ("node", "c", "short", "bands", "text")
    dealt = rows.withColumn("own", own).select(
        "band", *data, "own", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
    ).select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *data)
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")

    def compare(group: list[tuple]) -> list[tuple[int, int, float]]:
        band, i, j, own, node, c, short, bands, text = zip(*group, strict=True)
        own, c = np.array(own), np.array(c, np.int64)
        sig, keys = np.frombuffer(b"".join(short), np.uint8).reshape(len(node), -1), np.array(bands, np.int64)
        place = int(np.argmax(keys[0] == band[0]))
        pairs = []
        for k in range(len(node) - 1):
            others = np.flatnonzero(c[k + 1 :] != c[k]) + k + 1
            if i[0] != j[0]:
                others = others[own[others] != own[k]]
            if len(others):
                same = (sig[others] == sig[k]).sum(1)
                others, same = others[same >= ALIKE], same[same >= ALIKE]
            if len(others):
                new = ~(keys[others, :place] == keys[k, :place]).any(1)
                pairs.append(np.column_stack([same[new], np.full(new.sum(), k), others[new]]))
        out: list[tuple[int, int, float]] = []
        if not pairs:
            return out
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        every = np.concatenate(pairs)
        known: dict[int, tuple] = {}
        label = c.tolist()
        for _, a, b in every[np.argsort(-every[:, 0], kind="stable")].tolist():
            ra, rb = root(label[a]), root(label[b])
            if ra == rb:
                continue
            for k in (a, b):
                if k not in known:
                    known[k] = weighted(words_of(text[k]))
            p = probability_jaccard(known[a], known[b])
            if p >= SIMILAR:
                parent[ra] = rb
                out.append((node[a], node[b], p))
        return out

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def out(rows_: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*(compare(rows_) if len(rows_) > 1 else []), strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[:3] != at:
                    yield out(group)
                    at, group = row[:3], []
                group.append(row)
        yield out(group)

    return dealt.mapInArrow(go, "a long, b long, similarity double")


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, class_id for every row of docs."""
    members, found = links(docs, text)
    comp = components(found)
    got = members.join(comp, members["node"] == comp["node"], "left").select("doc_id", F.coalesce("component", members["node"]).alias("class_id"))
    none = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"))
    return got.unionByName(none)


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The row of each class with the least doc_id; of rows that repeat that doc_id, one. Rows without doc_id stay."""
    n, key = fresh_name(docs, "n_rows"), fresh_name(docs, "class_id")
    keep = classes(docs, text).where("doc_id = class_id").groupBy(F.col("class_id").alias(key)).agg(F.count(F.lit(1)).alias(n))
    got = docs.join(keep, F.col("doc_id") == F.col(key)).drop(key)
    once = got.where(F.col(n) == 1).drop(n)
    return once.unionByName(got.where(F.col(n) > 1).dropDuplicates(["doc_id"]).drop(n)).unionByName(docs.where(F.col("doc_id").isNull()))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_neardup": op4_neardup}
