"""Ranked lexical search over a clustered index whose documents are put in order by recursive graph bisection.

Bisection: documents and terms are a graph; a set of documents is halved so that the postings of both halves have small gaps, by
exchanging the pairs of documents that gain most until none gains. The upper `DEPTH` levels are fitted on a bounded sample (`SAMPLE`
documents with the least hashes, each of `SAMPLE_CHARS` characters at most; at most `NODE_TERMS` terms of each halving are kept) and
every document is led down that tree by the gain of its terms. A leaf is dealt out by hash to as many shards as its postings fill, and
each shard is bisected itself, over all its documents and terms, down to clusters of `CLUSTER_DOCS`.

Index: one row for each shard (documents in their new order, terms, and for each term its places and impacts), of about
`SHARD_POSTINGS` postings, so a shard is the most that a task holds. Nothing but documents on their way to their shard is shuffled.

Search: the bound of a cluster is the sum of each term's weight times its greatest impact there. Each item first visits the shards of
its greatest bounds; its k-th score so far is its threshold. Then every shard is looked at, each item visits the clusters whose bound
reaches its threshold, greatest first, and stops at the first one below; a bound equal to the threshold is visited, as ties go by
doc_id. So results are exact. Items are broadcast in blocks of bounded size, with a pass over the index for each block.

Defined results: a document without terms isn't one (it counts nowhere). Rows that repeat a doc_id are documents of their own; equal
scores go by doc_id, null last. Rows that repeat an item_id are one item with the terms of all; null is an item too. Items without
terms, or whose terms no document has, have no rows. Rows that repeat both doc_id and text meet in one shard. Only doc_id, text and
item_id are read, so other columns may have any name."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.llm.common import table
from sparkseek.session import delete, materialise, shared_dir

K = 50
SAMPLE, SAMPLE_CHARS, DEPTH, NODE_DOCS, NODE_TERMS = 4096, 20_000, 5, 64, 2000
SHARD_POSTINGS, CLUSTER_DOCS, ROUNDS = 800_000, 512, 8
#: Shards that an item visits for its threshold; items and terms of a block of items, about.
FIRST, BLOCK_ITEMS, BLOCK_TERMS = 2, 256, 20_000

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Letters A-Z in lower case, bytes that are in no term as spaces.
_BYTES = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEPT else b if b in _KEPT else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order. No byte of a longer character is one that separates terms."""
    return text.translate(_BYTES).split()


# --- bisection ----------------------------------------------------------------------------------------------------------


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits of the gaps of postings with such degrees among n documents."""
    return degree * np.log2(n / (degree + 1.0))


def halve(starts: np.ndarray, terms: np.ndarray, n_terms: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the documents in `order`. Document d has terms[starts[d]:starts[d + 1]]; ties keep the order as it was."""
    n = len(order)
    long = starts[order + 1] - starts[order]
    at = np.repeat(starts[order] - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(long.sum())
    own, doc = terms[at], np.repeat(np.arange(n), long)
    side = np.arange(n) >= (n + 1) // 2
    n_left, n_right = int((~side).sum()), int(side.sum())
    both = np.bincount(own, minlength=n_terms)
    for _ in range(ROUNDS):
        right = np.bincount(own[side[doc]], minlength=n_terms)
        left = both - right
        now = _cost(left, n_left) + _cost(right, n_right)
        to_right = now - _cost(np.maximum(left - 1, 0), n_left) - _cost(right + 1, n_right)
        to_left = now - _cost(left + 1, n_left) - _cost(np.maximum(right - 1, 0), n_right)
        gain = np.bincount(doc, weights=np.where(side[doc], to_left[own], to_right[own]), minlength=n)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swaps = int((gain[a[:m]] + gain[b[:m]] > 1e-9).sum())  # both fall, so these come first
        if not swaps:
            break
        side[a[:swaps]], side[b[:swaps]] = True, False
    return order[~side], order[side]


def bisect(starts: np.ndarray, terms: np.ndarray, n_terms: int, most: int = CLUSTER_DOCS) -> list[np.ndarray]:
    """Clusters of at most so many documents, in their new order."""
    todo, out = [np.arange(len(starts) - 1)], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            out.append(part)
        else:
            todo.extend(reversed(halve(starts, terms, n_terms, part)))
    return out


def _numbered(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """starts, term numbers and terms of lists of terms."""
    ids: dict[bytes, int] = {}
    numbers = np.array([ids.setdefault(t, len(ids)) for x in lists for t in x], np.int64)
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), numbers, list(ids)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of the sample: node, term, weight (over 0: to the right); the empty term has the node's threshold."""
    starts, numbers, names = _numbered([sorted(set(terms_of(t))) for b in batches for t in b.column("text").to_pylist()])
    rows: list[tuple[int, bytes, float]] = []
    todo = [(0, np.arange(len(starts) - 1))]
    while todo:
        node, part = todo.pop()
        if len(part) < NODE_DOCS or node >= 2**DEPTH - 1:
            continue
        a, b = halve(starts, numbers, len(names), part)
        degree = [np.bincount(np.concatenate([numbers[starts[d] : starts[d + 1]] for d in x]), minlength=len(names)) for x in (a, b)]
        more = [_cost(d + 1, len(x)) - _cost(d, len(x)) for d, x in zip(degree, (a, b), strict=True)]
        weight = more[0] - more[1]
        worth = np.abs(weight) * (degree[0] + degree[1] > 1) * (degree[0] + degree[1])
        keep = np.argsort(-worth, kind="stable")[:NODE_TERMS]
        keep = keep[worth[keep] > 0]
        kept = np.zeros(len(names))
        kept[keep] = weight[keep].astype(np.float32)
        score = np.array([kept[numbers[starts[d] : starts[d + 1]]].sum() for d in part])
        middle = float(np.median(score))
        left, right = part[score <= middle], part[score > middle]
        if not len(left) or not len(right):
            continue
        rows += [(node, b"", middle), *((node, names[t], float(kept[t])) for t in keep.tolist())]
        todo += [(2 * node + 1, left), (2 * node + 2, right)]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.float64()), strict=True)], ["node", "term", "weight"])


class Tree:
    """Leads documents to leaves."""

    def __init__(self, rows: list[tuple[int, bytes, float]]):
        self.at: dict[bytes, int] = {}
        self.middle = {node: w for node, t, w in rows if not t}
        for _, t, _ in rows:
            if t:
                self.at.setdefault(bytes(t), len(self.at))
        self.weights = np.zeros((len(self.at), max(self.middle, default=0) + 1), np.float64)
        for node, t, w in rows:
            if t:
                self.weights[self.at[bytes(t)], node] = w

    def leaf(self, terms: list[bytes]) -> int:
        known = [self.at[t] for t in terms if t in self.at]
        own, node = self.weights[known] if known and self.middle else None, 0
        while node in self.middle:
            node = 2 * node + 1 + int((own[:, node].sum() if own is not None else 0.0) > self.middle[node])
        return node


def fit(docs: DataFrame) -> list[tuple[int, bytes, float]]:
    """The upper levels, from a bounded sample."""
    some = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).withColumn("_h", F.xxhash64("doc_id", "text"))
    top = some.select("_h").orderBy("_h").limit(SAMPLE).agg(F.max("_h").alias("h")).first().h
    if top is None:
        return []
    sample = some.where(F.col("_h") <= top).orderBy("_h", "doc_id").limit(SAMPLE).select(F.col("text").cast("binary").alias("text"))
    rows = sample.coalesce(1).mapInArrow(_fit, "node int, term binary, weight double").collect()
    return [(r.node, bytes(r.term), r.weight) for r in rows]


# --- index --------------------------------------------------------------------------------------------------------------

_DOC = "doc_id long, leaf int, hash long, n long, terms binary, tfs binary"
_SHARD = "shard int, docs binary, known binary, cuts binary, terms binary, df binary, best binary, places binary, impacts binary"


def _led(tree: Tree, counts_only: bool):
    """Terms, counts and leaf of each document, or only the sums of the leaves: documents, tokens and postings."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for b in batches:
            out: list[tuple] = []
            for doc_id, h, text in zip(b.column("doc_id").to_pylist(), b.column("hash").to_pylist(), b.column("text"), strict=True):
                raw = text.as_py()
                counts = Counter(terms_of(raw)) if raw else None
                if not counts:
                    continue
                leaf, n = tree.leaf(list(counts)), sum(counts.values())
                if counts_only:
                    s = sums.setdefault(leaf, [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + 1, s[1] + n, s[2] + len(counts)
                else:
                    out.append((doc_id, leaf, h, n, b" ".join(counts), np.fromiter(counts.values(), np.uint32).tobytes()))
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "leaf", "hash", "n", "terms", "tfs"])
        if counts_only and sums:
            cols = ([k for k in sums], *([v[i] for v in sums.values()] for i in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 3), strict=True)], ["leaf", "docs", "tokens", "postings"])

    return go


def impact_divisor(n: int, docs: int, tokens: int) -> int:
    """m of a document with n terms."""
    return 100 - 50 + (50 * n * docs) // tokens


def _built(n_docs: int, n_tokens: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """The index of one shard."""

    def go(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("hash", "ascending")])
        starts, numbers, names = _numbered([t.split(b" ") for t in group.column("terms").to_pylist()])
        tf = np.frombuffer(b"".join(group.column("tfs").to_pylist()), np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        alone = np.bincount(numbers, minlength=len(names)) < 2  # terms of one document don't tell where it belongs
        linked = ~alone[numbers]
        clusters = bisect(np.concatenate([[0], np.cumsum(np.bincount(doc[linked], minlength=len(starts) - 1))]), numbers[linked], len(names), most)
        order = np.concatenate(clusters)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = np.array([impact_divisor(n, n_docs, n_tokens) for n in group.column("n").to_pylist()], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        rank = np.empty(len(names), np.int64)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        rank[by_name] = np.arange(len(names))
        key = rank[numbers] * len(order) + place[doc]
        by = np.argsort(key, kind="stable")
        df = np.bincount(rank[numbers], minlength=len(names))
        first = np.concatenate([[0], np.cumsum(df)[:-1]])
        ids = group.column("doc_id").to_numpy(zero_copy_only=False) if not group.column("doc_id").null_count else np.array([x or 0 for x in group.column("doc_id").to_pylist()], np.int64)
        row = {
            "docs": ids.astype(np.int64)[order].tobytes(), "known": np.array([x is not None for x in group.column("doc_id").to_pylist()], np.uint8)[order].tobytes(),
            "cuts": np.cumsum([0, *map(len, clusters)]).astype(np.uint32).tobytes(), "terms": b" ".join(names[i] for i in by_name), "df": df.astype(np.uint32).tobytes(),
            "best": np.maximum.reduceat(impact[by], first).astype(np.uint32).tobytes(), "places": place[doc][by].astype(np.uint32).tobytes(), "impacts": impact[by].astype(np.uint32).tobytes(),
        }
        return pa.table([pa.array([group.column("shard")[0].as_py()], pa.int32()), *(pa.array([v], pa.binary()) for v in row.values())], names=["shard", *row])

    return go


@dataclass
class Index:
    """shards: the table; docs and tokens: N and L."""

    shards: DataFrame
    path: str
    docs: int
    tokens: int


def build_index(docs: DataFrame, shard_postings: int = SHARD_POSTINGS, cluster_docs: int = CLUSTER_DOCS) -> Index:
    """docs: doc_id, text. The table of shards lies in the shared folder until the caller deletes it."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tree = Tree(fit(own))
    raw = own.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), F.col("text").cast("binary").alias("text"))
    sums = raw.mapInArrow(_led(tree, True), "leaf int, docs long, tokens long, postings long").groupBy("leaf").agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "postings")]).orderBy("leaf").collect()
    n, tokens = sum(r.docs for r in sums), sum(r.tokens for r in sums)
    path = f"{shared_dir(spark)}/sparkseek-ranked-{uuid.uuid4().hex}"
    first, shard = 0, F.lit(0)
    for r in sums:
        parts = -(-r.postings // shard_postings)
        shard, first = F.when(F.col("leaf") == r.leaf, F.pmod(F.col("hash"), F.lit(parts)) + first).otherwise(shard), first + parts
    led = raw.mapInArrow(_led(tree, False), _DOC).withColumn("shard", shard.cast("int"))
    led.groupBy("shard").applyInArrow(_built(n, max(1, tokens), cluster_docs), _SHARD).write.option("compression", "zstd").parquet(path)
    return Index(spark.read.schema(_SHARD).parquet(path), path, n, tokens)


# --- search -------------------------------------------------------------------------------------------------------------


def weight(n: int, df: int) -> int:
    """w of a term that df of n documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Some items: for each the numbers and weights of its terms in `terms`."""

    terms: dict[bytes, int]
    items: list[tuple[np.ndarray, np.ndarray]]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: distinct."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t) for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for t in dict.fromkeys(terms_of(text or b""))]
            if rows:
                ids, terms = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(go, "item_id long, term binary").distinct()


def _array(row: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(row.as_buffer(), kind).astype(np.int64)


def _present(terms: dict[bytes, int], names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a shard's terms, and numbers in a block's, of the terms that both have."""
    got = [(i, terms[t]) for i, t in enumerate(names) if t in terms]
    return np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.int64)


def _frequencies(terms: dict[bytes, int]):
    """Documents of this task with each term of the items."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for b in batches:
            for names, each in zip(b.column("terms"), b.column("df"), strict=True):
                here, number = _present(terms, names.as_py().split(b" "))
                df[number] += _array(each, np.uint32)[here]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["number", "df"])

    return go


def _widest(block: Block):
    """The shards of greatest bound of each item, as far as this task sees."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple[int, int]]] = [[] for _ in block.items]
        for b in batches:
            for shard, names, best in zip(b.column("shard").to_pylist(), b.column("terms"), b.column("best"), strict=True):
                here, number = _present(block.terms, names.as_py().split(b" "))
                most = np.zeros(len(block.terms), np.int64)
                most[number] = _array(best, np.uint32)[here]
                for k, (own, w) in enumerate(block.items):
                    top[k] = sorted([*top[k], (-int((most[own] * w).sum()), shard)])[:FIRST]
        rows = [(k, shard, -bound) for k, x in enumerate(top) for bound, shard in x if bound]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["item", "shard", "bound"])

    return go


class Shard:
    """A shard as far as a block of items needs it."""

    def __init__(self, row: dict, block: Block):
        self.docs, self.known, self.cuts = _array(row["docs"], np.int64), np.frombuffer(row["known"].as_buffer(), np.uint8), _array(row["cuts"], np.uint32)
        here, number = _present(block.terms, row["terms"].as_py().split(b" "))
        df = _array(row["df"], np.uint32)
        ends = np.cumsum(df)
        places, impacts = np.frombuffer(row["places"].as_buffer(), np.uint32), np.frombuffer(row["impacts"].as_buffer(), np.uint32)
        self.at = {}
        self.best = np.zeros((len(block.terms), len(self.cuts) - 1), np.int64)
        for i, v in zip(here.tolist(), number.tolist(), strict=True):
            a, z = int(ends[i] - df[i]), int(ends[i])
            p, x = places[a:z].astype(np.int64), impacts[a:z].astype(np.int64)
            parts = np.searchsorted(p, self.cuts)
            full = np.flatnonzero(parts[:-1] < parts[1:])
            self.best[v, full] = np.maximum.reduceat(x, parts[full])
            self.at[v] = p, x, parts

    def scores(self, own: list[int], w: list[int], cluster: int) -> np.ndarray:
        start = self.cuts[cluster]
        out = np.zeros(self.cuts[cluster + 1] - start, np.int64)
        for v, weight_ in zip(own, w, strict=True):
            if v in self.at and self.best[v, cluster]:
                p, x, parts = self.at[v]
                a, z = parts[cluster], parts[cluster + 1]
                out[p[a:z] - start] += weight_ * x[a:z]
        return out


def _visited(block: Block, k: int, floors: list[int], only: dict[int, set[int]] | None, done: dict[int, set[int]]):
    """The k best documents of each item in this task: item, doc_id, score, and as item -1 how many clusters there were for the
    items together, and how many were visited. only, done: by shard, the items to serve, or to leave out."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        best = [(empty, empty, empty)] * len(block.items)  # score, unknown id, id
        met = visits = 0
        for b in batches:
            for i in range(b.num_rows):
                number = b.column("shard")[i].as_py()
                serve = sorted((only.get(number, set()) if only is not None else set(range(len(block.items)))) - done.get(number, set()))
                if not serve:
                    continue
                shard = Shard({c: b.column(c)[i] for c in b.schema.names}, block)
                for item in serve:
                    own, w = block.items[item]
                    bounds = (shard.best[own] * w[:, None]).sum(0)
                    met += len(bounds)
                    for cluster in np.argsort(-bounds, kind="stable").tolist():
                        s, u, d = best[item]
                        floor = max(1, floors[item], int(s[-1]) if len(s) == k else 0)
                        if bounds[cluster] < floor:
                            break
                        visits += 1
                        got = shard.scores(own.tolist(), w.tolist(), cluster)
                        hit = np.flatnonzero(got >= floor)
                        if len(hit):
                            at = hit + shard.cuts[cluster]
                            s, u, d = np.concatenate([s, got[hit]]), np.concatenate([u, 1 - shard.known[at].astype(np.int64)]), np.concatenate([d, shard.docs[at]])
                            first = np.lexsort((d, u, -s))[:k]
                            best[item] = s[first], u[first], d[first]
        for item, (s, u, d) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), item, np.int32)), pa.array(d, mask=u.astype(bool)), pa.array(s)], ["item", "doc_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([met], pa.int64()), pa.array([visits], pa.int64())], ["item", "doc_id", "score"])

    return go


_HIT = "item int, doc_id long, score long"


def _ranked(hits: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_block(index: Index, terms: dict[int, list[bytes]], k: int) -> DataFrame:
    """item, doc_id, score (of each task's best; the rows of item -1 count clusters). terms: of each item, by its place in the block."""
    numbers = {t: i for i, t in enumerate(sorted({t for x in terms.values() for t in x}))}
    found = index.shards.select("terms", "df").mapInArrow(_frequencies(numbers), "number int, df long").groupBy("number").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(len(numbers), np.int64)
    for r in found:
        weights[r.number] = weight(index.docs, r.df)
    items = []
    for i in range(len(terms)):
        own = np.array([numbers[t] for t in terms[i]], np.int64)
        own = own[weights[own] > 0]
        items.append((own, weights[own]))
    block = Block(numbers, items)
    wide = index.shards.select("shard", "terms", "best").mapInArrow(_widest(block), "item int, shard int, bound long")
    w = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    only: dict[int, set[int]] = {}
    for r in wide.withColumn("n", F.row_number().over(w)).where(F.col("n") <= FIRST).collect():
        only.setdefault(r.shard, set()).add(r.item)
    first = index.shards.where(F.col("shard").isin(*only)) if only else index.shards.where(F.lit(False))
    first = materialise(first.mapInArrow(_visited(block, k, [0] * len(items), only, {}), _HIT), "first")
    floors = [0] * len(items)
    for r in _ranked(first.where("item >= 0"), "item", k).where(F.col("rank") == k).collect():
        floors[r.item] = r.score
    rest = index.shards.mapInArrow(_visited(block, k, floors, None, only), _HIT)
    return first.unionByName(materialise(rest, "rest"))


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. items: item_id, text."""
    spark = index.shards.sparkSession
    terms = materialise(item_terms(items), "items")
    sizes = terms.agg(F.count_distinct(F.struct("item_id")).alias("items"), F.count(F.lit(1)).alias("terms")).first()
    blocks = max(1, -(-sizes.items // BLOCK_ITEMS), -(-sizes.terms // BLOCK_TERMS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for j in range(blocks):
        own: dict[int | None, list[bytes]] = {}
        for r in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == j).orderBy("item_id", "term").collect():
            own.setdefault(r.item_id, []).append(bytes(r.term))
        if not own:
            continue
        ids = list(own)
        hits = search_block(index, {i: own[x] for i, x in enumerate(ids)}, k).where("item >= 0")
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        out = out.unionByName(_ranked(hits, "item", k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    found = materialise(search(index, table(spark, sf_dir, "benchmark")), "ranked")
    delete(spark, index.path)
    return found


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op13_ranked": op13_ranked}
ORACLE_SQL = {
    "op13_ranked": f"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all({_LOWER('text')}, '{_TERM}') AS t FROM documents WHERE text IS NOT NULL),
        e AS (SELECT i, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM e),
        p AS (SELECT i, doc_id, n, term, count(*) AS tf FROM (SELECT i, doc_id, n, unnest(t) AS term FROM e) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER('text')}, '{_TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
        w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), s),
        h AS (SELECT item_id, i, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens)))) AS BIGINT) AS score FROM w JOIN p USING (term), s GROUP BY item_id, i, doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM h WHERE score > 0)
        SELECT * FROM r WHERE rank <= {K}""",
}
