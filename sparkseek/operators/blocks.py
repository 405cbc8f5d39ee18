"""BM25 over a block index: exact top-k that leaves blocks out by their bounds, and whole arms without a shuffle.

A block is a run of chunks as they lie in the table, with the postings of all their terms. A term's impact in a block is at most that
of its greatest count in the shortest chunk that has it, whatever the mean length comes to be, so a block needs no statistics of the
corpus, and blocks of new chunks are added to those there are. A chunk is in one block as a whole, so neither building the index nor
scoring shuffles anything; what moves are the best rows of each task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions import sizes
from sparkseek.functions.scalars import tokenize
from sparkseek.operators.lexical import B, K1, indexed_text, query_terms
from sparkseek.operators.ranks import HIT, PLACES, Best, hits, in_scope
from sparkseek.session import materialise

#: A block ends at so many chunks or tokens.
CHUNKS, TOKENS = 2048, 400_000
#: Blocks that a query visits for its threshold; queries that are served at once.
FIRST, QUERIES = 2, 256
BLOCK = "block string, ids array<string>, paths array<string>, dl array<int>, terms array<string>, ends array<int>, most_tf array<int>, least_dl array<int>, places array<int>, tfs array<int>"
_MARGIN = 2 * 10.0**-PLACES


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int32)))


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    ids, paths, tokens = (t.column(c).chunk(0) for c in ("id", "path", "tokens"))
    dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    coded = tokens.flatten().dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), dl)
    key, tf = np.unique(key, return_counts=True)
    term, place = key // max(1, len(ids)), key % max(1, len(ids))
    n = np.bincount(term, minlength=len(coded.dictionary))
    starts = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl[place], starts)) if len(n) else (n, n)
    one = pa.array([0, len(ids)], pa.int32())
    names = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[0].as_py()], pa.string()), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, paths), _list(dl), names, *map(_list, (np.cumsum(n), most, least, place, tf))],
        ["block", "ids", "paths", "dl", "terms", "ends", "most_tf", "least_dl", "places", "tfs"],
    )


def build(chunks: DataFrame) -> DataFrame:
    """The block index of some chunks (id, path, content): one row for each block.

    Where the table has fewer parts than there are cores its rows are dealt out anew; a large one is taken as it lies."""
    own = chunks.select("id", "path", "content")
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    if own.rdd.getNumPartitions() < cores:
        own = own.repartition(cores, "id")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = tokens = 0
        for b in batches:
            at = 0
            for k, n in enumerate(pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_pylist(), 1):
                rows, tokens = rows + 1, tokens + n
                if rows >= CHUNKS or tokens >= TOKENS:
                    yield _block([*held, b.slice(at, k - at)])
                    held, at, rows, tokens = [], k, 0, 0
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield _block(held)

    return own.select("id", "path", tokenize(indexed_text()).alias("tokens")).mapInArrow(go, BLOCK)


@dataclass
class Asked:
    """Some queries: for each its scope, and the numbers and weights of its terms in `terms`."""

    terms: pa.Array
    own: list[tuple[np.ndarray, np.ndarray]]
    scopes: list[str]
    avgdl: float

    def impact(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl))


def _ints(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).astype(np.int64)


def _present(terms: pa.Array, column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a block's terms, and numbers in the queries', of the terms that both have."""
    number = pc.index_in(column[i].values, value_set=terms)
    here = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
    return here, number.to_numpy(zero_copy_only=False)[here].astype(np.int64)


def _counted(terms: pa.Array):
    """Of this task: chunks with each term; at -1 all chunks, at -2 all tokens."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            for i in range(b.num_rows):
                here, number = _present(terms, b.column("terms"), i)
                df[number] += np.diff(_ints(b.column("ends"), i), prepend=0)[here]
                dl = _ints(b.column("dl"), i)
                n, total = n + len(dl), total + int(dl.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]).astype(np.int32)), pa.array(np.append(df[at], [n, total]))], ["number", "df"])

    return go


def _scopes_met(asked: Asked, paths: list[str] | None) -> dict[str, np.ndarray | None]:
    """For each scope which chunks of a block lie in it; None: all."""
    return {s: None if not s else np.array([in_scope(p, s) for p in paths or ()], bool) for s in set(asked.scopes)}


def _bounds(asked: Asked, b: pa.RecordBatch, i: int) -> list[float]:
    """The most that a chunk of a block can score, for each query."""
    here, number = _present(asked.terms, b.column("terms"), i)
    most = np.zeros(len(asked.terms))
    most[number] = asked.impact(_ints(b.column("most_tf"), i)[here], _ints(b.column("least_dl"), i)[here])
    return [float((most[own] * w).sum()) for own, w in asked.own]


def _widest(asked: Asked):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple[float, str]]] = [[] for _ in asked.own]
        for b in batches:
            for i in range(b.num_rows):
                met = _scopes_met(asked, b.column("paths")[i].as_py() if "paths" in b.schema.names else None)
                for q, bound in enumerate(_bounds(asked, b, i)):
                    inside = met[asked.scopes[q]]
                    if bound > 0 and (inside is None or inside.any()):
                        top[q] = sorted([*top[q], (-bound, b.column("block")[i].as_py())])[:FIRST]
        rows = [(q, block, -bound) for q, own in enumerate(top) for bound, block in own]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.float64()), strict=True)], ["query", "block", "bound"])

    return go


def _scored(asked: Asked, k: int | None, floors: list[float], only: dict[str, set[int]] | None, done: dict[str, set[int]]):
    """Hits of this task: all (k is None), or the k best of each query. The last row, of query -1, says in its score how many
    blocks there were for the queries together, and in its path how many were scored."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked.own), k or 0)
        met = used = 0
        for b in batches:
            for i in range(b.num_rows):
                block = b.column("block")[i].as_py()
                serve = sorted((only.get(block, set()) if only is not None else set(range(len(asked.own)))) - done.get(block, set()))
                met += len(serve)
                bounds = _bounds(asked, b, i) if serve else []
                serve = [q for q in serve if bounds[q] > 0 and (k is None or bounds[q] >= max(floors[q], best.floor(q)) - _MARGIN)]
                used += len(serve)
                if not serve:
                    continue
                here, number = _present(asked.terms, b.column("terms"), i)
                ends, places, tfs, dl = (_ints(b.column(c), i) for c in ("ends", "places", "tfs", "dl"))
                starts = np.concatenate([[0], ends[:-1]])
                at = dict(zip(number.tolist(), zip(starts[here].tolist(), ends[here].tolist(), strict=True), strict=True))
                impact = asked.impact(tfs, dl[places])
                ids, paths = b.column("ids")[i].values, b.column("paths")[i].values
                scopes = _scopes_met(asked, paths.to_pylist() if any(asked.scopes) else None)
                for q in serve:
                    score = np.zeros(len(dl))
                    for v, w in zip(*(x.tolist() for x in asked.own[q]), strict=True):
                        if v in at:
                            a, z = at[v]
                            score[places[a:z]] += w * impact[a:z]
                    if scopes[asked.scopes[q]] is not None:
                        score[~scopes[asked.scopes[q]]] = 0
                    hit = np.flatnonzero(score > 0)
                    if k is None:
                        if len(hit):
                            yield hits(np.full(len(hit), q), ids.take(pa.array(hit)), paths.take(pa.array(hit)), score[hit])
                        continue
                    hit = hit[score[hit] >= max(floors[q], best.floor(q)) - _MARGIN]
                    if len(hit):
                        best.add(q, zip(score[hit].tolist(), ids.take(pa.array(hit)).to_pylist(), paths.take(pa.array(hit)).to_pylist(), strict=True))
        if k is not None:
            yield best.batch()
        yield hits([-1], [None], [str(used)], [float(met)])

    return go


def _asked(queries: DataFrame, index: DataFrame) -> tuple[Asked, list]:
    """queries: query_id, query, scope, few enough for the driver."""
    rows = query_terms(queries).orderBy("query_id", "term").collect()
    ids = sorted({r.query_id for r in rows})
    place, scopes = {x: i for i, x in enumerate(ids)}, {r.query_id: r.scope or "" for r in rows}
    terms = pa.array(sorted({r.term for r in rows}), pa.string())
    numbers = {t: i for i, t in enumerate(terms.to_pylist())}
    got = {r.number: r.df for r in index.select("terms", "ends", "dl").mapInArrow(_counted(terms), "number int, df long").groupBy("number").agg(F.sum("df").alias("df")).collect()}
    n, total = got.get(-1, 0), got.get(-2, 0)
    own: list[tuple[list[int], list[float]]] = [([], []) for _ in ids]
    for r in rows:
        df = got.get(numbers[r.term], 0)
        if df:
            own[place[r.query_id]][0].append(numbers[r.term])
            own[place[r.query_id]][1].append(r.qtf * math.log(1 + (n - df + 0.5) / (df + 0.5)))
    return Asked(terms, [(np.array(a, np.int64), np.array(w)) for a, w in own], [scopes[x] for x in ids], total / n if total else 1.0), ids


def _named(found: DataFrame, ids: list, queries: DataFrame) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    names = found.sparkSession.createDataFrame(list(enumerate(ids)), f"query int, query_id {kind}")
    return found.join(F.broadcast(names), "query").select("query_id", "id", "path", "score")


def whole_arm(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, id, path, score of every chunk with a score over 0 in the query's scope, as `lexical.bm25`."""

    def arm(some: DataFrame) -> DataFrame:
        asked, ids = _asked(some, index)
        return _named(index.mapInArrow(_scored(asked, None, [], None, {}), HIT), ids, queries)

    return reduce(DataFrame.unionByName, map(arm, sizes.blocks(queries.select("query_id", "query", "scope"), "query_id", QUERIES)))


def hits_of_block(some: DataFrame, index: DataFrame, k: int) -> tuple[DataFrame, list]:
    """Rows of HIT that hold the k best chunks of each query (by number; the ids follow), and the counts of blocks at query -1."""
    asked, ids = _asked(some, index)
    columns = ("block", "terms", "most_tf", "least_dl", *(("paths",) if any(asked.scopes) else ()))
    w = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    only: dict[str, set[int]] = {}
    wide = index.select(*columns).mapInArrow(_widest(asked), "query int, block string, bound double")
    for r in wide.withColumn("n", F.row_number().over(w)).where(F.col("n") <= FIRST).collect():
        only.setdefault(r.block, set()).add(r.query)
    floors = [float("-inf")] * len(ids)
    first = materialise(index.where(F.col("block").isin(*only)).mapInArrow(_scored(asked, k, floors, only, {}), HIT), "first")
    kth = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    for r in first.where("query >= 0").withColumn("n", F.row_number().over(kth)).where(F.col("n") <= k).where(F.col("n") == k).collect():
        floors[r.query] = r.score
    rest = materialise(index.mapInArrow(_scored(asked, k, floors, None, only), HIT), "rest")
    return first.unionByName(rest), ids


def top_k(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, id, path, score, rank: the k best chunks of each query in its scope, by score (rounded), then id. Exact.

    Each query scores the blocks of its greatest bounds; its k-th score there is its threshold, and of the others only blocks whose
    bound reaches it are scored. queries: query_id, query, scope; served in blocks of `QUERIES`."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "id")

    def found(some: DataFrame) -> DataFrame:
        got, ids = hits_of_block(some, index, k)
        return _named(got.where("query >= 0"), ids, queries)

    every = reduce(DataFrame.unionByName, map(found, sizes.blocks(queries.select("query_id", "query", "scope"), "query_id", QUERIES)))
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
