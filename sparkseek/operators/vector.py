"""Vector arm: exact cosine top-k within a scope, by matrix products over batches, or over stored clusters that bounds leave out.

The cosine of a zero vector, of vectors of different lengths, or of one with null or non-finite components is 0."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sparkseek.functions.sizes import blocks
from sparkseek.operators.ranks import HIT, PLACES, Best, in_scope
from sparkseek.session import gathered, materialise

#: Queries that are held against the chunks at once; vectors of a block; blocks that a query visits for its threshold.
QUERIES, VECTORS, FIRST = 1024, 512, 2
#: Times so many queries that are held against the stored form at once, and components that these have together at most.
TOGETHER, COMPONENTS = 32, 1 << 20
#: Cosines that are worked out at once, and rows that a task holds at least before it cuts them to the best.
COSINES, HELD = 1 << 18, 1 << 17
#: Vectors that clusters are made around: the root of how many there are, within these bounds.
LEAST_MIDDLES, MOST_MIDDLES = 8, 2048
BLOCK = "block string, dim int, centre array<double>, radius double, ids array<string>, paths array<string>, vectors array<float>"
_MARGIN = 2 * 10.0**-PLACES


def units(rows: list[list[float] | None], dim: int) -> np.ndarray:
    """Rows of length 1, or of zeros where the cosine is 0."""
    m = np.zeros((len(rows), dim))
    for k, v in enumerate(rows):
        if v is not None and len(v) == dim and None not in v:
            m[k] = v
    return _normed(m)


def _normed(m: np.ndarray) -> np.ndarray:
    m = np.where(np.isfinite(m).all(1)[:, None], m, 0.0) if m.size else m
    norm = np.sqrt((m * m).sum(1))
    return np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch by their length: places, and rows of length 1. Null counts as of length 0."""
    long = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    for dim in np.unique(long):
        at = np.flatnonzero(long == dim)
        own = column.take(pa.array(at))
        flat = own.flatten()
        yield at, _normed(np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(len(at), dim)) if dim else np.zeros((len(at), 0))


@dataclass
class Asked:
    """Some queries, by the length of their vectors: numbers, and rows of length 1. Queries of one vector and scope are one, which has
    several ids."""

    ids: list[list]
    scopes: list[str]
    own: dict[int, tuple[np.ndarray, np.ndarray]]

    def cosines(self, dim: int, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and their cosines with the rows of m."""
        for d, (at, q) in self.own.items():
            yield at, q @ m.T if d == dim else np.zeros((len(at), len(m)))


def _asked(queries: DataFrame) -> Asked:
    t = queries.select("query_id", "scope", F.col("q_embedding").cast("array<double>").alias("q_embedding")).orderBy("query_id").toArrow()
    ids, scopes = t.column("query_id").to_pylist(), t.column("scope").to_pylist()
    number: dict[tuple[bytes, int, str], int] = {}
    out = Asked([], [], {})
    for at, m in _matrices(t.column("q_embedding").combine_chunks()):
        first = []
        for row, k in enumerate(at.tolist()):
            q = number.setdefault((m[row].tobytes(), m.shape[1], scopes[k] or ""), len(out.ids))
            if q == len(out.ids):
                out.ids.append([])
                out.scopes.append(scopes[k] or "")
                first.append(row)
            out.ids[q].append(ids[k])
        out.own[m.shape[1]] = (np.arange(len(out.ids) - len(first), len(out.ids)), m[first])
    return out


def _local(df: DataFrame, schema: str, *columns: list) -> DataFrame:
    """A table of what is here; as Arrow, since rows would be read by Python workers."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return df.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), schema)


def _named(found: DataFrame, asked: Asked, queries: DataFrame) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    names = _local(found, f"query int, query_id {kind}", [k for k, own in enumerate(asked.ids) for _ in own], [i for own in asked.ids for i in own])
    return found.where("query >= 0").join(F.broadcast(names), "query").select("query_id", "id", "path", "score")


def _ranked(named: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "id")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _masks(asked: Asked, paths: pa.Array) -> dict[str, np.ndarray | None]:
    own = paths.to_pylist() if any(asked.scopes) else []
    return {s: np.array([in_scope(p, s) for p in own], bool) if s else None for s in set(asked.scopes)}


def _offer(asked: Asked, best: Best, floors: list[float], q: int, cos: np.ndarray, inside: np.ndarray | None, ids: pa.Array, paths: pa.Array) -> None:
    hit = np.flatnonzero(cos >= max(floors[q], best.floor(q)) - _MARGIN)
    if inside is not None:
        hit = hit[inside[hit]]
    if len(hit) > 4 * best.k:  # ties with the k-th stay
        hit = hit[cos[hit] >= np.partition(cos[hit], -best.k)[-best.k] - _MARGIN]
    if len(hit):
        at = pa.array(hit)
        best.add(q, zip(cos[hit].tolist(), ids.take(at).to_pylist(), paths.take(at).to_pylist(), strict=True))


def vector_arm(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, id, path, score, rank, from all vectors: for few queries, or vectors that are looked at once. queries: query_id,
    embedding, scope; sent to the tasks in blocks of `QUERIES`. A task makes one product of matrices for each batch and keeps k rows of
    each query; the scope is applied before that, so the result is exact."""
    own = chunks.where(F.col("embedding").isNotNull()).select("id", "path", "embedding")

    def arm(some: DataFrame) -> DataFrame:
        asked = _asked(some)
        floors = [float("-inf")] * len(asked.ids)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(asked.ids), k)
            for b in batches:
                for at, m in _matrices(b.column("embedding")):
                    ids, paths = b.column("id").take(pa.array(at)), b.column("path").take(pa.array(at))
                    masks = _masks(asked, paths)
                    for numbers, cos in asked.cosines(m.shape[1], m):
                        for q, c in zip(numbers.tolist(), cos, strict=True):
                            _offer(asked, best, floors, q, c, masks[asked.scopes[q]], ids, paths)
            yield best.batch()

        return _named(own.mapInArrow(go, HIT), asked, queries)

    return _ranked(reduce(DataFrame.unionByName, map(arm, blocks(queries.select("query_id", F.col("embedding").alias("q_embedding"), "scope"), "query_id", QUERIES))), k)


# --- clusters -----------------------------------------------------------------------------------------------------------


def build(chunks: DataFrame) -> DataFrame:
    """The stored form of vectors (id, path, embedding): blocks of near ones, each with its centre and the largest angle from it.

    Vectors are dealt out by the nearest of some middles (a sample whose size grows as the root of the table's, up to a bound), and by id
    within a cluster, so that a cluster of any size is spread over tasks. Zero vectors, and those of each other length, have clusters of their own."""
    own = chunks.where(F.col("embedding").isNotNull()).select("id", "path", F.col("embedding").cast("array<float>").alias("embedding"))
    n = own.count()
    wanted = min(MOST_MIDDLES, max(LEAST_MIDDLES, round(n**0.5)))
    parts = max(1, min(4 * chunks.sparkSession.sparkContext.defaultParallelism, n // (8 * VECTORS)))
    sample = [r.embedding for r in own.where(F.size("embedding") > 0).orderBy(F.xxhash64("id"), "id").select("embedding").limit(wanted).collect()]
    dim = len(sample[0]) if sample else 0
    middles = units([v for v in sample if len(v) == dim], dim)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster = np.empty(b.num_rows, np.int32)
            for at, m in _matrices(b.column("embedding")):
                near = (m @ middles.T).argmax(1) if m.shape[1] == dim and dim else np.full(len(at), -2 - m.shape[1])
                cluster[at] = np.where((m != 0).any(1), near, -1) if m.shape[1] else near
            yield pa.RecordBatch.from_arrays([pa.array(cluster), b.column("id"), b.column("path"), b.column("embedding")], ["cluster", "id", "path", "embedding"])

    def block(cluster: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        for at, m in _matrices(t.column("embedding").chunk(0)):
            where = pa.array(at)
            ids, paths, vectors = (t.column(c).chunk(0).take(where) for c in ("id", "path", "embedding"))
            middle = _normed(m.mean(0)[None])[0] if m.shape[1] else np.zeros(0)
            # Zero vectors have no angle: their blocks are never left out.
            radius = float(np.arccos(np.clip(m @ middle, -1, 1)).max()) if cluster >= 0 and middle.any() else 4.0
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{cluster}/{ids[0].as_py()}"]), pa.array([m.shape[1]], pa.int32()), one(pa.array(middle)), pa.array([radius]), one(ids), one(paths), one(vectors.flatten().cast(pa.float32()))],
                ["block", "dim", "centre", "radius", "ids", "paths", "vectors"],
            )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, n = None, 0
        for b in batches:
            cluster = b.column("cluster").to_numpy()
            at = 0
            while at < len(cluster):
                if held and (cluster[at] != now or n == VECTORS):
                    yield from block(now, held)
                    held, n = [], 0
                now = int(cluster[at])
                end = min(at + VECTORS - n, int(np.searchsorted(cluster[at:], now, side="right")) + at)
                held.append(b.slice(at, end - at))
                n, at = n + end - at, end
        if held:
            yield from block(now, held)

    dealt = own.mapInArrow(led, "cluster int, id string, path string, embedding array<float>").repartitionByRange(parts, "cluster", "id").sortWithinPartitions("cluster", "id")
    return dealt.mapInArrow(gathered, BLOCK)


def _centres(asked: Asked, b: pa.RecordBatch) -> np.ndarray:
    """The cosine of each query with the centre of each block."""
    out = np.zeros((len(asked.ids), b.num_rows))
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        middles = b.column("centre").take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
        for numbers, cos in asked.cosines(int(dim), middles):
            out[np.ix_(numbers, at)] = cos
    return out


def _nearest(asked: Asked):
    """For each query the `FIRST` blocks of this task whose centre is nearest to it, of those that hold anything in its scope."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, cos = np.zeros((len(asked.ids), 0), object), np.zeros((len(asked.ids), 0))
        scopes = np.array(asked.scopes, object)
        for b in batches:
            own = _centres(asked, b)
            if "paths" in b.schema.names:
                for i in range(b.num_rows):
                    for s, inside in _masks(asked, b.column("paths")[i].values).items():
                        if inside is not None and not inside.any():
                            own[scopes == s, i] = -2.0
            cos = np.concatenate([cos, own], 1)
            names = np.concatenate([names, np.broadcast_to(np.array(b.column("block").to_pylist(), object), own.shape)], 1)
            if cos.shape[1] > FIRST:
                at = np.argpartition(-cos, FIRST - 1, axis=1)[:, :FIRST]
                names, cos = np.take_along_axis(names, at, 1), np.take_along_axis(cos, at, 1)
        q, i = np.nonzero(cos > -2.0)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(names[q, i].tolist(), pa.string()), pa.array(cos[q, i])], ["query", "block", "cosine"])

    return go


def _distinct(m: np.ndarray, k: int) -> np.ndarray | None:
    """Places of the rows but for those that k equal ones come before; none if all stay."""
    if len(m) <= k or not m.shape[1]:
        return None
    mixed = (np.ascontiguousarray(m).view(np.uint64) * np.arange(1, 2 * m.shape[1], 2, np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(1)
    order = np.argsort(mixed, kind="stable")
    head = np.maximum.accumulate(np.where(np.append(True, np.diff(mixed[order]) != 0), np.arange(len(m)), 0))
    late = np.flatnonzero(np.arange(len(m)) - head >= k)
    late = late[(m[order[late]] == m[order[head[late]]]).all(1)] if len(late) else late
    return np.setdiff1d(np.arange(len(m)), order[late]) if len(late) else None


class _Found:
    """Rows that may be among the k best, and what a row has to reach: this grows when they are cut to the best of each query."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k = floors.copy(), k
        self.rows: list[pa.RecordBatch] = []
        self.n, self.most = 0, HELD + 2 * k * len(floors)
        self._turned()

    def _turned(self) -> None:
        self.least = self.floors - _MARGIN
        self.angle = np.arccos(np.clip(self.least, -1, 1))
        self.cos, self.sin = np.cos(self.angle), np.sin(self.angle)

    def may(self, cos: np.ndarray, radius: float) -> np.ndarray:
        """Queries that a block can serve, from their cosines with its centre: by the triangle inequality of angles, the angle is at most that of the
        floor and the radius together."""
        if radius >= 4:
            return np.arange(len(cos))
        return np.flatnonzero((cos >= self.cos * np.cos(radius) - self.sin * np.sin(radius) - 1e-9) | (self.angle + radius >= np.pi))

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array, paths: pa.Array) -> None:
        self.rows.append(pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), ids, paths, pa.array(score)], ["query", "id", "path", "score"]))
        self.n += len(query)
        if self.n > self.most:
            self.cut()

    def cut(self) -> None:
        if not self.n:
            return
        t = pa.Table.from_batches(self.rows)
        rounded = np.round(t.column("score").to_numpy(), PLACES)
        keys = pa.table({"query": t.column("query"), "rounded": pa.array(rounded), "id": t.column("id")})
        order = pc.sort_indices(keys, [("query", "ascending"), ("rounded", "descending"), ("id", "ascending")]).to_numpy()
        query = t.column("query").to_numpy()[order]
        head = np.maximum.accumulate(np.where(np.append(True, np.diff(query) != 0), np.arange(len(query)), 0))
        place = np.arange(len(query)) - head
        last = place == self.k - 1
        self.floors[query[last]] = np.maximum(self.floors[query[last]], rounded[order[last]])
        self._turned()
        own = t.take(pa.array(order[place < self.k])).combine_chunks()
        self.rows, self.n = own.to_batches(), own.num_rows


def _compared(asked: Asked, k: int, floors: np.ndarray, only: dict[str, np.ndarray] | None):
    """The k best of each query in this task, of the blocks named for it or of all. The row of query -1 says in its path how many pairs of query
    and vector were compared, and in its score how many there were. Cosines are of 32 bits first; what reaches the floor then is worked out anew."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, met, used = _Found(floors, k), 0, 0
        scoped = any(asked.scopes)
        kinds = sorted(set(asked.scopes))
        kind = np.array([kinds.index(s) for s in asked.scopes], np.int64)
        short = {d: q.astype(np.float32) for d, (_, q) in asked.own.items()}
        for b in batches:
            centres = _centres(asked, b) if only is None else None
            for i in range(b.num_rows):
                dim, ids, paths = b.column("dim")[i].as_py(), b.column("ids")[i].values, b.column("paths")[i].values
                if only is None:
                    met += len(asked.ids) * len(ids)
                    serve = found.may(centres[:, i], b.column("radius")[i].as_py())
                else:
                    serve = only.get(b.column("block")[i].as_py(), np.zeros(0, np.int64))
                if not len(serve):
                    continue
                used += len(serve) * len(ids)
                m = _normed(b.column("vectors")[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)) if dim else np.zeros((len(ids), 0))
                inside = None
                if scoped:
                    masks = _masks(asked, paths)
                    inside = np.stack([masks[s] if masks[s] is not None else np.ones(len(ids), bool) for s in kinds])
                elif (own := _distinct(m, k)) is not None:  # of equal vectors those of the least ids
                    m, ids, paths = m[own], ids.take(pa.array(own)), paths.take(pa.array(own))
                hit = [x for d, (at, q) in asked.own.items() for x in _hits(found, serve[(serve >= at[0]) & (serve <= at[-1])], at[0], q, short[d], m if d == dim else None, len(ids), inside, kind)]
                if hit:
                    query, row, score = (np.concatenate(x) for x in zip(*hit, strict=True))
                    found.add(query, score, ids.take(pa.array(row)), paths.take(pa.array(row)))
        found.cut()
        yield from found.rows
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([str(used)]), pa.array([float(met)])], ["query", "id", "path", "score"])

    return go


def _hits(found: _Found, serve: np.ndarray, start: int, q: np.ndarray, short: np.ndarray, m: np.ndarray | None, n: int, inside: np.ndarray | None, kind: np.ndarray) -> Iterator[tuple]:
    """Numbers of queries, places in the block and cosines, where these reach the floor. Queries of another length (m: none) have a cosine of 0 with all."""
    if m is None:
        serve = serve[found.least[serve] <= 0]
    else:
        near, slack = np.ascontiguousarray(m.astype(np.float32).T), 2.5e-7 * (m.shape[1] + 8)
    step = max(1, COSINES // n)
    for a in range(0, len(serve), step):
        some = serve[a : a + step]
        if m is None:
            reached = np.ones((len(some), n), bool) if inside is None else inside[kind[some]]
            reached = reached & (np.cumsum(reached, 1) <= found.k)  # all alike: those of the least ids
        else:
            cos = short[some - start] @ near
            if inside is not None:
                cos[~inside[kind[some]]] = -np.inf
            reached = cos >= np.maximum(found.least[some] - slack, -2).astype(np.float32)[:, None]
            if np.count_nonzero(reached) > 4 * found.k:
                many = np.flatnonzero(np.count_nonzero(reached, axis=1) > 4 * found.k)
                if len(many):  # ties with the k-th stay
                    kth = -np.partition(-cos[many], found.k - 1, axis=1)[:, found.k - 1]
                    reached[many] &= cos[many] >= (kth - 2 * slack - _MARGIN)[:, None]
        at = np.flatnonzero(reached)
        if len(at):
            row, col = np.divmod(at, n)
            query = some[row]
            score = np.zeros(len(row)) if m is None else np.einsum("ij,ij->i", q[query - start], m[col])
            ok = score >= found.least[query]
            if ok.any():
                yield query[ok], col[ok], score[ok]


def hits_of_block(asked: Asked, index: DataFrame, k: int) -> DataFrame:
    """Rows of HIT that hold the k best of each query, and the counts of pairs at query -1."""
    scoped = any(asked.scopes)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "block")
    near = index.select("block", "dim", "centre", *(("paths",) if scoped else ())).mapInArrow(_nearest(asked), "query int, block string, cosine double")
    t = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= FIRST).select("query", "block").toArrow()
    wanted: dict[str, list[int]] = {}
    for q, block in zip(t.column("query").to_pylist(), t.column("block").to_pylist(), strict=True):
        wanted.setdefault(block, []).append(q)
    only = {x: np.sort(np.array(own, np.int64)) for x, own in wanted.items()}
    floors = np.full(len(asked.ids), -np.inf)
    # A query has `FIRST` blocks at most, but all queries together may name many: the table is filtered by them as a join.
    named = _local(index, "block string", list(only))
    first = index.join(F.broadcast(named), "block", "left_semi").mapInArrow(_compared(asked, k, floors, only), HIT).select("query", "path", "score")
    kth = Window.partitionBy("query").orderBy(F.desc("score"))
    t = first.withColumn("n", F.row_number().over(kth)).where((F.col("n") == k) | (F.col("query") < 0)).select("query", "path", "score").toArrow()
    query = t.column("query").to_numpy()
    floors[query[query >= 0]] = t.column("score").to_numpy()[query >= 0]
    used = sum(int(x) for x, q in zip(t.column("path").to_pylist(), query.tolist(), strict=True) if q < 0)
    counts = _local(index, HIT, [-1], [None], [str(used)], [0.0])
    return materialise(index.mapInArrow(_compared(asked, k, floors, None), HIT), "found").unionByName(counts)


def top_k(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The same rows as `vector_arm`, from the stored form: each query compares itself with the blocks nearest to it, and then with
    those that can hold a vector as near as its k-th of these. Queries are written once, and the stored form is read for `TOGETHER` times `QUERIES` of them at once."""
    asked = materialise(queries.select("query_id", F.col("embedding").alias("q_embedding"), "scope"), "asked")
    longest = asked.agg(F.max(F.size("q_embedding"))).first()[0] or 1
    most = max(QUERIES, min(TOGETHER * QUERIES, COMPONENTS // max(1, longest)))

    def found(some: DataFrame) -> DataFrame:
        own = _asked(some)
        return _ranked(_named(hits_of_block(own, index, k), own, queries), k)

    return gathered(map(found, blocks(asked, "query_id", most)), "nearest")
