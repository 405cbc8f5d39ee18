"""Compression of vectors to codes: a codebook of entries for each part of the vectors, fitted by exact rounds of k-means.

Components become integers, so sums and squared distances are exact and the result does not depend on how Spark deals out the rows.
The search for the nearest entry is the exponion one: it starts at the entry that the part had before (in the first round at the
nearest of some fixed entries) and looks at that entry's neighbours in order of their distance from it. An entry further from the
start than twice the part's own distance is further from the part, by the triangle inequality; so the list is left at that radius,
and ties, which can lie on it, are still met and go to the lower index. Parts with one start are compared together, by matrix products.

Each round writes the vectors with their new entries to the shared folder and deletes the round before. The sums of a round are made in
each task and added up by entry; what reaches the driver is the codebooks, parts x entries rows.

Defined results: rows whose vector is null or holds a null, infinite or NaN component are dropped. The length of vectors is that of the
first one by vec_id; vectors of another length, empty ones, ones whose length isn't a multiple of the parts and ones with components of
2^27 or more after scaling keep their row with null code and error. Rows without vec_id are coded, but start no entry; of a repeated
vec_id each row may start one, in order of their components. With fewer rows than entries the codebooks are as much shorter. Columns
other than the three named aren't read."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.sizes import if_small
from sparkseek.llm.common import table
from sparkseek.session import delete, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are below this in size; entries that a first search starts from; rows that are compared with one list at once.
LARGEST, STARTS, TOGETHER = 1 << 27, 16, 512
_STATE = "vec_id long, label int, v array<int>, code array<int>, error long"


class Entries:
    """The entries of one part and, for each, all of them in order of distance from it."""

    def __init__(self, entries: np.ndarray):
        self.c = entries.astype(np.int64)
        gaps = squares(self.c, self.c)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        step = max(1, len(self.c) // STARTS)
        self.starts = np.arange(0, len(self.c), step)

    def nearest(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of each row of x, and how many distances were worked out."""
        looked = 0
        if start is None:
            start = self.starts[squares(x, self.c[self.starts]).argmin(1)]
            looked += len(x) * len(self.starts)
        first = ((x - self.c[start]) ** 2).sum(1)
        entry, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        widths = np.empty(len(x), np.int64)
        by = np.argsort(start, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(start[by])) + 1) if len(by) else []:
            a = start[rows[0]]
            widths[rows] = np.searchsorted(self.gaps[a], 4 * first[rows], side="right")
            rows = rows[np.argsort(widths[rows], kind="stable")]
            at = 0
            while at < len(rows):
                # Rows of like radius together: up to the first whose list is twice as long.
                end = min(at + TOGETHER, int(np.searchsorted(widths[rows], 2 * widths[rows[at]], side="right")))
                some = rows[at:end]
                near = self.order[a, : widths[some[-1]]]
                d = squares(x[some], self.c[near])
                least = d.min(1)
                entry[some] = np.where(d == least[:, None], near, len(self.c)).min(1)
                distance[some] = least
                looked += d.size
                at = end
        return entry, distance, looked


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all of c: by products of doubles while these hold every integer that can occur."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if x.shape[1] * (2 * most) ** 2 < 1 << 53 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _coded(codebooks: list[np.ndarray], width: int):
    """Gives each row its nearest entries; `code` of the rows that come is where the search starts, unless it is null."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Entries(c) for c in codebooks]
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), width * len(lists))
            old = b.column("code")
            before = None if old.null_count else _matrix(old, len(lists))
            codes, error = np.empty((len(v), len(lists)), np.int32), np.zeros(len(v), np.int64)
            for p, e in enumerate(lists):
                codes[:, p], d, _ = e.nearest(v[:, p * width : (p + 1) * width], None if before is None else before[:, p])
                error += d
            ends = pa.array(np.arange(0, codes.size + 1, len(lists), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), pa.array(error)], ["vec_id", "label", "v", "code", "error"])

    return go


def _summed(parts: int, entries: int, width: int):
    """Sums of a task: part, entry, place, and the sum and number of components."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            v, codes = _matrix(b.column("v"), parts * width), _matrix(b.column("code"), parts)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], v[:, p * width : (p + 1) * width])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(n)
        if len(p):
            at = lambda x: pa.array(np.repeat(x, width).astype(np.int32))
            yield pa.RecordBatch.from_arrays([at(p), at(e), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), pa.array(total[p, e].ravel()), pa.array(np.repeat(n[p, e], width))], ["part", "entry", "place", "total", "n"])

    return go


def prepare(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (integers; null if too large) of the rows that count."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    v = F.when(small, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")))
    return rows.where(F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"))


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (array of int), error (long) of all rows that count, and the codebooks (one matrix for each part)."""
    spark = rows.sparkSession
    kept = prepare(rows, scale)
    usable = kept.where("v is not null and size(v) > 0").where(F.size("v") % parts == 0)
    by = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    one = usable.orderBy(*by).select(F.size("v").alias("n")).first()
    uncoded = lambda df: df.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if one is None:
        return uncoded(kept), []
    size, width = one.n, one.n // parts
    usable, odd = usable.where(F.size("v") == size), F.col("v").isNull() | (F.size("v") != size)
    first = np.array([r.v for r in usable.where("vec_id is not null").orderBy(*by).limit(entries).collect()], np.int64)
    if not len(first):  # no row has a number: there is nothing to start from
        return uncoded(kept), []
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    state, at = usable.withColumns({"code": F.lit(None).cast("array<int>"), "error": F.lit(None).cast("long")}), None
    for k in range(rounds + 1):
        path = f"{shared_dir(spark)}/sparkseek-codes-{uuid.uuid4().hex}"
        state.mapInArrow(_coded(books, width), _STATE).write.parquet(path)
        if at:
            delete(spark, at)
        at, state = path, spark.read.schema(_STATE).parquet(path)
        if k < rounds:
            sums = state.select("v", "code").mapInArrow(_summed(parts, len(first), width), "part int, entry int, place int, total long, n long")
            books = [b.copy() for b in books]
            for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
                books[r.part][r.entry, r.place] = r.total // r.n
    return state.select("vec_id", "label", "code", "error").unionByName(uncoded(kept.where(odd))), books


def op11_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    of_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    got = coded.join(if_small(of_label), F.col("label").eqNullSafe(F.col("_label")))
    hexed = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return got.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * CAST(y AS DOUBLE))) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"x AS MATERIALIZED (SELECT i, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part))",
        f"o AS (SELECT i, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL), c0 AS MATERIALIZED (SELECT part, e, x AS c FROM x JOIN o USING (i) WHERE e < {ENTRIES})"]
    for k in range(ROUNDS + 1):
        d = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
        steps.append(f"a{k} AS MATERIALIZED (SELECT i, part, min({{'d': {d}, 'e': e}}) AS b FROM x JOIN c{k} USING (part) GROUP BY i, part)")
        if k < ROUNDS:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.part, c{k}.e, coalesce(n.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT part, e, list(m ORDER BY pos) AS c FROM
                (SELECT part, e, pos, floor(sum(y) / count(*)) AS m FROM (SELECT part, a{k}.b.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{k} JOIN x USING (i, part)) GROUP BY ALL) GROUP BY ALL) n USING (part, e))""")
    return f"""WITH {', '.join(steps)},
        r AS (SELECT vec_id, label, code, error FROM kept JOIN (SELECT i, string_agg(format('{{:02x}}', b.e), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i) USING (i))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, pos)) FROM (SELECT part, e, unnest(c) AS y, generate_subscripts(c, 1) AS pos FROM c{ROUNDS})) AS codebooks_sha256 FROM r"""


QUERIES = {"op11_pq": op11_pq}
ORACLE_SQL = {"op11_pq": _sql()}
