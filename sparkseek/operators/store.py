"""Chunk store: logs of Parquet folders, and numbered pointers of which the newest holds.

Chunks and files are logs. A commit writes its new rows, and a tombstone (path, id) of each row that it removes; a tombstone
takes rows of earlier commits only, so a row may come back. Both lie in buckets by the low bits of the path's hash. What a commit
writes depends on what it changes, not on what there is. Where a bucket has `FANOUT` folders the smaller ones are merged, sizes growing
by powers, so a row is written again as often as the logarithm of the rows; where all of a bucket is merged its tombstones are applied
and go, and it is split if it holds more than `BUCKET_ROWS` rows. So buckets, folders and tasks grow with the data.

Each folder of chunks has its postings beside it. A commit ends with one pointer under the next number, which must not
exist: readers see all of a commit or none, at any time, and of two writers one fails. Folders that no pointer needs any more go with `vacuum`."""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from sparkseek import schemas
from sparkseek.functions.scalars import tokenize
from sparkseek.functions.sizes import SMALL
from sparkseek.operators import lexical

TABLES = {"chunks": schemas.CHUNK, "files": schemas.FILE, "identity": schemas.IDENTITY, "roots": schemas.ROOT, "quarantine": schemas.QUARANTINE}
LOGS = ("chunks", "files")
#: Bits of the first buckets, of the deepest ones, and the rows beyond which one is split.
DEPTH, MAX_DEPTH, BUCKET_ROWS = 4, 24, 250_000
#: Folders of a bucket at which it is merged.
FANOUT = 8
#: Postings of a commit with more tokens lie in a folder for each bucket of terms.
WIDE = 1_000_000
GONE = "path string, id string, seq bigint"
POSTINGS = "term string, id string, path string, dl int, tf bigint, term_bucket int, seq bigint"


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


def bucket_code(path: Column, split: list[int]) -> Column:
    """The bucket of a path: the low bits of its hash below a bit that tells how many they are. Buckets in `split` are no more; their rows
    are told apart by further bits."""
    h, out = F.xxhash64(path), []
    deepest = max((s.bit_length() for s in split), default=DEPTH)
    for d in range(DEPTH, deepest + 1):
        code = (h.bitwiseAND(F.lit((1 << d) - 1)) + F.lit(1 << d)).cast("int")
        own = [s for s in split if s.bit_length() == d + 1]
        out.append(F.when(~code.isin(own), code) if own else code)
    return F.coalesce(*out)


def to_merge(sizes: list[int], fanout: int) -> list[int]:
    """Which folders of a bucket are to be merged (their places), from the smallest on as long as the next one has no more rows than all of
    those together. None, or two at least."""
    if len(sizes) < fanout:
        return []
    order = sorted(range(len(sizes)), key=lambda k: sizes[k])
    n, total = 2, sizes[order[0]] + sizes[order[1]]
    while n < len(order) and sizes[order[n]] <= total:
        total, n = total + sizes[order[n]], n + 1
    return order[:n]


class Store:
    """All tables of one index."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.folder, self.fanout, self.bucket_rows = spark, folder.rstrip("/"), fanout, bucket_rows
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _pointer(self) -> tuple[int, dict]:
        """The newest pointer's number and contents; 0 if there is none. One that was cut off while it was written is passed over."""
        numbers = sorted((int(n.removeprefix("pointer-")) for n in self._names(self.folder) if n.startswith("pointer-")), reverse=True)
        for n in numbers:
            rows = self.spark.read.text(f"{self.folder}/pointer-{n:012d}", wholetext=True).take(1)
            try:
                return n, json.loads(rows[0][0])
            except (IndexError, ValueError):
                continue
        return 0, {}

    def exists(self) -> bool:
        return bool(self._pointer()[1])

    # --- reading ---

    def table(self, name: str) -> DataFrame:
        now, schema = self._pointer()[1], _parse_datatype_string(TABLES[name])
        if name in LOGS:
            return self._live(name, now).select(*schema.fieldNames())
        return self._read([now[name]] if now.get(name) else [], schema)

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{x}" for x in folders]) if folders else self.spark.createDataFrame([], schema)

    def _schema(self, name: str):
        return _parse_datatype_string(TABLES[name] + ", seq bigint" + (", dl int" if name == "chunks" else ""))

    def _gone(self, name: str, now: dict, buckets: list[str]) -> tuple[DataFrame, int]:
        """Tombstones of some buckets, the latest of each row, and how many were written."""
        own = [x for b in buckets for x in now.get(f"{name}_gone", {}).get(b, [])]
        rows = self._read([at for at, _ in own], _parse_datatype_string(GONE))
        return rows.groupBy("path", "id").agg(F.max("seq").alias("_gone")), sum(n for _, n in own)

    def _alive(self, rows: DataFrame, name: str, now: dict, buckets: list[str]) -> DataFrame:
        """Without the rows that tombstones of their buckets take. How many tombstones there are is known, so they are broadcast only if few."""
        gone, n = self._gone(name, now, buckets)
        if not n:
            return rows
        gone = F.broadcast(gone) if n <= SMALL else gone
        key = "id" if name == "chunks" else "path"
        same = (rows["path"] == gone["path"]) & (rows["seq"] < gone["_gone"])
        return rows.join(gone, same & (rows["id"] == gone["id"]) if key == "id" else same, "left_anti")

    def _live(self, name: str, now: dict, buckets: list[str] | None = None) -> DataFrame:
        """Rows that hold, of some buckets (None: all). Buckets without tombstones are read as they lie."""
        log = now.get(name, {})
        own = [b for b in log if buckets is None or b in buckets]
        dirty = [b for b in own if now.get(f"{name}_gone", {}).get(b)]
        clean = self._read([x[0] for b in own if b not in set(dirty) for x in log[b]], self._schema(name))
        if not dirty:
            return clean
        return self._alive(self._read([x[0] for b in dirty for x in log[b]], self._schema(name)), name, now, dirty).unionByName(clean)

    def _posted(self, folders: list[str]) -> DataFrame:
        """Postings of some folders of buckets. Those of small commits lie flat; in the others the bucket of terms is a folder, so that
        only those of the terms that are asked for are read."""
        schema = _parse_datatype_string(POSTINGS)
        wide = [x for x in folders if x.startswith("postings/wide/")]
        parts = [self._read([x for x in folders if x not in set(wide)], schema)]
        if wide:
            parts.append(self.spark.read.schema(schema).option("basePath", f"{self.folder}/postings/wide").parquet(*[f"{self.folder}/{x}" for x in wide]).select(*schema.fieldNames()))
        return reduce(DataFrame.unionByName, parts)

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """Stored postings, and one row of n and avgdl of all chunks."""
        now = self._pointer()[1]
        n, total = now.get("totals", (0, 0))
        stats = self.spark.createDataFrame([(n, total / n if n else 0.0)], "n bigint, avgdl double")
        log = now.get("chunks", {})
        rows = self._posted([x[2] for own in log.values() for x in own if x[2]])
        return self._alive(rows, "chunks", now, list(log)).drop("seq"), stats

    # --- writing ---

    def commit(self, gone: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """Adds rows to the logs, after taking out what `gone` names: by path, or of chunks by path and id. A log that is given
        without `gone` is replaced as a whole, as the other tables always are."""
        number, new = self._pointer()
        gone = gone or {}
        for name, df in tables.items():
            out = df.select(*_parse_datatype_string(TABLES[name]).fieldNames())
            if name in LOGS:
                self._append(name, out, gone.get(name), new, number + 1)
                continue
            new[name] = f"{name}-{uuid.uuid4().hex}"
            out.write.parquet(f"{self.folder}/{new[name]}")
        for name in tables:
            if name in LOGS:
                self._merge(name, new)
        self._point(number + 1, new)

    def _point(self, number: int, new: dict) -> None:
        p = self._path(f"{self.folder}/pointer-{number:012d}")
        try:
            stream = self._fs.create(p, False)
        except Exception as e:  # a Java exception: the number is taken
            raise Conflict(f"pointer {number} of {self.folder} exists") from e
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()

    def _dealt(self, rows: DataFrame, at: str, split: list[int], *by: str) -> dict[str, int]:
        """Writes rows in a folder for each bucket, in files of the size that Spark's rebalancing gives, and tells the rows of each."""
        keyed = rows.withColumn("bucket", bucket_code(F.col("path"), split))
        keyed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *by).write.partitionBy("bucket").parquet(f"{self.folder}/{at}")
        written = self.spark.read.schema("path string, bucket int").parquet(f"{self.folder}/{at}")
        return {str(r.bucket): r.n for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _append(self, name: str, rows: DataFrame, gone: DataFrame | None, new: dict, seq: int) -> None:
        own, removed = f"{name}-{uuid.uuid4().hex}", f"{name}-{uuid.uuid4().hex}"
        split = new.get(f"{name}_split", [])
        chunks = name == "chunks"
        total = new.get("totals", [0, 0]) if gone is not None else [0, 0]
        if gone is None:
            split = new[f"{name}_split"] = []
            new[name], new[f"{name}_gone"] = {}, {}
        elif new.get(name):
            touched = sorted(str(r[0]) for r in gone.select(bucket_code(F.col("path"), split)).distinct().collect())
            key = ["path", "id"] if chunks and "id" in gone.columns else ["path"]
            met = self._live(name, new, touched).join(gone.select(*key).distinct(), key, "left_semi")
            met = met.select("path", (F.col("id") if chunks else F.lit("")).alias("id"), F.lit(seq).cast("bigint").alias("seq"), *(["dl"] if chunks else []))
            for b, n in self._dealt(met, removed, split).items():
                new.setdefault(f"{name}_gone", {}).setdefault(b, []).append([f"{removed}/bucket={b}", n])
            if chunks:
                total = self._counted(removed, total, -1)
        rows = rows.withColumn("seq", F.lit(seq).cast("bigint"))
        if chunks:
            rows = rows.withColumn("dl", F.size(tokenize(lexical.indexed_text())))
        made, posted = self._dealt(rows, own, split, "path"), {}
        if chunks:
            new["totals"] = self._counted(own, total, 1)
            written = self.spark.read.schema(self._schema(name)).parquet(f"{self.folder}/{own}")
            posted = self._post(lexical.stored_form(written).withColumn("seq", F.lit(seq).cast("bigint")), new["totals"][1] - total[1], split)
        for b, n in made.items():
            new.setdefault(name, {}).setdefault(b, []).append([f"{own}/bucket={b}", n, posted.get(b)])

    def _counted(self, at: str, total: list[int], sign: int) -> list[int]:
        r = self.spark.read.schema("dl int").parquet(f"{self.folder}/{at}").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return [total[0] + sign * r[0], total[1] + sign * r[1]]

    def _post(self, rows: DataFrame, tokens: int, split: list[int]) -> dict[str, str]:
        """Writes postings, and tells the folder of each bucket."""
        wide = tokens > WIDE
        at = f"postings/{'wide' if wide else 'flat'}/commit={uuid.uuid4().hex}"
        by = ["bucket", "term_bucket"] if wide else ["bucket"]
        keyed = rows.withColumn("bucket", bucket_code(F.col("path"), split))
        keyed.hint("rebalance", *map(F.col, by)).sortWithinPartitions("bucket", "term_bucket", "term").write.partitionBy(*by).parquet(f"{self.folder}/{at}")
        return {x.removeprefix("bucket="): f"{at}/{x}" for x in self._names(f"{self.folder}/{at}") if x.startswith("bucket=")}

    def _merge(self, name: str, new: dict, all_of: bool = False) -> None:
        """Merges the folders of buckets that have too many, or whose tombstones outnumber half of their rows, and splits what is too large;
        all such buckets in one job. New buckets come in place of the split ones in the same pointer."""
        log, gone, split = new[name], new.setdefault(f"{name}_gone", {}), new.setdefault(f"{name}_split", [])
        unsplit = new.setdefault(f"{name}_unsplit", [])
        part: dict[str, list[int]] = {}
        cut: list[int] = []
        for b, own in log.items():
            rows, dead, code = sum(x[1] for x in own), gone.get(b, []), int(b)
            depth = code.bit_length() - 1
            large = rows > self.bucket_rows and depth < MAX_DEPTH and code not in unsplit
            if large or (all_of and (len(own) > 1 or dead)) or 2 * sum(n for _, n in dead) > rows or len(dead) >= self.fanout:
                part[b] = list(range(len(own)))
            elif picked := to_merge([x[1] for x in own], self.fanout):
                part[b] = picked
            if large:  # by as many bits as bring the mean below the limit
                cut.append(code)
                for d in range(depth, min(MAX_DEPTH, depth + math.ceil(math.log2(rows / self.bucket_rows)))):
                    split += [code - (1 << depth) + (i << depth) + (1 << d) for i in range(1 << (d - depth))]
        if not part:
            return
        at, old = f"{name}-{uuid.uuid4().hex}", [log[b][k] for b, places in part.items() for k in places]
        made, posted = self._dealt(self._alive(self._read([x[0] for x in old], self._schema(name)), name, new, list(part)), at, split, "path"), {}
        if name == "chunks":
            posted = self._post(self._alive(self._posted([x[2] for x in old if x[2]]), name, new, list(part)), self._counted(at, [0, 0], 1)[1], split)
        for b, places in part.items():
            if len(places) == len(log[b]):
                gone.pop(b, None)
            log[b] = [x for k, x in enumerate(log[b]) if k not in set(places)]
            if not log[b]:
                del log[b]
        for b, n in made.items():
            log.setdefault(b, []).append([f"{at}/bucket={b}", n, posted.get(b)])
        for code in cut:  # what one path holds can't be told apart
            low = (1 << (code.bit_length() - 1)) - 1
            own = [int(b) for b in made if int(b).bit_length() > code.bit_length() and (int(b) ^ code) & low == 0]
            unsplit += own if len(own) == 1 else []

    def compact(self) -> None:
        """Merges all folders of each bucket, and applies its tombstones."""
        number, new = self._pointer()
        for name in LOGS:
            if new.get(name):
                self._merge(name, new, all_of=True)
        self._point(number + 1, new)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what the newest `keep` pointers don't need; nobody may still read older ones."""
        names = self._names(self.folder)
        pointers = [n for n in names if n.startswith("pointer-")]
        needed: set[str] = set(pointers[-keep:])

        def folders(x) -> None:
            if isinstance(x, str):
                at = x.split("/")
                needed.add("/".join(at[:3]) if at[0] == "postings" else at[0])
            elif isinstance(x, list | dict):
                for y in x.values() if isinstance(x, dict) else x:
                    folders(y)

        for p in pointers[-keep:]:
            rows = self.spark.read.text(f"{self.folder}/{p}", wholetext=True).take(1)
            folders(json.loads(rows[0][0]) if rows else [])
        own = [n for n in names if n.split("-")[0] in {"pointer", *TABLES}]
        own += [f"postings/{kind}/{n}" for kind in ("flat", "wide") for n in self._names(f"{self.folder}/postings/{kind}")]
        for n in own:
            if n not in needed:
                self._fs.delete(self._path(f"{self.folder}/{n}"), True)

    def add(self, chunks: DataFrame) -> None:
        """Upsert by id. An id belongs to one path."""
        self.commit({"chunks": chunks}, chunks=chunks)

    def delete(self, where: dict | None = None, contains: str | None = None, ids: list[str] | None = None) -> None:
        """By equality of columns, by content, or by ids; what is given has to hold together."""
        gone = F.lit(True)
        for k, v in (where or {}).items():
            gone = gone & F.col(k).eqNullSafe(F.lit(v))
        if contains:
            gone = gone & F.col("content").contains(contains)
        if ids is not None:
            gone = gone & F.col("id").isin(*ids)
        if where or contains or ids is not None:
            now = self.table("chunks")
            self.commit({"chunks": now.where(gone)}, chunks=now.limit(0))


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks in the order of ids (pos, id); ids that there are none of are left out."""
    return ids.join(chunks, "id").orderBy("pos")


def missing_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(chunks.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


def where_equal(chunks: DataFrame, **values) -> DataFrame:
    cond: Column = F.lit(True)
    for k, v in values.items():
        cond = cond & (F.col(k) == F.lit(v))
    return chunks.where(cond)


