"""Exact substring deduplication by suffix arrays, in parallel.

A byte goes if it lies in a string of `LENGTH` bytes that also starts anywhere else. Equal strings are brought together without
moving all suffixes: within each string of `LENGTH` bytes the `GRAM` bytes of the least hash (the first of equal ones) are its
anchor, which depends on the string alone; neighbouring strings share their anchor, so a text has about one for every 185 bytes.
Only anchors whose hash occurs twice are pursued. Each anchor's strings form a stretch of text; stretches meet by hash, and the
suffixes that start there are sorted in two stages: those smaller than their successor directly, the others induced by a scan of
the buckets of first bytes in which each is placed by the rank of its successor. Neighbours with a common prefix of `LENGTH`
or more mark their starts.

Texts that are equal as a whole are looked at once. Hashes with more than `HOT` anchors are split by where a string has its anchor
and by the bytes that all strings with it there have in common; equal stretches are sorted once.

Passages of fewer bytes than `LENGTH` stay, but are reported: of each `WORDS` words in a row one run of `RUN` words, that of the least hash, is
chosen. It depends on these words alone, so documents that share such a passage share a run. `n_shared` counts the chosen runs that another
document has chosen, too: over 0 where `WORDS` words are shared, and 0 where no `RUN` words are.

Defined results: null text is empty; texts under `LENGTH` bytes stay whole; a doc_id may be null or repeat, each row gets its
result (and rows with equal texts of `LENGTH` bytes or more empty each other); extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import table, task_of
from sparkseek.session import materialise

LENGTH, GRAM = 400, 32
HOT, STEP = 2048, 46
#: Bytes of stretches sorted together, as long as hashes allow.
PIECE = 1 << 22
#: Words of a passage, and of a run that stands for it (a power of two).
WORDS, RUN = 50, 16
_SPAN = LENGTH - GRAM + 1
_PLACE_BITS = 21
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on (zeros beyond the end) as one number, first byte highest."""
    raw = data.tobytes() + b"\0" * 16
    out = np.empty(len(data), _U)
    for k in range(min(8, len(data))):
        part = np.frombuffer(raw, ">u8", (len(data) - k + 7) // 8, k)
        out[k::8] = part[: len(out[k::8])]
    return out


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Of each w values that follow each other, the least."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, _U)]).reshape(-1, w)
    before = np.minimum.accumulate(padded, 1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of the strings of `LENGTH` bytes that have an anchor there."""
    got: list[tuple] = []
    limit = (1 << _PLACE_BITS) - LENGTH
    for a in range(0, len(data) - LENGTH + 1, limit):
        part = np.frombuffer(data, np.uint8, min(len(data) - a, limit + LENGTH - 1), a)
        w = _mix(words8(part))
        n = len(part) - GRAM + 1
        h = w[:n].copy()
        for k in range(8, GRAM, 8):
            h = h * _U(0x9E3779B97F4A7C15) + w[k : k + n]
        h = _mix(h)
        mask = _U((1 << _PLACE_BITS) - 1)
        key = (h & ~mask) | np.arange(n, dtype=_U)
        place = (_sliding_least(key, _SPAN) & mask).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        got.append((h[p].view(np.int64), p + a, first + a, last + a))
    if not got:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def passages(data: bytes) -> np.ndarray:
    """Hashes of the runs of `RUN` words that are chosen from the passages of `WORDS` words, each once. Words end at ASCII space and control characters."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(data, np.uint8) > 32
    step = np.diff(inside)
    start = np.flatnonzero(step == 1)
    if len(start) < WORDS:
        return np.zeros(0, np.int64)
    left = np.flatnonzero(step == -1) - start
    eight = words8(np.frombuffer(data, np.uint8))
    h, at = left.astype(_U), np.arange(len(start))
    for k in range(0, int(left.max()), 8):
        at = at[left[at] > k]
        beyond = (8 * np.maximum(0, 8 - left[at] + k)).astype(_U)
        h[at] = _mix(h[at] * _U(0x9E3779B97F4A7C15) + (eight[start[at] + k] >> beyond))
    n = 1
    while n < RUN:
        h = _mix(h[:-n] * _U(0x9E3779B97F4A7C15) + h[n:])
        n *= 2
    return np.unique(_sliding_least(h, WORDS - RUN + 1)).view(np.int64)


def suffix_order(text: np.ndarray, raw: bytes, need: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places in `need`, in the order of their suffixes. text: bytes + 1, and 0 where a stretch ends; end: where the stretch of each
    place ends. With a place, its successors up to the first that is smaller than its own successor have to be in `need`."""
    n = len(text)
    # Stage one. Smaller than the successor: decided by the next different value; at the end of a stretch never.
    differs = np.flatnonzero(text[:-1] != text[1:])
    run_end = differs[np.searchsorted(differs, need)]
    smaller = (text[need] == 0) | (text[run_end] < text[run_end + 1])
    direct = need[smaller]
    ends = end[direct].tolist()
    # Bucket by bucket, so that only its suffixes are at hand as bytes.
    bucket = np.argsort(text[direct], kind="stable")
    order_b = []
    starts, values = direct[bucket], text[direct[bucket]]
    ends = np.asarray(ends, np.int64)[bucket] if len(direct) else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(values, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(values)), strict=True):
        s, e = starts[a:b].tolist(), ends[a:b].tolist()
        keys = [raw[x:y] for x, y in zip(s, e, strict=True)]
        order_b.append((int(values[a]), np.array([s[i] for i in sorted(range(len(s)), key=keys.__getitem__)], np.int64)))
    del starts, ends
    # Stage two: buckets in order; in each the induced ones first, by the rank of their successor.
    rank = np.full(n + 1, -1, np.int64)
    other = need[~smaller]
    other = other[np.argsort(text[other], kind="stable")]
    o_values = text[other]
    direct_of = dict(order_b)
    out, done = [], 0
    for c in sorted({*direct_of, *np.unique(o_values).tolist()}):
        mine = other[np.searchsorted(o_values, c) : np.searchsorted(o_values, c, side="right")]
        level = mine[text[mine + 1] < c]  # then those before one of this level, and so on
        rest = mine[text[mine + 1] == c]
        while len(level):
            level = level[np.argsort(rank[level + 1], kind="stable")]
            rank[level] = np.arange(done, done + len(level))
            done += len(level)
            out.append(level)
            ready = rank[rest + 1] >= 0
            level, rest = rest[ready], rest[~ready]
        if c in direct_of:
            rank[direct_of[c]] = np.arange(done, done + len(direct_of[c]))
            done += len(direct_of[c])
            out.append(direct_of[c])
    return np.concatenate(out) if out else need[:0]


def common_prefix_reaches(words: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Whether the strings of `LENGTH` bytes at a and b are equal; room: bytes that both have left."""
    ok = np.flatnonzero(room >= LENGTH)
    for k in range(0, LENGTH, 8):
        ok = ok[words[a[ok] + k] == words[b[ok] + k]]
    out = np.zeros(len(a), bool)
    out[ok] = True
    return out


def repeated_starts(stretches: list[bytes], n_starts: list[int], copies: list[bool]) -> list[np.ndarray]:
    """For each stretch, which of its first starts begin a string of `LENGTH` bytes that starts elsewhere among all of them, too.
    Stretches are different; copies: of which there are further equal ones."""
    raw = b"\0".join(stretches) + b"\0"
    data = np.frombuffer(raw, np.uint8)
    size = np.array([len(s) for s in stretches], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = data.astype(np.int16) + 1
    text[begin + size] = 0
    text = np.append(text, np.int16(1))
    n_starts = np.array(n_starts, np.int64)
    end = np.repeat(begin + size, size + 1)
    # Starts, and as far as the induction looks beyond the last of them.
    differs = np.flatnonzero(text[:-1] != text[1:])
    reach = begin + n_starts - 1
    while True:
        run_end = differs[np.searchsorted(differs, reach)]
        go = (text[reach] != 0) & (text[run_end] > text[run_end + 1])
        if not go.any():
            break
        reach = np.where(go, run_end + 1, reach)
    count = reach - begin + 1
    need = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    order = suffix_order(text, raw, need, end)
    words = words8(data)
    limit = begin + n_starts
    which = np.searchsorted(begin, order, side="right") - 1
    is_start = order < limit[which]
    order = order[is_start]
    room = end[order] - order
    same = common_prefix_reaches(words, order[:-1], order[1:], np.minimum(room[:-1], room[1:]))
    hit = np.zeros(len(raw), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    out = []
    for b, n, c in zip(begin.tolist(), n_starts.tolist(), copies, strict=True):
        out.append(np.ones(n, bool) if c else hit[b : b + n])
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    d = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


META = "doc_id long, key binary, n_bytes long, sha string, hash array<long>, place array<int>, low array<int>, high array<int>, chosen array<long>, n_chosen long"


def _meta(docs: DataFrame) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            got = [anchors(t) for t in texts]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([g[k] for g in got]).astype(np.int32 if k else np.int64))) for k in range(4)] if got else [pa.array([], pa.list_(pa.int64() if k == 0 else pa.int32())) for k in range(4)]
            runs = [passages(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), *lists,
                 pa.array(runs, pa.list_(pa.int64())), pa.array([len(x) for x in runs], pa.int64())],
                ["doc_id", "key", "n_bytes", "sha", "hash", "place", "low", "high", "chosen", "n_chosen"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(go, META)


STRETCH = "hash long, n int, stretch binary, at array<struct<key:binary,start:int>>"
_STRETCH_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("key", pa.binary()), ("start", pa.int32())])))
_STRETCH_NAMES = ["hash", "n", "stretch", "at"]


def _stretches(rows: DataFrame) -> DataFrame:
    """rows: key, text, want (array of hash, place, low, high, hot). Equal stretches are gathered before they are shuffled."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        found: dict[tuple[int, bytes], list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            cols = ([k[0] for k in found], [v[0] for v in found.values()], [k[1] for k in found], [v[1] for v in found.values()])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _STRETCH_TYPES, strict=True)], _STRETCH_NAMES)

        for b in batches:
            for key, text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in want:
                    p, low, high = x["place"], x["low"], x["high"]
                    parts = [(x["hash"], low, high)]
                    if x["hot"]:
                        parts = []
                        for j in range((p - high) // STEP, (p - low) // STEP + 1):
                            a, z = p - STEP * (j + 1) + 1, p - STEP * j  # all starts whose anchor is so far on
                            core = xxhash.xxh64_intdigest(data[z : a + LENGTH], seed=j + 1)
                            parts.append((core - (1 << 63), max(a, low), min(z, high)))
                    for h, a, z in parts:
                        s = data[a : z + LENGTH]
                        old = found.get((h, s))
                        if old is None:
                            old = found[h, s] = [z - a + 1, []]
                            size += len(s)
                        old[1].append({"key": key, "start": a})
                        size += 32
                if size > PIECE:
                    yield out()
                    found, size = {}, 0
        yield out()

    return rows.select("key", "text", "want").mapInArrow(go, STRETCH)


def _repeats(stretches: DataFrame) -> DataFrame:
    """key, first and last starts of runs of repeated strings. Stretches come sorted by hash; whole hashes are sorted together."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        index: dict[tuple[int, bytes], int] = {}
        uniq: list[bytes] = []
        n: list[int] = []
        seen: list[int] = []
        per: dict[int, int] = {}
        for h, k, s, at in rows:
            i = index.setdefault((h, s), len(uniq))
            if i == len(uniq):
                uniq.append(s)
                n.append(k)
                seen.append(0)
                per[h] = per.get(h, 0) + 1
            seen[i] += len(at)
        # A hash with one kind of stretch needs no sorting.
        sort = [i for (h, _), i in index.items() if per[h] > 1]
        hits: dict[int, np.ndarray] = {}
        if sort:
            hits = dict(zip(sort, repeated_starts([uniq[i] for i in sort], [n[i] for i in sort], [seen[i] > 1 for i in sort]), strict=True))
        keys, first, last = [], [], []
        runs: dict[int, tuple[list, list]] = {}
        for h, k, s, at in rows:
            i = index[h, s]
            if i not in runs:
                a, z = _runs(hits[i] if i in hits else np.full(k, seen[i] > 1))
                runs[i] = (a.tolist(), z.tolist())
            for a, z in zip(*runs[i], strict=True):
                for x in at:
                    keys.append(x["key"])
                    first.append(x["start"] + a)
                    last.append(x["start"] + z)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["key", "first", "last"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("substrings")
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > PIECE and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield solve(rows)

    return stretches.repartition("hash").sortWithinPartitions("hash").mapInArrow(go, "key binary, first long, last long")


KEPT = "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _kept(rows: DataFrame, with_text: bool) -> DataFrame:
    """rows: key, text, runs (array of first, last)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for a, z in sorted((r["first"], r["last"] + LENGTH) for r in runs):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                at, parts = 0, []
                for a, z in spans:
                    parts.append(data[at:a])
                    at = z
                kept = b"".join([*parts, data[at:]])
                for c, v in zip(out, (key, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("key", "text", "runs").mapInArrow(go, KEPT)


def _shared(meta: DataFrame) -> DataFrame:
    """mark (of a text), n_shared: its chosen runs that another text has, too."""
    rows = meta.select("mark", F.explode("chosen").alias("run")).repartition("run")  # dealt out once, for both sides
    several = rows.groupBy("run").agg(F.min("mark").alias("a"), F.max("mark").alias("z")).where("a <> z").select("run")
    return rows.join(several, "run").groupBy("mark").agg(F.count_distinct("run").alias("n_shared"))


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, (with_text) kept: the remaining bytes, null where nothing was removed, and n_shared."""
    meta = materialise(_meta(docs), "anchors")
    nodes = meta.groupBy("key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    # One row for each different text.
    unique = meta.join(nodes, "key").where(F.col("doc_id").eqNullSafe(F.col("node")) & (F.col("n_bytes") >= LENGTH)).dropDuplicates(["key"])
    rows = unique.select("key", F.explode(F.arrays_zip("hash", "place", "low", "high")).alias("x")).select("key", "x.*")
    rows = materialise(rows, "places")
    often = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", (F.col("n") > HOT).alias("hot"))
    often = materialise(often, "often")  # read again, a join with it can split a hash that very many anchors have
    want = rows.join(often, "hash").groupBy("key").agg(F.collect_list(F.struct("hash", "place", "low", "high", "hot")).alias("want"))
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    one = texts.join(want.join(nodes.select("key", "node"), "key"), "key").where(F.col("doc_id").eqNullSafe(F.col("node")))
    runs = _repeats(_stretches(one)).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    single = runs.join(nodes.where("copies = 1").select("key", "node"), "key")
    # The same columns as above, so that the texts are shuffled once.
    kept = _kept(texts.join(single, "key").where(F.col("doc_id").eqNullSafe(F.col("node"))), with_text)
    whole = meta.select("doc_id", "key", "n_bytes", "sha", "n_chosen").join(nodes.select("key", "copies"), "key")
    shared = _shared(meta.select(F.xxhash64("key").alias("mark"), "chosen"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    same = F.coalesce("n_removed", F.lit(0))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = whole.join(kept, "key", "left").withColumn("mark", F.xxhash64("key")).join(shared, "mark", "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(same).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("copies") > 1, F.col("n_chosen")).otherwise(F.coalesce("n_shared", F.lit(0))).alias("n_shared"),
    )
    return out if with_text else out.drop("kept")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


QUERIES = {"op6_substrings": op6_substrings}
