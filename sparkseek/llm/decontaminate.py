"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared in lower case with white space folded, as UTF-8 bytes. An item of m bytes occurs in a text if it
aligns there with at most k = m/`EDITS` byte edits. Then at least m + 1 - `Q`(k + 1) of its q-grams recur on k + 1 neighbouring
diagonals; so shared q-grams are counted in bands of twice that width which overlap by half, and bands that reach the bound
are verified by an alignment of the whole item within the band. For items too short for the bound, k is lowered until one
q-gram suffices; items under `Q` bytes must occur as they are.

A q-gram that many items share says little, so each item leaves out of the search those of its q-grams that most items have, as many
as the bound can spare: where the others don't reach what is left of the bound, the whole count can't reach it either. What
remains is counted with all q-grams. Where texts and items have more places in common than `OCCURRENCES`, the texts, then a text (by
stretches that overlap by more than an item), then the items are halved.

Items go to the executors in blocks of `BLOCK_BYTES` at most, one written pass over the texts for each, so that one block's index at
a time is in a worker's memory, however many items there are.

Defined results: null and empty texts hold nothing; null and empty items are passed over, a null item_id shows as -1; of the places of an item in a text
the one with fewest edits counts, then the first; repeated documents and items each give rows of their own; extra columns
pass through `drop_leaks` (whatever their names) and are left out by `find_leaks`; very long texts and items are looked at whole; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import by_place, fresh_name, table, task_of
from sparkseek.session import materialise

Q = 8
EDITS = 10
BLOCK_BYTES = 4 << 20
#: Pairs of a place in a text and one in an item looked at together.
OCCURRENCES = 1 << 20
#: Text bytes looked at together.
PIECE = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 24


def fold(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def budget(m: int) -> int:
    """Edits allowed for an item of m bytes: as many as leave one q-gram."""
    return max(0, min(m // EDITS, (m - Q) // Q))


def least_shared(m: int) -> int:
    return m + 1 - Q * (budget(m) + 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """The `Q` bytes from each place on, as one number."""
    n = len(data) - Q + 1
    out = np.empty(n, np.uint64)
    raw = data.tobytes()
    for k in range(min(Q, n)):
        part = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        out[k::Q] = part[: len(out[k::Q])]
    return out


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits of the whole item against any stretch of the text, on paths over diagonals (place in text less place in item)
    low - most to high + most: (edits, start, end), or None beyond `most`. Of equal ones the first end, then the latest start."""
    return align_many([item], text, np.array([[0, len(text), low, high, most]], np.int64))[0]


def align_many(items: list[np.ndarray], data: np.ndarray, where: np.ndarray) -> list[tuple[int, int, int] | None]:
    """`align` for many items at once, row by row of all. where: start and size of the text in data, low, high, most."""
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    size = np.array([len(x) for x in items], np.int64)
    width = where[:, 3] - where[:, 2] + 2 * where[:, 4] + 1
    order = np.lexsort((width, size))
    at = 0
    while at < len(order):
        z = at + 1
        while z < len(order) and (z + 1 - at) * max(int(width[order[at : z + 1]].max()), int(size[order[z]])) <= _CELLS and size[order[z]] <= 2 * size[order[at]] + 16:
            z += 1
        _align_batch(order[at:z], items, size, width, data, where, out)
        at = z
    return out


_ONE, _FAR = 1 << 32, 1 << 52
#: Cells of the rows that are worked out together.
_CELLS = 1 << 18


def _align_batch(own: np.ndarray, items: list[np.ndarray], size: np.ndarray, width: np.ndarray, data: np.ndarray, where: np.ndarray, out: list) -> None:
    start, n, low, _, most = where[own].T
    a, w, length = low - most, width[own], size[own]
    longest, wide = int(length.max()), int(w.max())
    steps = np.arange(wide)
    item = np.full((len(own), longest), 300, np.int16)
    for r, i in enumerate(own.tolist()):
        item[r, : size[i]] = items[i]
    there = a[:, None] + np.arange(wide + longest)
    text = np.where((there >= 0) & (there < n[:, None]), data[np.clip(start[:, None] + there, 0, max(len(data) - 1, 0))] if len(data) else 0, 256).astype(np.int16)
    place = a[:, None] + steps
    beyond = steps >= w[:, None]
    # Costs carry their start along: the larger start wins among equal costs.
    key = np.where((place >= 0) & (place <= n[:, None]) & ~beyond, (1 << 31) - place, _FAR)
    for i in range(longest):
        same = key + _ONE * (text[:, i : i + wide] != item[:, i : i + 1])
        gone = np.full_like(key, _FAR)  # item[i] is missing in the text
        gone[:, :-1] = key[:, 1:] + _ONE
        now = place + (i + 1)
        new = np.where((now >= 0) & (now <= n[:, None]) & ~beyond, np.minimum(same, gone), _FAR)
        key = np.minimum.accumulate(new - _ONE * steps, 1) + _ONE * steps  # text has more
        done = length == i + 1
        if done.any():
            ends = now[done]
            last = np.where((ends >= 0) & (ends <= n[done][:, None]) & ~beyond[done], key[done], _FAR)
            edits = last >> 32
            best = edits.argmin(1)
            for r, j, e, c, z, k in zip(own[done].tolist(), best.tolist(), edits[np.arange(len(best)), best].tolist(), last[np.arange(len(best)), best].tolist(), ends[np.arange(len(best)), best].tolist(), most[done].tolist(), strict=True):
                if e <= k:
                    out[r] = (e, (1 << 31) - (c & (_ONE - 1)), z)
        if done.any() or i % 8 == 7:
            go = ~done & (key.min(1) < (most + 1) * _ONE)
            if not go.all():
                own, start, n, most, length = own[go], start[go], n[go], most[go], length[go]
                item, text, place, beyond, key = item[go], text[go], place[go], beyond[go], key[go]
                if not len(own):
                    return


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        self.ids = [i for i, t in items if len(t) >= Q]
        self.texts = [np.frombuffer(t, np.uint8) for _, t in items if len(t) >= Q]
        self.short = [(i, t) for i, t in items if 0 < len(t) < Q]
        size = np.array([len(t) for t in self.texts], np.int64)
        grams = [_grams(t) for t in self.texts]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(grams), dtype=np.int32), size - Q + 1)
        at = (np.arange(len(every)) - np.repeat(np.cumsum(size - Q + 1) - (size - Q + 1), size - Q + 1)).astype(np.int32)
        self.width = np.array([budget(len(t)) + 1 for t in self.texts], np.int64)
        self.least = np.array([least_shared(len(t)) for t in self.texts], np.int64)
        self.longest = max((len(t) for t in self.texts), default=0)
        # The whole index, for counting, and a thinner one, for the search.
        order = np.argsort(every, kind="stable")
        self.item, self.place = of[order], at[order]
        self.gram, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.key = np.repeat(np.arange(len(self.gram)), self.count) * max(1, len(self.texts)) + self.item
        often = np.repeat(self.count, self.count)  # of each occurrence's gram
        by = np.lexsort((-often, self.item))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.repeat(np.cumsum(size - Q + 1) - (size - Q + 1), size - Q + 1)
        spare = self.least // 2
        keep = rank >= spare[self.item]
        self.need = self.least - spare
        which = np.repeat(np.arange(len(self.gram)), self.count)[keep]
        self.kept = np.flatnonzero(keep)
        self.kept_count = np.bincount(which, minlength=len(self.gram))
        self.kept_first = np.cumsum(self.kept_count) - self.kept_count
        self.bits = int(np.clip(np.ceil(np.log2(max(1, 8 * len(self.gram)))), 8, _TABLE_BITS))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.gram[self.kept_count > 0])] = True
        self.whole = np.zeros(1 << self.bits, bool)
        self.whole[self._slot(self.gram)] = True
        self._halves: tuple[Index, Index] | None = None

    def halves(self) -> tuple[Index, Index]:
        if self._halves is None:
            long = [x for x in self.items if len(x[1]) >= Q]
            self._halves = Index(long[: len(long) // 2]), Index(long[len(long) // 2 :])
        return self._halves

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * _MIX) >> np.uint64(64 - self.bits)

    def bands(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, low, high): runs of bands, as diagonals, that share enough q-grams. ends: of each text in data, with its separator."""
        if len(data) < Q or not len(self.gram):
            return []
        starts = np.concatenate([[0], ends[:-1]])
        g = _grams(data)
        slot = self._slot(g)
        where = np.flatnonzero(self.table[slot])
        k = np.minimum(np.searchsorted(self.gram, g[where]), len(self.gram) - 1)
        known = (self.gram[k] == g[where]) & (self.kept_count[k] > 0)
        where, k = where[known], k[known]
        top = (len(data) + self.longest) // int(self.width.min()) + 2
        if int(self.kept_count[k].sum()) > OCCURRENCES or len(ends) * len(self.texts) * top * (self.longest + 1) >= 1 << 62:
            if len(ends) > 1:
                half = len(ends) // 2
                cut = int(ends[half - 1])
                return self.bands(data[:cut], ends[:half]) + [(t + half, *x) for t, *x in self.bands(data[cut:], ends[half:] - cut)]
            lap = 2 * (self.longest + int(self.width.max()))  # an occurrence, with its edits, lies in one of the stretches
            if len(data) > 4 * lap:
                middle = len(data) // 2
                a = self.bands(data[: middle + lap], np.array([middle + lap]))
                b = self.bands(data[middle:], np.array([len(data) - middle]))
                return a + [(0, i, low + middle, high + middle) for _, i, low, high in b]
            if len(self.texts) > 1:
                a, b = self.halves()
                return a.bands(data, ends) + [(t, i + len(a.texts), *x) for t, i, *x in b.bands(data, ends)]
        n = self.kept_count[k]
        rows = np.repeat(np.arange(len(where)), n)
        occurrence = self.kept[np.repeat(self.kept_first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        item = self.item[occurrence].astype(np.int64)
        text = np.searchsorted(ends, where, side="right")[rows]
        # Diagonals are shifted so that they aren't negative.
        diagonal = where[rows] - starts[text] - self.place[occurrence] + self.longest
        band = diagonal // self.width[item]
        pair = (text * len(self.texts) + item) * top
        key, count = np.unique(np.concatenate([pair + band, (pair + band - 1)[band > 0]]), return_counts=True)
        got = key[count >= self.need[(key // top) % len(self.texts)]]
        if not len(got):
            return []
        t, i, b = got // top // len(self.texts), got // top % len(self.texts), got % top
        low = b * self.width[i] - self.longest
        full = np.zeros(len(got), bool)
        gram = np.full(len(g), -1, np.int64)
        rest = np.flatnonzero(self.whole[slot])
        j = np.minimum(np.searchsorted(self.gram, g[rest]), len(self.gram) - 1)
        gram[rest] = np.where(self.gram[j] == g[rest], j, -1)
        for x in range(0, len(got), 4096):
            part = slice(x, x + 4096)
            full[part] = self._shared(gram, starts[t[part]], (ends - starts)[t[part]], i[part], low[part], low[part] + 2 * self.width[i[part]] - 1) >= self.least[i[part]]
        out: list[tuple[int, int, int, int]] = []
        for t, i, low in zip(t[full].tolist(), i[full].tolist(), low[full].tolist(), strict=True):
            high = low + 2 * int(self.width[i]) - 1
            # The band before overlaps; long runs stay several, so that alignments stay narrow.
            if out and out[-1][:2] == (t, i) and out[-1][3] >= low and high - out[-1][2] < 8 * int(self.width[i]):
                out[-1] = (t, i, out[-1][2], high)
            else:
                out.append((t, i, low, high))
        return out

    def _shared(self, gram: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of items whose q-grams recur in a text on diagonals from low to high (each counts once). gram: number of the q-gram at each
        place of the texts, or -1."""
        length = np.array([len(self.texts[i]) for i in item.tolist()], np.int64)
        a, z = np.maximum(0, low), np.minimum(size - Q + 1, length + high + 1)
        n = np.maximum(0, z - a)
        which = np.repeat(np.arange(len(item)), n)
        there = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at = np.minimum(start[which] + there, len(gram) - 1)
        k = gram[at]
        use = k >= 0
        which, there, k = which[use], there[use], k[use]
        # Occurrences are in the order of grams, then items.
        key = k * len(self.texts) + item[which]
        left, right = np.searchsorted(self.key, key, side="left"), np.searchsorted(self.key, key, side="right")
        n = right - left
        which, there = np.repeat(which, n), np.repeat(there, n)
        place = self.place[np.repeat(left - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].astype(np.int64)
        use = (there - place >= low[which]) & (there - place <= high[which])
        both = np.unique(which[use] * (self.longest + 1) + place[use])
        return np.bincount(both // (self.longest + 1), minlength=len(item))

    def hits(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: (item id, edits, start, end) in bytes, one for each item in it."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        ids: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        batch: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            batch.append(i)
            size += len(t) + Q
            if size >= PIECE or i + 1 == len(texts):
                data = np.frombuffer(b"".join(texts[k] + b"\0" * Q for k in batch), np.uint8)
                ends = np.cumsum([len(texts[k]) + Q for k in batch])
                starts, size_of = np.concatenate([[0], ends[:-1]]), [len(texts[k]) for k in batch]
                near = self.bands(data, ends)
                at = np.array([(starts[d], size_of[d], low, high, int(self.width[item]) - 1) for d, item, low, high in near], np.int64).reshape(-1, 5)
                for (d, item, _, _), got in zip(near, align_many([self.texts[x[1]] for x in near], data, at), strict=True):
                    old = found[batch[d]].get(item)
                    if got and (old is None or (got[0], got[2]) < (old[0], old[2])):
                        found[batch[d]][item] = got
                batch, size = [], 0
        for i, t in enumerate(texts):
            ids[i] = [(self.ids[item], *x) for item, x in sorted(found[i].items())]
            ids[i] += [(own, 0, t.index(s), t.index(s) + len(s)) for own, s in self.short if s in t]
        return ids


def places(text: str) -> list[int]:
    """Of each folded byte of a text, the character that it comes from."""
    space, out = False, []
    for i, c in enumerate(text):
        if c.isspace():
            space = bool(out)
            continue
        if space:
            out.append(i)
            space = False
        out += [i] * len(c.lower().encode("utf-8", "surrogatepass"))
    return out


def _blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes over all items, of bounded size each."""
    known = items.where(F.length("text") > 0).select(F.col("item_id").cast("long"), "text")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (BLOCK_BYTES // 2))  # half full on average
    for b in range(n):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else known
        yield Index(sorted((i if i is not None else -1, fold(t)) for i, t in own.collect()))


HITS = "item_id long, edits int, start long, end long"


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text", to: str = "leaks") -> DataFrame:
    """Adds an array of (item_id, edits, start, end), the places in characters."""
    base, kept, at = by_place(docs, text, [to])
    out = base.withColumn("leaks", F.array().cast(f"array<struct<{HITS.replace(' ', ':').replace(',:', ',')}>>"))
    schema = out.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    for k, index in enumerate(_blocks(items)):
        if k:
            out = materialise(out, "leaks")
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            task_of("decontaminate")
            for b in batches:
                texts = [t or "" for t in b.column(at).to_pylist()]
                old = b.column(len(kept)).to_pylist()
                got = shared.value.hits([fold(t) for t in texts])
                new = []
                for t, before, hits in zip(texts, old, got, strict=True):
                    of = places(t) if hits else []
                    new.append(before + [dict(zip(("item_id", "edits", "start", "end"), (i, e, of[a], of[z - 1] + 1), strict=True)) for i, e, a, z in hits if z > a])
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(new, kind)], b.schema.names)

        out = out.mapInArrow(go, schema)
    return out.toDF(*kept, to)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item in it."""
    return with_leaks(docs.select("doc_id", "text"), items).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any item."""
    hidden = fresh_name(docs, "leaks")
    return with_leaks(docs, items, to=hidden).where(F.size(hidden) == 0).drop(hidden)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
