"""Lossless WebP (VP8L): a full decoder and an encoder for media columns.

The decoder handles prefix codes (simple and normal), meta prefix codes, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. Many images are decoded in step: one symbol of each at a time, with
arrays over the images. Streams with several groups of codes go symbol by symbol.

The encoder works out several plans for each image (grey samples with subtract-green; palettes with bundled pixels; four bytes a
pixel, with or without a colour cache; predictor with cross-colour or subtract-green), each with back-references, and writes
the one with the least estimated size; it depends on the image alone.

Defined results of the column operators: null bytes stay null; empty bytes give empty media; bytes that are no multiple of
`ROW_BYTES` are padded with zero bytes, and `n_bytes` says how many count; more than `IMAGE_BYTES` go to several images
one after another; equal bytes give equal media, whatever is coded beside them; extra columns pass through (one that has the name
of the new column is replaced); an empty table gives an empty result; damaged media raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import by_place, table

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
N_LENGTHS, N_DISTANCES, MAX_BITS = 24, 40, 15
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: Near distances, by distance from the pixel, then column: (x to the left, y above).
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
WIDTH = 16
ROW_BYTES = 4 * WIDTH
#: Payload bytes of an image; longer ones go to several, which are decoded in step.
IMAGE_BYTES = 64 * ROW_BYTES
#: Bytes coded together.
SLICE = 1 << 22
#: Payload bytes encoded at once, and images decoded in step at most.
ENCODE, LANES = 1 << 19, 4096
#: Longest code that our encoder writes; keeps the decoder's tables small.
ENCODER_BITS = 11


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        return (int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)


class Prefix:
    """A canonical prefix code as a table over the next `bits` bits: symbols and lengths."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise ValueError("prefix code without symbols")
        if len(used) == 1:
            self.bits, self.symbol, self.length = 0, used[:1].astype(np.int32), np.zeros(1, np.int32)
        else:
            n = lengths[used]
            if np.sum(1 << (MAX_BITS - n.astype(np.int64))) != 1 << MAX_BITS:
                raise ValueError("prefix code is not complete")
            self.bits = int(n.max())
            order = np.argsort(n, kind="stable")
            spans = 1 << (self.bits - n[order].astype(np.int64))
            back = _reversed(self.bits)
            self.symbol, self.length = np.repeat(used[order], spans)[back].astype(np.int32), np.repeat(n[order], spans)[back].astype(np.int32)
        self.mask = (1 << self.bits) - 1
        self._lists: tuple[list, list] | None = None

    def read(self, b: Bits) -> int:
        if self._lists is None:
            self._lists = (self.symbol.tolist(), self.length.tolist())
        a = b.at
        w = (int.from_bytes(b.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7)) & self.mask
        b.at = a + self._lists[1][w]
        return self._lists[0][w]


_BACK: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    """Of every number of so many bits, the one with the bits in the opposite order."""
    if bits not in _BACK:
        v, r = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for _ in range(bits):
            r, v = (r << 1) | (v & 1), v >> 1
        _BACK[bits] = r
    return _BACK[bits]


_PREFIXES: dict[bytes, Prefix] = {}


def _prefix(lengths: np.ndarray) -> Prefix:
    """Codes recur within an image; the last ones are kept."""
    key = lengths.tobytes()
    if key not in _PREFIXES:
        if len(_PREFIXES) >= 64:
            _PREFIXES.clear()
        _PREFIXES[key] = Prefix(lengths)
    return _PREFIXES[key]


def read_prefix(b: Bits, size: int) -> Prefix:
    lengths = np.zeros(size, np.uint8)
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        lengths[[first, b.read(8)] if two else [first]] = 1
        return _prefix(lengths)
    own = np.zeros(19, np.uint8)
    for i in range(4 + b.read(4)):
        own[CODE_LENGTH_ORDER[i]] = b.read(3)
    code = _prefix(own)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(b)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        n = 3 + b.read(2) if s == 16 else 3 + b.read(3) if s == 17 else 11 + b.read(7)
        if at + n > size:
            raise ValueError("code lengths run over")
        lengths[at : at + n] = last if s == 16 else 0
        at += n
    return _prefix(lengths)


def _read_group(b: Bits, sizes: tuple[int, ...]) -> list[Prefix]:
    """Codes that follow each other are often alike: bits that equal those of the code before say the same for the same alphabet."""
    out: list[Prefix] = []
    last, bits, n = 0, 0, 0
    for size in sizes:
        start = b.at
        if size == last and b.read(n) == bits:
            out.append(out[-1])
            continue
        b.at = start
        out.append(read_prefix(b, size))
        last, n = size, b.at - start
        b.at = start
        bits = b.read(n)
    return out


def _value(b: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + b.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, n: int, d: int) -> None:
    if d > at or at + n > len(out):
        raise ValueError("back-reference outside the image")
    while n:  # a period of d pixels, doubled
        k = min(n, d)
        out[at : at + k] = out[at - d : at - d + k]
        at, n, d = at + k, n - k, d + k
    

def _symbols(b: Bits, group_of, groups: list[list[Prefix]], cache_bits: int, width: int, n: int, told: dict | None = None) -> np.ndarray:
    """Any stream, symbol by symbol."""
    out, at = np.zeros(n, np.uint32), 0
    cache, cached = [0] * (1 << cache_bits), 0
    shift = 32 - cache_bits

    def fill(upto: int) -> None:
        nonlocal cached
        if cache_bits:
            for v in out[cached:upto].tolist():
                cache[((v * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = v
        cached = upto

    while at < n:
        green, red, blue, alpha, dist = groups[group_of(at)]
        s = green.read(b)
        if s < 256:
            r = red.read(b)
            bl = blue.read(b)
            out[at] = alpha.read(b) << 24 | r << 16 | s << 8 | bl
            at += 1
        elif s < 256 + N_LENGTHS:
            m = _value(b, s - 256)
            _copy(out, at, m, _distance(_value(b, dist.read(b)), width))
            at += m
            if told is not None:
                told["copies"] += 1
        else:
            if not cache_bits:
                raise ValueError("no colour cache")
            fill(at)
            if told is not None:
                told["cached"] += 1
            out[at] = cache[s - 256 - N_LENGTHS]
            at += 1
    return out


def _read_codes(b: Bits, width: int, height: int, main: bool) -> tuple:
    """(bits of the colour cache, groups of codes, the group of a place)"""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache of more than 11 bits")
    group_of, n_groups = (lambda at: 0), 1
    if main and b.read(1):
        bits = b.read(3) + 2
        w = -(-width >> bits)
        index = ((read_image(b, w, -(-height >> bits), False) >> 8) & 0xFFFF).astype(int).tolist()
        n_groups = max(index) + 1
        group_of = lambda at: index[(at // width >> bits) * w + (at % width >> bits)]
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    return cache_bits, [_read_group(b, sizes) for _ in range(n_groups)], group_of


def read_image(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """A small image, symbol by symbol."""
    cache_bits, groups, group_of = _read_codes(b, width, height, main)
    return _symbols(b, group_of, groups, cache_bits, width, width * height)


def _channels(px: np.ndarray) -> np.ndarray:
    """The last axis: blue, green, red, alpha."""
    return np.ascontiguousarray(px).astype("<u4").view(np.uint8).reshape(*px.shape, 4)


def _average(a, b):
    return (a + b) >> 1


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predicted channels from the neighbours (int arrays, channels on the last axis)."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)
    if mode == 11:
        p = left + top - corner
        near = np.abs(p - left).sum(-1) < np.abs(p - top).sum(-1)
        return np.where(near[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = _average(left, top)
        return np.clip(a + np.trunc((a - corner) / 2).astype(a.dtype), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: _average(_average(left, right), top), 6: lambda: _average(left, corner),
        7: lambda: _average(left, top), 8: lambda: _average(corner, top), 9: lambda: _average(top, right), 10: lambda: _average(_average(left, corner), _average(top, right)),
    }[mode]()


def _predictions(px: np.ndarray, modes: np.ndarray, bits: int, y: int, x: int) -> np.ndarray:
    h, w, _ = px.shape
    if y == 0:
        return np.array([0, 0, 0, 255]) if x == 0 else px[0, x - 1]
    if x == 0:
        return px[y - 1, 0]
    right = px[y - 1, x + 1] if x + 1 < w else px[y, 0]
    return predict(int(modes[y >> bits, x >> bits]), px[y, x - 1], px[y - 1, x], right, px[y - 1, x - 1])


def add_predictions(res: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Inverts the predictor transform. Modes that don't look left go a row at a time."""
    h, w, _ = res.shape
    px = res.astype(np.int64)
    px[0] = np.cumsum(px[0], 0) + np.array([0, 0, 0, 255])
    px[0] &= 255
    cols = np.arange(1, w)
    for y in range(1, h):
        px[y, 0] = (px[y, 0] + px[y - 1, 0]) & 255
        row = modes[y >> bits][cols >> bits] if w > 1 else np.zeros(0, int)
        if np.isin(row, (0, 2, 3, 4, 8, 9)).all():
            right = np.concatenate([px[y - 1, 2:], px[y, :1]]) if w > 1 else px[y, :0]
            for m in np.unique(row):
                k = row == m
                p = predict(int(m), px[y, :-1], px[y - 1, 1:], right, px[y - 1, :-1])
                px[y, 1:][k] = (px[y, 1:] + p)[k] & 255
        else:
            for x in range(1, w):
                px[y, x] = (px[y, x] + _predictions(px, modes, bits, y, x)) & 255
    return px.astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def cross_colour(px: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """sign 1 inverts the transform, -1 applies it. elements: channels by block."""
    h, w, _ = px.shape
    e = elements[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    out = px.astype(np.int64)
    delta = lambda t, c: (_signed(t) * _signed(c)) >> 5
    blue, green, red = out[..., 0].copy(), out[..., 1], out[..., 2].copy()
    new = (red + sign * delta(e[..., 0], green)) & 255
    out[..., 2] = new
    out[..., 0] = (blue + sign * (delta(e[..., 1], green) + delta(e[..., 2], new if sign > 0 else red))) & 255
    return out.astype(np.uint8)


def _width_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode_vp8l(data: bytes) -> np.ndarray:
    """Pixels of one stream as uint32 (alpha, red, green, blue from the top byte), rows by columns."""
    return decode_streams([data])[0][0]


# --- encoder ---------------------------------------------------------------------------------------------------------


class Writer:
    def __init__(self) -> None:
        self.value, self.at = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= int(v) << self.at
        self.at += n

    def done(self) -> bytes:
        return self.value.to_bytes((self.at + 7) >> 3, "little")


def code_lengths(counts: np.ndarray, most: int = ENCODER_BITS) -> np.ndarray:
    """Huffman's lengths, none over `most`: counts are halved until they fit."""
    counts = np.asarray(counts, np.int64).copy()
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    while True:
        heap = [(c, i) for i, c in enumerate(counts[used].tolist())]
        heapq.heapify(heap)
        parent, k = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = k
            heapq.heappush(heap, (a[0] + b[0], k))
            k += 1
        depth = [0] * k
        for i in range(k - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= most:
            out[used] = depth[: len(used)]
            return out
        counts[used] = (counts[used] >> 1) + 1


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest."""
    lengths = np.asarray(lengths, np.int64)
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order]
        spans = 1 << (MAX_BITS - n)
        code = (np.cumsum(spans) - spans) >> (MAX_BITS - n)
        out[order] = _reversed(MAX_BITS)[code] >> (MAX_BITS - n)
    return out


#: Lengths of the code for code lengths: one code for all of them, so 4 bits for each length and 5 for the repeats.
_OWN = np.array([4] * 13 + [5] * 6, np.uint8)


def _length_tokens(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, extra bits' value, their number)"""
    out = []
    starts = np.flatnonzero(np.diff(lengths, prepend=-1))
    for v, n in zip(lengths[starts].tolist(), np.diff(starts, append=len(lengths)).tolist(), strict=True):
        if v == 0:
            while n >= 3:
                m = min(n, 138)
                out.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
                n -= m
        else:
            out.append((v, 0, 0))
            n -= 1
            while n >= 3:
                m = min(n, 6)
                out.append((16, m - 3, 2))
                n -= m
        out += [(v, 0, 0)] * n
    return out


def write_prefix(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
        used = used if len(used) else np.zeros(1, int)
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    w.put(0, 1)
    w.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(_OWN[s], 3)
    w.put(0, 1)
    own = _OWN_CODES
    for s, extra, n in _length_tokens(np.asarray(lengths, np.int64)):
        w.put(own[s] | extra << int(_OWN[s]), int(_OWN[s]) + n)


_OWN_CODES = codes_of(_OWN).astype(int).tolist()


def _prefix_of(v: int) -> tuple[int, int, int]:
    """The prefix symbol of a value of 1 or more, its extra bits and their number."""
    v -= 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def find_copies(px: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """(at, length, distance): greedy, by the last place of each four pixels. For small images and tests."""
    v, out, seen, i = px.tolist(), [], {}, 0
    while i < len(v):
        key = tuple(v[i : i + least])
        j, n = seen.get(key), 0
        if j is not None and len(key) == least:
            while i + n < len(v) and v[j + n] == v[i + n] and n < 4096:
                n += 1
        if n >= least:
            out.append((i, n, i - j))
        for k in range(i, i + max(n, 1)):
            seen[tuple(v[k : k + least])] = k
        i += max(n, 1)
    return out


def _tokens(px: np.ndarray, width: int, cache_bits: int, copies: list[tuple[int, int, int]]) -> list[tuple]:
    """("lit", r, g, b, a) / ("copy", length, distance code) / ("cache", index), with the pixel's place first."""
    out, i, cache = [], 0, {}
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    v = px.tolist()
    todo = {c[0]: c for c in copies}
    hash_ = lambda p: ((p * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(v):
        n = 1
        if i in todo:
            _, n, d = todo[i]
            out.append((i, "copy", n, near.get(d, d + len(NEAR))))
        elif cache_bits and cache.get(hash_(v[i])) == v[i]:
            out.append((i, "cache", hash_(v[i])))
        else:
            out.append((i, "lit", (v[i] >> 16) & 255, (v[i] >> 8) & 255, v[i] & 255, v[i] >> 24))
        if cache_bits:
            for p in v[i : i + n]:
                cache[hash_(p)] = p
        i += n
    return out


def write_image(w: Writer, px: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False, group_bits: int = 0) -> None:
    """Symbol by symbol, with any of the format's means."""
    flat = px.ravel()
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    group_of = lambda at: 0
    n_groups = 1
    if main:
        w.put(1 if group_bits else 0, 1)
        if group_bits:
            w.put(group_bits - 2, 3)
            gw, gh = -(-width >> group_bits), -(-(len(flat) // width) >> group_bits)
            index = np.arange(gw * gh) % 3
            n_groups = int(index.max()) + 1
            write_image(w, (index << 8).astype(np.uint32), gw, False)
            group_of = lambda at: int(index[(at // width >> group_bits) * gw + (at % width >> group_bits)])
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    tokens = _tokens(flat, width, cache_bits, find_copies(flat) if copies else [])
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(n_groups)]
    coded = []
    for t in tokens:
        if t[1] == "lit":
            use = ((0, t[3], 0, 0), (1, t[2], 0, 0), (2, t[4], 0, 0), (3, t[5], 0, 0))
        elif t[1] == "copy":
            a, b = _prefix_of(t[2]), _prefix_of(t[3])
            use = ((0, 256 + a[0], *a[1:]), (4, *b))
        else:
            use = ((0, 256 + N_LENGTHS + t[2], 0, 0),)
        g = group_of(t[0])
        coded.append((g, use))
        for c, s, _, _ in use:
            counts[g][c][s] += 1
    lengths = [[code_lengths(c, MAX_BITS) for c in g] for g in counts]
    for g in lengths:
        for n in g:
            write_prefix(w, n)
    # Of each code its fields by symbol, or None where one symbol takes no bits.
    fields = [[list(zip(codes_of(n).astype(int).tolist(), n.tolist(), strict=True)) if np.count_nonzero(n) > 1 else None for n in g] for g in lengths]
    for g, use in coded:
        own = fields[g]
        for c, s, extra, n in use:
            if own[c] is not None:
                w.put(*own[c][s])
            if n:
                w.put(extra, n)


def _riff(stream: bytes) -> bytes:
    n = len(stream)
    chunk = b"VP8L" + n.to_bytes(4, "little") + stream + b"\0" * (n & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def encode_image(
    px: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False, block_bits: int = 2, **how
) -> bytes:
    """Any uint32 image (rows by columns), with the transforms asked for. predictor: a mode, or -1 for a different one in each block.
    cross: blue, green and red bytes of the element of all blocks."""
    h, w = px.shape
    out = Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    if palette:
        colours, index = np.unique(px, return_inverse=True)
        index = index.reshape(px.shape)
        bits = _width_bits(len(colours))
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        ch = _channels(colours)
        write_image(out, np.ascontiguousarray(np.diff(ch, axis=0, prepend=np.zeros((1, 4), np.uint8))).view("<u4").ravel(), len(colours), False)
        per, n = 1 << bits, 8 >> bits
        wide = np.zeros((h, -(-w // per) * per), np.uint32)
        wide[:, :w] = index
        packed = (wide.reshape(h, -1, per) << (np.arange(per, dtype=np.uint32) * n)).sum(-1).astype(np.uint32)
        px, w = (packed << 8) | np.uint32(0xFF000000), packed.shape[1]
    ch = _channels(px).copy()
    shape = (-(-h >> block_bits), -(-w >> block_bits))
    if green:
        out.put(1, 1)
        out.put(GREEN, 2)
        ch[..., 0] -= ch[..., 1]
        ch[..., 2] -= ch[..., 1]
    if predictor is not None:
        modes = np.full(shape, predictor) if predictor >= 0 else np.arange(shape[0] * shape[1]).reshape(shape) % 14
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(block_bits - 2, 3)
        write_image(out, (modes << 8).astype(np.uint32), shape[1], False)
        src = ch.astype(np.int64)
        ch = np.array([[(src[y, x] - _predictions(src, modes, block_bits, y, x)) & 255 for x in range(w)] for y in range(h)], np.uint8).reshape(h, w, 4)
    if cross is not None:
        out.put(1, 1)
        out.put(CROSS, 2)
        out.put(block_bits - 2, 3)
        element = np.uint32(cross[0] | cross[1] << 8 | cross[2] << 16 | 0xFF << 24)
        write_image(out, np.full(shape, element), shape[1], False)
        ch = cross_colour(ch, _channels(np.full(shape, element)), block_bits, -1)
    out.put(0, 1)
    write_image(out, np.ascontiguousarray(ch).view("<u4")[..., 0], w, True, **how)
    return _riff(out.done())


# --- many images at once ---------------------------------------------------------------------------------------------
#
# Payload bytes are stored in one of two layouts, told apart by the width: grey images of `GREY` samples a row (red, green and blue are
# alike, so that the subtract-green transform leaves one channel) or images of `WIDTH` pixels a row whose red, green, blue and
# alpha are four bytes that follow each other. For each image every plan that may pay is worked out, its size estimated from the
# image's own counts of symbols (in whole sixteenths of a bit, so that it doesn't depend on what is coded beside it), and the
# least is written.


@dataclass
class Plan:
    """How some images are to be written: transforms, and the symbols of their main image."""

    name: str
    images: np.ndarray  # which of the batch
    width: np.ndarray  # of the main image, after bundling
    px: np.ndarray
    start: np.ndarray  # of each image in px, and the end
    cache_bits: int
    grey: bool
    head: list  # of each image: what goes before its main image, as (value, bits)
    cost: np.ndarray | None = None


GREY = 64
#: Most pixels of a back-reference; the least are 8 of one channel, or 2.
MOST_COPY = 128
#: Pixels coded together are fewer than 2 to this.
_PLACE_BITS = 24
CACHE = 8
_SIZE = 256 + N_LENGTHS
_XLOG = np.zeros(1, np.int64)


def _xlog(c: np.ndarray) -> np.ndarray:
    """c log2 c in sixteenths of a bit, from one table."""
    global _XLOG
    top = int(c.max(initial=0))
    if top >= len(_XLOG):
        x = np.arange(max(top + 1, 1 << 14), dtype=np.float64)
        x[0] = 1
        _XLOG = np.round(16 * x * np.log2(x)).astype(np.int64)
    return _XLOG[c]


def _bits_for(hist: np.ndarray) -> np.ndarray:
    """Estimated sixteenths of a bit of each row's symbols and of their code."""
    total = hist.sum(1)
    return _xlog(total) - _xlog(hist).sum(1) + 16 * 5 * (hist > 0).sum(1)


def _prefix_parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_prefix_of` for arrays."""
    v = v.astype(np.int64) - 1
    extra = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2, 0)
    small = v < 4
    extra = np.where(small, 0, extra)
    return np.where(small, v, 2 * extra + 2 + ((v >> extra) & 1)), v & ((1 << extra) - 1), extra


def _last_alike(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, distance, length) of the repeats of the last place in the same image that begins with the same 8 bytes."""
    px, start = plan.px, plan.start
    raw = ((px >> np.uint32(8)).astype(np.uint8) if plan.grey else px).tobytes()
    unit = 1 if plan.grey else 4  # bytes of a pixel here
    least = 8 // unit
    data = np.frombuffer(raw + b"\0" * 16, np.uint8)
    words = np.empty(len(px), np.uint64)
    for k in range(min(least, len(px))):
        w = np.frombuffer(data, "<u8", (len(px) - k + least - 1) // least, k * unit)
        words[k::least] = w
    # Sorted by hash, then place; hashes depend on the pixels alone.
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = words * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key &= ~low
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    same = np.flatnonzero((key[1:] ^ key[:-1]) <= low)
    at, before = (key[same + 1] & low).astype(np.int64), (key[same] & low).astype(np.int64)
    del key
    by = np.argsort(at)
    at, before = at[by], before[by]
    of = np.searchsorted(start, at, side="right") - 1
    room = np.minimum(start[of + 1] - at, MOST_COPY)
    use = (before >= start[of]) & (room >= least)
    use &= words[at] == words[before]
    at, before, room = at[use], before[use], room[use]
    length = np.full(len(at), least, np.int64)
    todo = np.flatnonzero(room >= 2 * least)
    while len(todo):
        k = length[todo]
        differ = words[at[todo] + k] ^ words[before[todo] + k]
        length[todo[differ == 0]] += least
        todo = todo[differ == 0]
        todo = todo[length[todo] + least <= room[todo]]
    rest = np.flatnonzero(length < room)  # what is left of less than 8 bytes
    a, b = at[rest], before[rest]
    for _ in range(least - 1):
        k = length[rest]
        go = (k < room[rest]) & (px[np.minimum(a + k, len(px) - 1)] == px[b + k])
        rest, a, b = rest[go], a[go], b[go]
        length[rest] += 1
    return at, at - before, length


def _near_codes(width: int) -> np.ndarray:
    """Distance codes of short distances; 0: none of its own."""
    out = np.zeros(8 * width + 16, np.int64)
    for k in range(len(NEAR) - 1, -1, -1):
        out[max(1, NEAR[k][0] + NEAR[k][1] * width)] = k + 1
    return out


_NEAR_CODES: dict[int, np.ndarray] = {}


@dataclass
class Tokens:
    image: np.ndarray
    symbol: np.ndarray  # under the green code
    place: np.ndarray
    literal: np.ndarray
    copy: np.ndarray  # tokens that are copies
    extra: tuple[np.ndarray, np.ndarray]  # value and bits, of copies
    distance: tuple[np.ndarray, np.ndarray, np.ndarray]  # symbol, extra value and bits, of copies


def _tokens_of(plan: Plan) -> Tokens:
    px, start, n = plan.px, plan.start, len(plan.px)
    of = np.repeat(np.arange(len(start) - 1), np.diff(start))
    at, dist, length = _last_alike(plan)
    took, stop = [], 0
    for k, (p, m) in enumerate(zip(at.tolist(), length.tolist(), strict=True)):  # greedy
        if p >= stop:
            took.append(k)
            stop = p + m
    at, dist, length = at[took], dist[took], length[took]
    inside = np.zeros(n + 1, np.int8)
    inside[at] += 1
    inside[at + length] -= 1
    token = np.cumsum(inside[:n], dtype=np.int8) == 0
    token[at] = True
    place = np.flatnonzero(token)
    copy = np.searchsorted(place, at)
    symbol = ((px[place] >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    literal = np.ones(len(place), bool)
    literal[copy] = False
    if plan.cache_bits:
        slot = ((px.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - plan.cache_bits)
        order = np.argsort((of.astype(np.uint64) << np.uint64(plan.cache_bits)) | slot, kind="stable")
        key = (of[order] << plan.cache_bits) | slot[order].astype(np.int64)
        hit = np.zeros(n, bool)
        hit[order[1:][(key[1:] == key[:-1]) & (px[order[1:]] == px[order[:-1]])]] = True
        cached = literal & hit[place]
        symbol[cached] = _SIZE + slot[place[cached]].astype(np.int64)
        literal &= ~cached
    a, b, c = _prefix_parts(length)
    symbol[copy] = 256 + a
    code = dist + len(NEAR)
    for w in np.unique(plan.width).tolist():
        near = _NEAR_CODES.setdefault(w, _near_codes(w))
        own = np.flatnonzero((plan.width[of[at]] == w) & (dist < len(near)))
        code[own] = np.where(near[dist[own]] > 0, near[dist[own]], code[own])
    return Tokens(of[place], symbol, place, literal, copy, (b, c), _prefix_parts(code))


def _histograms(plan: Plan, t: Tokens) -> list[np.ndarray]:
    """Green, red, blue, alpha and distance symbols of each image."""
    n, size = len(plan.images), _SIZE + (1 << plan.cache_bits if plan.cache_bits else 0)
    count = lambda image, s, m: np.bincount(image * m + s, minlength=n * m).reshape(n, m)
    out = [count(t.image, t.symbol, size)]
    v, image = plan.px[t.place[t.literal]], t.image[t.literal]
    for shift in (16, 0, 24):
        s = ((v >> np.uint32(shift)) & np.uint32(255)).astype(np.int64)
        out.append(count(image, s, 256))
    out.append(count(t.image[t.copy], t.distance[0], N_DISTANCES))
    return out


def _estimate(plan: Plan, t: Tokens, hist: list[np.ndarray]) -> np.ndarray:
    bits = sum(_bits_for(h) for h in hist) + np.array([16 * sum(k for _, k in h) for h in plan.head], np.int64)
    return bits + 16 * np.bincount(t.image[t.copy], weights=t.extra[1] + t.distance[2], minlength=len(plan.images)).astype(np.int64)


def _fields(w: Writer) -> list[tuple[int, int]]:
    """(value, bits) in parts of 32 bits at most."""
    return [((w.value >> k) & 0xFFFFFFFF, min(32, w.at - k)) for k in range(0, w.at, 32)]


def _by_image(image: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(image * 256 + v, minlength=n * 256).reshape(n, 256)


def _header(width: int, height: int) -> Writer:
    w = Writer()
    for v, k in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, k)
    return w


def _palette_head(w: Writer, colours: np.ndarray) -> None:
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(colours) - 1, 8)
    ch = _channels(colours)
    write_image(w, np.ascontiguousarray(np.diff(ch, axis=0, prepend=np.zeros((1, 4), np.uint8))).view("<u4").ravel(), len(colours), False)


def _bundled(index: np.ndarray, width: int, n_colours: int) -> tuple[np.ndarray, int]:
    """Rows of colour numbers as pixels, several in one where there are few colours, and how many a row has."""
    bits = _width_bits(n_colours)
    per, n = 1 << bits, 8 >> bits
    rows = index.reshape(-1, width)
    wide = np.zeros((len(rows), -(-width // per) * per), np.uint32)
    wide[:, :width] = rows
    packed = (wide.reshape(len(rows), -1, per) << (np.arange(per, dtype=np.uint32) * n)).sum(-1).astype(np.uint32)
    return ((packed << np.uint32(8)) | np.uint32(0xFF000000)).ravel(), packed.shape[1]


def _as_pixels(data: np.ndarray) -> np.ndarray:
    """Four bytes are a pixel's red, green, blue and alpha."""
    q = data.reshape(-1, 4).astype(np.uint32)
    return q[:, 3] << np.uint32(24) | q[:, 0] << np.uint32(16) | q[:, 1] << np.uint32(8) | q[:, 2]


def _plan(name: str, parts: list[tuple[int, int, np.ndarray, Writer]], cache_bits: int, grey: bool) -> Plan:
    """parts: image, width, pixels, head."""
    return Plan(
        name, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64), np.concatenate([p[2] for p in parts]),
        np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])]).astype(np.int64), cache_bits, grey, [_fields(p[3]) for p in parts],
    )


#: Predictor modes that are tried, each for a whole image.
MODES = (1, 2, 11, 12)


def _entropy(b: np.ndarray) -> int:
    c = np.bincount(b, minlength=256)
    return int(_xlog(np.array([len(b)]))[0] - _xlog(c).sum())


def _predicted(ch: np.ndarray, mode: int) -> np.ndarray:
    """Residuals of the predictor transform with one mode (not one that looks to the top right)."""
    src = ch.astype(np.int64)
    p = np.empty_like(src)
    p[0, 0] = (0, 0, 0, 255)
    p[0, 1:], p[1:, 0] = src[0, :-1], src[:-1, 0]
    p[1:, 1:] = predict(mode, src[1:, :-1], src[:-1, 1:], src[:-1, 1:], src[:-1, :-1])
    return ((src - p) & 255).astype(np.uint8)


def _decorrelated(w: Writer, px: np.ndarray, width: int) -> np.ndarray | None:
    """Predictor, and cross-colour or subtract-green behind it, as far as they lower the entropy of the image's bytes; their heads go to
    `w`. None if the predictor doesn't."""
    ch = _channels(px.reshape(-1, width))
    h = len(ch)
    best, mode = _entropy(ch.ravel()), None
    for m in MODES:
        e = _entropy(_predicted(ch, m).ravel())
        if e < best:
            best, mode = e, m
    if mode is None:
        return None
    out = _predicted(ch, mode)
    shape = (-(-h >> 9), -(-width >> 9))
    w.put(1, 1)
    w.put(PREDICTOR, 2)
    w.put(7, 3)
    write_image(w, np.full(shape[0] * shape[1], mode << 8, np.uint32), shape[1], False)
    split = lambda c: sum(_entropy(c[..., k].ravel()) for k in range(3))
    green, plain = _signed(out[..., 1]), split(out)
    slope = lambda c: int(np.clip(round(32 * float((_signed(c) * green).sum()) / max(1.0, float((green * green).sum()))), -128, 127)) & 255
    element = np.uint32(slope(out[..., 2]) | slope(out[..., 0]) << 8 | 0xFF << 24)
    crossed = cross_colour(out, _channels(np.full(shape, element)), 9, -1)
    less = out.copy()
    less[..., 0] -= out[..., 1]
    less[..., 2] -= out[..., 1]
    if split(crossed) + 16 * 60 < min(plain, split(less)):
        w.put(1, 1)
        w.put(CROSS, 2)
        w.put(7, 3)
        write_image(w, np.full(shape[0] * shape[1], element, np.uint32), shape[1], False)
        out = crossed
    elif split(less) < plain:
        w.put(1, 1)
        w.put(GREEN, 2)
        out = less
    return np.ascontiguousarray(out).view("<u4").ravel()


def _plans(payloads: list[bytes]) -> list[Plan]:
    n = len(payloads)
    every = np.frombuffer(b"".join(payloads), np.uint8)
    size = np.array([len(p) for p in payloads], np.int64)
    first = np.cumsum(size) - size
    image = np.repeat(np.arange(n), size)
    hist = _by_image(image, every, n)
    px = _as_pixels(every)
    order = np.sort((image[::4].astype(np.uint64) << np.uint64(32)) | px)
    fresh = np.concatenate([[True], order[1:] != order[:-1]])
    distinct = np.bincount((order[fresh] >> np.uint64(32)).astype(np.int64), minlength=n)
    # Like their left or upper neighbours?
    entropy = lambda h: _xlog(h.sum(1)) - _xlog(h).sum(1)
    alike = np.zeros(n, bool)
    for k in (4, ROW_BYTES):
        inside = image[k:] == image[:-k]
        alike |= entropy(_by_image(image[k:][inside], (every[k:] - every[:-k])[inside], n)) < entropy(hist)
    green = []
    for h in (size // ROW_BYTES).tolist():
        w = _header(GREY, h)
        w.put(1, 1)
        w.put(GREEN, 2)
        w.put(0, 1)
        green.append(_fields(w))
    out = [Plan("grey", np.arange(n), np.full(n, GREY), (every.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), np.append(first, len(every)), 0, True, green)]
    few: list[tuple] = []
    colour: list[tuple] = []
    palette: list[tuple] = []
    smooth: list[tuple] = []
    kinds = (hist > 0).sum(1)
    for i in np.flatnonzero((kinds <= 16) | (2 * distinct <= size // 4) | alike).tolist():
        b = every[first[i] : first[i] + size[i]]
        own = px[first[i] // 4 : (first[i] + size[i]) // 4]
        h = len(b) // ROW_BYTES
        if kinds[i] <= 16:
            values = np.flatnonzero(hist[i])
            w = _header(GREY, h)
            _palette_head(w, (values.astype(np.uint32) * np.uint32(0x010101)) | np.uint32(0xFF000000))
            w.put(0, 1)
            packed, width = _bundled(np.searchsorted(values, b).astype(np.uint32), GREY, len(values))
            few.append((i, width, packed, w))
        if 2 * distinct[i] <= len(own):  # a cache, a palette or four bytes at once need pixels that recur
            w = _header(WIDTH, h)
            w.put(0, 1)
            colour.append((i, WIDTH, own, w))
            if distinct[i] <= 256:
                colours, index = np.unique(own, return_inverse=True)
                w = _header(WIDTH, h)
                _palette_head(w, colours)
                w.put(0, 1)
                packed, width = _bundled(index.astype(np.uint32), WIDTH, len(colours))
                palette.append((i, width, packed, w))
        if alike[i]:
            w = _header(WIDTH, h)
            left = _decorrelated(w, own, WIDTH)
            if left is not None:
                w.put(0, 1)
                smooth.append((i, WIDTH, left, w))
    tried = (("few", few, 0, True), ("colour", colour, 0, False), ("cache", colour, CACHE, False), ("palette", palette, 0, True), ("smooth", smooth, 0, False))
    return out + [_plan(name, parts, bits, flat) for name, parts, bits, flat in tried if parts]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Images (bytes: a multiple of `ROW_BYTES`, at least one row and `IMAGE_BYTES` at most), each as the WebP file that is estimated to be the
    smallest."""
    if not payloads:
        return []
    work = []
    for p in _plans(payloads):
        t = _tokens_of(p)
        hist = _histograms(p, t)
        p.cost = _estimate(p, t, hist)
        work.append((p, t, hist))
    best, which = np.full(len(payloads), np.iinfo(np.int64).max), np.zeros(len(payloads), np.int64)
    for k, (p, _, _) in enumerate(work):
        better = p.cost < best[p.images]
        best[p.images[better]], which[p.images[better]] = p.cost[better], k
    out: list[bytes] = [b""] * len(payloads)
    for k, (p, t, hist) in enumerate(work):
        chosen = np.flatnonzero(which[p.images] == k)
        if len(chosen):
            _write(p, t, hist, chosen, out)
    return out


#: Codes of the query's encoder have so many bits at most.
_MOST = 11


def lengths_of(hist: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code for each row's counts (0 in rows of less than two symbols). Every symbol first gets
    the bits that its share calls for, rounded up; what room that leaves goes to those that gain most."""
    every = np.zeros(hist.shape, np.int64)
    some = np.flatnonzero(hist.any(0))
    hist = hist[:, some]
    used = hist > 0
    several = used.sum(1) > 1
    c = np.where(used & several[:, None], hist + hist.sum(1)[:, None] // 1024 + 1, 0).astype(np.int64)
    total = c.sum(1)[:, None]
    asked = -(-total // np.maximum(c, 1))
    out = np.where(c > 0, np.maximum(np.frexp((asked - 1).astype(np.float64))[1], 1), 0).astype(np.int64)
    room = (1 << _MOST) - np.where(c > 0, 1 << (_MOST - out), 0).sum(1)
    room[~several] = 0
    order = np.argsort(-(c << out), axis=1, kind="stable")
    rows, most = np.arange(len(hist)), int(used.sum(1).max(initial=0))
    while room.any():
        for r in range(most):
            at = order[:, r]
            n = out[rows, at]
            cost = 1 << (_MOST - np.minimum(n, _MOST))
            fits = (n > 1) & (cost <= room)
            out[rows[fits], at[fits]] -= 1
            room -= np.where(fits, cost, 0)
    every[:, some] = out
    return every


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of each row, first bit lowest."""
    out = np.zeros(lengths.shape, np.uint64)
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    order = np.argsort(row * 16 + n, kind="stable")
    row, symbol, n = row[order], symbol[order], n[order]
    spans = 1 << (MAX_BITS - n)
    run = np.cumsum(spans) - spans
    code = (run - run[np.searchsorted(row, row)]) >> (MAX_BITS - n)
    out[row, symbol] = _reversed(MAX_BITS)[code] >> (MAX_BITS - n)
    return out


def _length_fields(lengths: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bits) of how each row's code is written."""
    n, size = lengths.shape
    several = (hist > 0).sum(1) > 1
    row, value, bits, rank = [], [], [], []

    def add(r, v, k, at) -> None:
        row.append(r)
        value.append(np.broadcast_to(v, len(r)))
        bits.append(np.broadcast_to(k, len(r)))
        rank.append(np.broadcast_to(at, len(r)))

    one = np.flatnonzero(~several)
    add(one, 0b101 | (hist[one] > 0).argmax(1) << 3, 11, 0)  # a simple code of one symbol (of 0, if there is none)
    many = np.flatnonzero(several)
    w = Writer()
    w.put(0, 1)
    w.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(_OWN[s], 3)
    w.put(0, 1)
    for v, k in _fields(w):
        add(many, v, k, -1)
    own = np.array(_OWN_CODES)
    rows, symbols = np.nonzero(lengths)
    add(rows, own[lengths[rows, symbols]], 4, symbols)
    # Runs of zeros.
    zero = np.pad(lengths[many] == 0, ((0, 0), (1, 1)))
    step = np.diff(zero.astype(np.int8), axis=1)
    r, a = np.nonzero(step == 1)
    z = np.nonzero(step == -1)[1]
    r, left = many[r], z - a
    while len(r):
        long, some = left >= 11, (left >= 3) & (left < 11)
        m = np.where(long, np.minimum(left, 138), np.where(some, left, 1))
        v = np.where(long, own[18] | (m - 11) << 5, np.where(some, own[17] | (m - 3) << 5, own[0]))
        add(r, v, np.where(long, 12, np.where(some, 8, 4)), a)
        a, left = a + m, left - m
        r, a, left = r[left > 0], a[left > 0], left[left > 0]
    row, value, bits, rank = (np.concatenate(x) for x in (row, value, bits, rank))
    order = np.argsort(row * (size + 2) + rank, kind="stable")
    return row[order], value[order].astype(np.uint64), bits[order].astype(np.uint64)


def _write(plan: Plan, t: Tokens, hist: list[np.ndarray], chosen: np.ndarray, out: list[bytes]) -> None:
    m = len(chosen)
    number = np.full(len(plan.images), -1, np.int64)
    number[chosen] = np.arange(m)
    hist = [h[chosen] for h in hist]
    sizes = [lengths_of(h) for h in hist]
    codes = [_canonical(n) for n in sizes]
    u = lambda x: x.astype(np.uint64)
    heads = [[*plan.head[i], *([(1 | plan.cache_bits << 1, 6)] if plan.cache_bits else [(0, 2)])] for i in chosen.tolist()]  # one group of codes
    sections = [(np.repeat(np.arange(m), [len(h) for h in heads]), u(np.array([v for h in heads for v, _ in h], np.int64)), u(np.array([k for h in heads for _, k in h], np.int64)))]
    sections += [_length_fields(n, h) for n, h in zip(sizes, hist, strict=True)]
    both = [(c.astype(np.uint32) | n.astype(np.uint32) << np.uint32(16)).ravel() for c, n in zip(codes, sizes, strict=True)]
    number_of = number[t.image]
    mine = slice(None) if m == len(plan.images) else np.flatnonzero(number_of >= 0)
    image, place, literal = number_of[mine], t.place[mine], t.literal[mine]
    e = both[0][image * sizes[0].shape[1] + t.symbol[mine]]
    whole, bits = u(e & np.uint32(0xFFFF)), u(e >> np.uint32(16))

    def add(at: np.ndarray, k: int, of: np.ndarray, s: np.ndarray) -> None:
        e = both[k][of * sizes[k].shape[1] + s]
        whole[at] |= u(e & np.uint32(0xFFFF)) << bits[at]
        bits[at] += e >> np.uint32(16)

    if any(n.any() for n in sizes[1:4]):
        lit = np.flatnonzero(literal)
        v = plan.px[place[lit]]
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            add(lit, k, image[lit], ((v >> np.uint32(shift)) & np.uint32(255)).astype(np.int64))
    own = np.flatnonzero(number_of[t.copy] >= 0)
    cp = t.copy[own] if m == len(plan.images) else np.searchsorted(mine, t.copy[own])
    whole[cp] |= u(t.extra[0][own]) << bits[cp]
    bits[cp] += u(t.extra[1][own])
    add(cp, 4, image[cp], t.distance[0][own])
    whole[cp] |= u(t.distance[1][own]) << bits[cp]
    bits[cp] += u(t.distance[2][own])
    sections.append((image, whole, bits))
    # Each image begins at a word of 64 bits, and each section where the one before ends.
    long = [np.bincount(r, weights=b, minlength=m).astype(np.int64) for r, _, b in sections]
    total = np.sum(long, 0)
    words = (total + 63) // 64 + 1
    base = (np.cumsum(words) - words) * 64
    stream = np.zeros(int(words.sum()) + 1, np.uint64)
    begin = base.copy()
    for (r, v, b), n in zip(sections, long, strict=True):
        if len(r):
            run = np.cumsum(b.astype(np.int64)) - b.astype(np.int64)
            at = run - run[np.searchsorted(r, np.arange(m)).clip(max=len(r) - 1)][r] + begin[r]
            word, shift = at >> 6, u(at & 63)
            start = np.flatnonzero(np.diff(word, prepend=-1))
            stream[word[start]] |= np.bitwise_or.reduceat(v << shift, start)
            stream[word[start] + 1] |= np.bitwise_or.reduceat((v >> np.uint64(1)) >> (np.uint64(63) - shift), start)
        begin += n
    data = stream.astype("<u8").tobytes()
    for r, i in enumerate(chosen.tolist()):
        a = int(base[r]) // 8
        out[int(plan.images[i])] = _riff(data[a : a + (int(total[r]) + 7) // 8])


# Decoding. The codes and transforms of each image are read one by one; the main images then go in step, a symbol of each at a time.


@dataclass
class Stream:
    """A VP8L image as far as the codes of its main image."""

    width: int
    height: int
    wide: int  # pixels of a row of the main image
    transforms: list
    bits: Bits
    cache_bits: int
    several: bool  # groups of codes
    told: dict


def open_stream(data: bytes) -> Stream:
    b = Bits(data)
    if b.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    todo, w = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (x[0] for x in todo):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS):
            bits = b.read(3) + 2
            shape = (-(-height >> bits), -(-w >> bits))
            todo.append((kind, w, bits, read_image(b, shape[1], shape[0], False).reshape(shape)))
        elif kind == PALETTE:
            n = b.read(8) + 1
            colours = np.cumsum(_channels(read_image(b, n, 1, False)), 0, dtype=np.uint8)
            todo.append((kind, w, _width_bits(n), colours))
            w = -(-w >> _width_bits(n))
        else:
            todo.append((kind, w, 0, None))
    at = b.at
    cache_bits = b.read(4) if b.read(1) else 0
    several = bool(b.read(1))
    if several:
        b.at = at  # goes symbol by symbol, from there
    elif cache_bits > 11:
        raise ValueError("colour cache of more than 11 bits")
    return Stream(width, height, w, todo, b, cache_bits, several, {"transforms": [x[0] for x in todo], "copies": 0, "cached": 0})


def _inverted(s: Stream, px: np.ndarray) -> np.ndarray:
    """The image from its main image, transforms inverted in the opposite order."""
    px = px.reshape(s.height, s.wide)
    for kind, w, bits, extra in reversed(s.transforms):
        if kind == PALETTE:
            n, per = 8 >> bits, 1 << bits
            index = (px >> 8) & 255
            index = ((index[:, :, None] >> (np.arange(per, dtype=np.uint32) * n)) & ((1 << n) - 1)).reshape(s.height, -1)[:, :w]
            table_ = np.zeros((256, 4), np.uint8)
            table_[: len(extra)] = extra
            px = table_[index].view("<u4")[..., 0]
            continue
        if kind == GREEN:
            g = (px >> np.uint32(8)) & np.uint32(255)
            px = (px & np.uint32(0xFF00FF00)) | ((px & np.uint32(0x00FF00FF)) + (g << np.uint32(16) | g)) & np.uint32(0x00FF00FF)
            continue
        ch = _channels(px)
        ch = add_predictions(ch, (extra >> 8) & 255, bits) if kind == PREDICTOR else cross_colour(ch, _channels(extra), bits, 1)
        px = np.ascontiguousarray(ch).view("<u4")[..., 0]
    return px


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Of each row's code, for the next bits: symbol and length in one number; and how many bits that are."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol].astype(np.int64)
    count = np.bincount(row, minlength=len(lengths))
    if (count == 0).any():
        raise ValueError("prefix code without symbols")
    n[count[row] == 1] = 0  # takes no bits
    bits = int(n.max(initial=0))
    spans = 1 << (bits - n)
    if (np.bincount(row, weights=spans, minlength=len(lengths)) != 1 << bits).any():
        raise ValueError("prefix code is not complete")
    order = np.argsort((row * 16 + n).astype(np.int32), kind="stable")
    full = np.repeat((symbol[order] << 4 | n[order]).astype(np.int32), spans[order]).reshape(len(lengths), 1 << bits)
    return np.ascontiguousarray(full[:, _reversed(bits)]).ravel(), bits


class _Lanes:
    """Bits of images that are decoded in step."""

    def __init__(self, streams: list[Stream]):
        at, starts, ends = 0, [], []
        for s in streams:
            starts.append(8 * at + s.bits.at)
            at += len(s.bits.data)
            ends.append(8 * at)
        raw = np.frombuffer(b"".join(s.bits.data for s in streams) + b"\0" * 64, np.uint8)
        self.words = np.empty(len(raw) - 8, np.uint64)
        for k in range(8):
            w = raw[k : k + (len(raw) - k) // 8 * 8].view("<u8")
            self.words[k::8] = w[: len(self.words[k::8])]
        self.last = len(self.words) - 1
        self.pos, self.end = np.array(starts, np.int64), np.array(ends, np.int64)
        size = np.array([_SIZE + (1 << s.cache_bits if s.cache_bits else 0) for s in streams], np.int64)
        self.table: list[np.ndarray] = []
        self.bits: list[int] = []
        for k in range(5):
            t, n = _tables(self._lengths(size if k == 0 else np.full(len(streams), 256 if k < 4 else N_DISTANCES)))
            self.table.append(t)
            self.bits.append(n)

    def window(self, pos: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(pos >> 3, self.last)] >> (pos & 7).astype(np.uint64)

    def _lengths(self, size: np.ndarray) -> np.ndarray:
        """Reads one code of each image: the lengths of its symbols."""
        out = np.zeros((len(size), int(size.max())), np.int32)
        w = self.window(self.pos).astype(np.int64)
        simple = (w & 1) == 1
        lane = np.flatnonzero(simple)
        v = w[lane]
        wide = (v >> 2) & 1
        p = 4 + 7 * wide
        first, two = (v >> 3) & np.where(wide == 1, 255, 1), ((v >> 1) & 1) == 1
        out[lane[two], ((v >> p) & 255)[two]] = 1
        out[lane, first] = 1
        self.pos[lane] += p + 8 * two
        lane = np.flatnonzero(~simple)
        if not len(lane):
            return out
        n = 4 + ((w[lane] >> 1) & 15)
        pos = self.pos[lane] + 5
        own = np.zeros((len(lane), 19), np.int32)
        for i in range(int(n.max())):
            k = np.flatnonzero(i < n)
            own[k, CODE_LENGTH_ORDER[i]] = (self.window(pos[k]) & np.uint64(7)).astype(np.int32)
            pos[k] += 3
        table, bits = _tables(own)
        mask = np.uint64((1 << bits) - 1)
        w = self.window(pos).astype(np.int64)
        some = (w & 1) == 1
        m = 2 + 2 * ((w >> 1) & 7)
        left = np.where(some, 2 + ((w >> 4) & ((1 << m) - 1)), size[lane])
        pos += np.where(some, 4 + m, 1)
        at, last = np.zeros(len(lane), np.int64), np.full(len(lane), 8, np.int64)
        full = size[lane]
        k = np.arange(len(lane))  # those that go on
        while len(k):
            w = self.window(pos[k])
            e = table[(k << bits) + (w & mask).astype(np.int64)]
            s, step = e >> 4, (e & 15).astype(np.int64)
            count = np.ones(len(k), np.int64)
            value = s.astype(np.int64)
            far = np.flatnonzero(s >= 16)
            if len(far):
                f = s[far] - 16
                more = (w[far] >> step[far].astype(np.uint64)).astype(np.int64)
                extra = _REPEAT_BITS[f]
                count[far] = _REPEAT_LEAST[f] + (more & ((1 << extra) - 1))
                value[far] = np.where(f == 0, last[k[far]], 0)
                step[far] += extra
            near = np.flatnonzero((s < 16) & (s > 0))
            last[k[near]] = s[near]
            if (at[k] + count > full[k]).any():
                raise ValueError("code lengths run over")
            set_ = np.flatnonzero(value > 0)
            c = count[set_]
            place = np.repeat(at[k[set_]] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
            out[np.repeat(lane[k[set_]], c), place] = np.repeat(value[set_], c)
            at[k] += count
            pos[k] += step
            left[k] -= 1
            k = k[(at[k] < full[k]) & (left[k] > 0)]
        self.pos[lane] = pos
        return out

    def entry(self, k: int, lane: np.ndarray, window: np.ndarray) -> np.ndarray:
        return self.table[k][(lane << self.bits[k]) + (window & np.uint64((1 << self.bits[k]) - 1)).astype(np.int64)]

    def value(self, prefix: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of prefix symbols, and where their extra bits end."""
        more = (self.window(pos) & _EXTRA_MASK[prefix]).astype(np.int64)
        return _FIRST[prefix] + more, pos + _EXTRA[prefix]

    def copy(self, lane: np.ndarray, symbol: np.ndarray, pos: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, distance, where the next symbol begins) of copies whose first symbol ends at pos."""
        length, pos = self.value(symbol - 256, pos)
        e = self.entry(4, lane, self.window(pos))
        code, pos = self.value(e >> 4, pos + (e & 15))
        near = code <= len(NEAR)
        k = np.where(near, code, 1) - 1
        return length, np.where(near, np.maximum(1, _NEAR_X[k] + _NEAR_Y[k] * width), code - len(NEAR)), pos


#: Of the symbols 16 to 18 of a code of code lengths: extra bits, and the least number of repeats.
_REPEAT_BITS, _REPEAT_LEAST = np.array([2, 3, 7]), np.array([3, 3, 11])
# Of each prefix symbol: extra bits, their mask, and the least value.
_EXTRA = np.array([0 if v < 4 else (v - 2) >> 1 for v in range(N_DISTANCES)])
_EXTRA_MASK = (np.uint64(1) << _EXTRA.astype(np.uint64)) - np.uint64(1)
_FIRST = np.array([v + 1 if v < 4 else ((2 + (v & 1)) << ((v - 2) >> 1)) + 1 for v in range(N_DISTANCES)])
_NEAR_X, _NEAR_Y = np.array([p[0] for p in NEAR]), np.array([p[1] for p in NEAR])


def _in_step(streams: list[Stream]) -> list[np.ndarray]:
    """Main images of streams with one group of codes, all with or all without a colour cache."""
    L = _Lanes(streams)
    size = np.array([s.wide * s.height for s in streams], np.int64)
    first = np.cumsum(size) - size
    width = np.array([s.wide for s in streams], np.int64)
    out = np.zeros(int(size.sum()), np.uint32)
    cached = streams[0].cache_bits > 0
    n_copies, n_cached = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    lane = np.arange(len(streams))
    pos, at, stop = L.pos.copy(), first.copy(), first + size
    # Red, blue and alpha that take no bits.
    plain = None if any(L.bits[1:4]) else [(t >> 4).astype(np.uint32) for t in L.table[1:4]]
    base = None if plain is None else plain[2] << np.uint32(24) | plain[0] << np.uint32(16) | plain[1]
    copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if cached:
        bits = np.array([s.cache_bits for s in streams], np.int64)
        cache_at = np.cumsum(1 << bits) - (1 << bits)
        cache = np.zeros(int((1 << bits).sum()), np.uint32)
        left, back = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
        shift = (32 - bits).astype(np.uint64)
    gbits, gmask, gtable = L.bits[0], np.uint64((1 << L.bits[0]) - 1), L.table[0]
    while len(lane):
        if cached:
            go = np.flatnonzero(left == 0)
            own, p = lane[go], pos[go]
        else:
            go, own, p = slice(None), lane, pos
        e = gtable[(own << gbits) + (L.window(p) & gmask).astype(np.int64)]
        p = p + (e & 15)
        s = e >> 4
        high = np.flatnonzero(s >= 256)
        to = at[go]
        px = s.astype(np.uint32) << np.uint32(8)
        if base is not None:
            px |= base[own]
        elif len(high) < len(s):
            q = p.copy()
            for k, place in ((1, 16), (2, 0), (3, 24)):
                e = L.entry(k, own, L.window(q))
                px |= (e >> 4).astype(np.uint32) << np.uint32(place)
                q += e & 15
            p = np.where(s < 256, q, p)
        step = 1
        if len(high):
            is_copy = s[high] < 256 + N_LENGTHS
            h = high[is_copy]
            if len(h):
                length, dist, end = L.copy(own[h], s[h], p[h], width[own[h]])
                if (dist > to[h] - first[own[h]]).any() or (to[h] + length > stop[go][h]).any():
                    raise ValueError("back-reference outside the image")
                p[h] = end
                n_copies[own[h]] += 1
                if cached:
                    g = go[h]
                    left[g], back[g] = length, dist
                else:
                    copies.append((to[h], length, dist))
                    step = np.ones(len(s), np.int64)
                    step[h] = length
            c = high[~is_copy]
            if len(c):
                if not cached:
                    raise ValueError("no colour cache")
                px[c] = cache[cache_at[own[c]] + s[c] - _SIZE]
                n_cached[own[c]] += 1
        if cached:
            pos[go] = p
            copying = np.flatnonzero(left)
            value = np.empty(len(lane), np.uint32)
            value[go] = px
            value[copying] = out[at[copying] - back[copying]]
            left[copying] -= 1
            out[at] = value
            slot = ((value.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> shift[lane]
            cache[cache_at[lane] + slot.astype(np.int64)] = value
            at = at + 1
        else:
            pos = p
            out[to] = px
            at = at + step
        done = at >= stop
        if done.any():
            if (pos[done] > L.end[lane[done]]).any():
                raise ValueError("the stream ends early")
            go_on = ~done
            lane, pos, at, stop = lane[go_on], pos[go_on], at[go_on], stop[go_on]
            if cached:
                left, back = left[go_on], back[go_on]
    if copies:
        # Every copied pixel points to the one it repeats; pointers are shortened until they end at literals.
        start, length, dist = (np.concatenate(x) for x in zip(*copies, strict=True))
        source = np.arange(len(out))
        place = np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        source[place] = place - np.repeat(dist, length)
        while True:
            now = source[source[place]]
            if (now == source[place]).all():
                break
            source[place] = now
        out[place] = out[source[place]]
    for s, c, k in zip(streams, n_copies.tolist(), n_cached.tolist(), strict=True):
        s.told["copies"], s.told["cached"] = c, k
    return np.split(out, first[1:])


def decode_streams(data: list[bytes]) -> list[tuple[np.ndarray, dict]]:
    """Pixels of VP8L streams, and what was met in them: transforms, copies and colour cache hits. Damaged ones raise ValueError as far as they
    can be told."""
    try:
        return _decoded(data)
    except IndexError as e:
        raise ValueError("damaged stream") from e


def _decoded(data: list[bytes]) -> list[tuple[np.ndarray, dict]]:
    streams = [open_stream(d) for d in data]
    main: list[np.ndarray | None] = [None] * len(streams)
    sets: dict[tuple, list[int]] = {}
    for i, s in enumerate(streams):
        if s.several:
            cache_bits, groups, group_of = _read_codes(s.bits, s.wide, s.height, True)
            main[i] = _symbols(s.bits, group_of, groups, cache_bits, s.wide, s.wide * s.height, s.told)
            if s.bits.at > 8 * len(s.bits.data):
                raise ValueError("the stream ends early")
        else:
            one = any(t[0] in (GREEN, PALETTE) for t in s.transforms)  # often with one channel left
            sets.setdefault((s.cache_bits, one), []).append(i)
    for own in sets.values():
        own.sort(key=lambda i: -streams[i].wide * streams[i].height)
        for at in range(0, len(own), LANES):
            some = own[at : at + LANES]
            for i, px in zip(some, _in_step([streams[i] for i in some]), strict=True):
                main[i] = px
    return [(_inverted(s, px), s.told) for s, px in zip(streams, main, strict=True)]


def chunks_of(media: bytes) -> Iterator[bytes]:
    """VP8L streams of one or more RIFF files that follow each other."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("no WebP file")
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        k = at + 12
        while k < end:
            n = int.from_bytes(media[k + 4 : k + 8], "little")
            if media[k : k + 4] == b"VP8L":
                yield media[k + 8 : k + 8 + n]
            k += 8 + n + (n & 1)
        at = end


def images(media: bytes) -> Iterator[np.ndarray]:
    """The images of one or more RIFF files that follow each other, as uint32 (alpha, red, green, blue from the top byte), rows by columns."""
    yield from (px for px, _ in decode_streams(list(chunks_of(media))))


def encode_columns(values: list[bytes]) -> list[bytes]:
    """Bytes, padded to whole rows, as images one after another."""
    padded = [v + b"\0" * (-len(v) % ROW_BYTES) for v in values]
    parts = [p[i : i + IMAGE_BYTES] for p in padded for i in range(0, len(p), IMAGE_BYTES)]
    at = np.cumsum([0, *map(len, parts)]) // ENCODE
    cuts = np.flatnonzero(np.diff(at[:-1], prepend=-1)).tolist() if parts else []
    done = chain.from_iterable(encode_many(parts[a:z]) for a, z in zip(cuts, [*cuts[1:], len(parts)], strict=True))
    return [b"".join(next(done) for _ in range(0, len(p), IMAGE_BYTES)) for p in padded]


def samples_of(px: np.ndarray) -> bytes:
    """The bytes that an image of ours holds."""
    if px.shape[1] == GREY:
        return (px & np.uint32(255)).astype(np.uint8).tobytes()
    return np.ascontiguousarray(_channels(px)[..., [2, 1, 0, 3]]).tobytes()


def decode_columns(media: list[bytes]) -> list[tuple[bytes, dict]]:
    """Bytes of images one after another, and counts of what their streams held."""
    streams = [list(chunks_of(m)) for m in media]
    done = iter(decode_streams([d for own in streams for d in own]))
    out = []
    for own in streams:
        got = [next(done) for _ in own]
        told = {name: sum(kind in t["transforms"] for _, t in got) for name, kind in (("predictor", PREDICTOR), ("cross", CROSS), ("green", GREEN), ("palette", PALETTE))}
        told |= {name: sum(t[name] for _, t in got) for name in ("copies", "cached")}
        out.append((b"".join(samples_of(px) for px, _ in got), told | {"images": len(got)}))
    return out


def encode_bytes(data: bytes) -> bytes:
    return encode_columns([data])[0]


def decode_bytes(media: bytes) -> bytes:
    return decode_columns([media])[0][0]


# --- columns ---------------------------------------------------------------------------------------------------------


def _mapped(df: DataFrame, column: str, new: str, kind: pa.DataType, f) -> DataFrame:
    """Adds a column; f takes lists of values that have about `SLICE` bytes."""
    base, names, col = by_place(df, column)
    keep = [i for i, c in enumerate(names) if c.lower() != new.lower()]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column(col)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            at = 0
            while at < whole.num_rows:
                z = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
                b = whole.slice(at, z - at)
                at = z
                values = b.column(col).to_pylist()
                some = [i for i, x in enumerate(values) if x is not None]
                got: list = [None] * len(values)
                for i, y in zip(some, f([values[i] for i in some]), strict=True):
                    got[i] = y
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(got, kind)], [*(b.schema.names[i] for i in keep), "made"])

    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*(base.schema.fields[i] for i in keep), StructField("made", from_arrow_type(kind))])
    return base.mapInArrow(go, schema).toDF(*(names[i] for i in keep), new)


def store_media(df: DataFrame, data: str, media: str = "media") -> DataFrame:
    """Adds the bytes of column `data` as lossless WebP."""
    return _mapped(df, data, media, pa.binary(), encode_columns)


def features_of(samples: bytes) -> str:
    """Rows, mean, deviation, and a histogram of 16 bins (in thousandths) of the samples."""
    v = np.frombuffer(samples, np.uint8)
    if not len(v):
        return "0"
    hist = np.bincount(v >> 4, minlength=16) * 1000 // len(v)
    return f"{len(v) // ROW_BYTES};{v.mean():.3f};{v.std():.3f};" + ",".join(map(str, hist.tolist()))


_READ = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("coding", pa.string())])


def _digests(media: list[bytes]) -> list[dict]:
    return [
        {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-64:]),
         "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": features_of(data), "coding": ",".join(f"{k}={v}" for k, v in told.items() if v)}
        for m, (data, told) in zip(media, decode_columns(media), strict=True)
    ]


def read_media(df: DataFrame, media: str = "media", to: str = "samples") -> DataFrame:
    """Adds the samples that a column of WebP files holds."""
    return _mapped(df, media, to, pa.binary(), lambda m: [data for data, _ in decode_columns(m)])


def digest_media(df: DataFrame, media: str = "media", to: str = "read") -> DataFrame:
    """Decodes the column as `read_media` does, and keeps digests, features, and what the streams held (transforms by images, copies, cache hits)."""
    return _mapped(df, media, to, _READ, _digests)


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    n = F.octet_length("data")
    pad = F.when((n == 0) | (n % 64 != 0), F.expr("unhex(repeat('00', cast(64 - octet_length(data) % 64 as int)))")).otherwise(F.lit(b""))
    stored = store_media(docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat("data", pad).alias("payload")), "payload").drop("payload")
    return digest_media(stored).select("doc_id", "n_bytes", "read.*")


QUERIES = {"op9_webp": op9_webp}
