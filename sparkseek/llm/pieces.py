"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model at hand is of the BPE kind, for which a Viterbi search over piece scores would give other ids than the model means. But
BPE has an equal lattice: a sequence of pieces is the encoding of its text exactly if each two neighbours are the encoding
of theirs (and single pieces of themselves). With weight 0 for such steps and -inf for others, the best path of the max-plus
lattice is the encoding, the only one of weight 0. A weight of 0 or -inf is a bit, so a row of a max-plus matrix is an integer.

Every text is cut anywhere, after each `CHUNK` characters. A state at a cut is a piece that covers the character before it; each
chunk gives the matrix that says which states at its end can follow which at its start; matrices are combined by an
associative scan, which tells the state at every cut; then each chunk is traced back by itself. No piece holds a space after
another character, so every path passes such a place: a chunk with one needs the lattice at its ends only (and what it says of a cut
depends on the word there, which recurs), and the words inside are looked up among those met before. Texts of more than
`PART` characters are dealt out by parts of that size: parts yield matrices, too, and are traced back in other tasks.

Characters without a piece become bytes. Decoding gives the text again, but for U+2581, which the model takes for a space.

Defined results: null texts give null ids and null decoded text; empty texts no ids; extra columns pass through (of a name that
clashes with an output, the output stays); rows may repeat; empty tables give empty results.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm.common import by_place, caches, table, task_of

TOKENIZERS = os.environ.get("SPARKSEEK_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
#: Characters of a chunk, and of what is dealt out of a giant text to other tasks.
CHUNK, PART = 1280, 32_768
#: Characters of texts coded at once, and words and cuts of words remembered; they bound a worker's memory.
SLICE, WORDS, CUTS = 1 << 22, 200_000, 50_000
#: Longer stretches are coded by themselves.
_WORD = 64
SPACE = "▁"
# Stretches between places that every path passes: before a space, and around line feeds where they have no piece.
_SEGMENT = {
    True: re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+"),
    False: re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"),
}

State = tuple[int, int]  # a piece's place: first character and end


class Model:
    """Pieces of a SentencePiece model of the BPE kind."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id = {s: i for i, s in self.piece.items()}
        self.score = {s: sp.get_score(i) for s, i in self.id.items()}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        #: What each id stands for, spaces plain; nothing for control pieces.
        self.raw = [self.piece[i].replace(SPACE, " ").encode() if i in self.piece else b"" for i in range(n)]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.longest = max(map(len, self.id))
        #: Every end of a piece, with the id if it is a piece itself, else -1.
        self.tails = {x[k:]: -1 for x in self.id for k in range(len(x))} | self.id
        if any(SPACE in s.lstrip(SPACE) or (s[0] == SPACE and s[1:2] == SPACE and s.strip(SPACE)) for s in self.id):
            raise ValueError("pieces that span words are not supported")
        self.length = {i: len(x) for i, x in self.piece.items()}
        self._pairs: dict[int, bool] = {}
        self._built: dict[int, tuple] = {}
        # Ids of words and of paths from and to cuts are kept as their bytes, which are put together faster than numbers.
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._cuts: dict[tuple, tuple | bytes] = {}
        # Bytes of each id, and, after those, without a space at their beginning.
        self._bytes = pa.array(self.raw + [x.removeprefix(b" ") for x in self.raw], pa.binary())
        self._split = _SEGMENT["\n" in self.id].findall

    def merges(self, s: str) -> list[str]:
        """BPE by its definition, for short strings: the best pair first, of equal ones the first."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = self.score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def built(self, i: int) -> tuple[list[float], list[str], list[str], bool]:
        """How BPE builds a piece's text: the score of each merge (-inf after the last), the last and the first part before it, and
        whether the piece itself comes out."""
        got = self._built.get(i)
        if got is None:
            parts = list(self.piece[i])
            scores, last, first = [], [parts[-1]], [parts[0]]
            while True:
                known = [(v, -k) for k in range(len(parts) - 1) if (v := self.score.get(parts[k] + parts[k + 1])) is not None]
                if not known:
                    break
                best, k = max(known)
                parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
                scores.append(best)
                last.append(parts[-1])
                first.append(parts[0])
            got = self._built[i] = ([*scores, float("-inf")], last, first, len(parts) == 1)
        return got

    def whole(self, i: int) -> bool:
        """Whether a piece is the encoding of its own text."""
        return self.built(i)[3]

    def pair(self, i: int, j: int) -> bool:
        """Whether two pieces are the encoding of their text."""
        key = i << 20 | j
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            got = self._pairs[key] = self.piece[i] + self.piece[j] not in self.id and self._apart(i, j)
        return got

    def _apart(self, i: int, j: int) -> bool:
        """The same, by the merges of both: each is built as by itself, the better merge first, as long as none over their border is due."""
        left, last, _, one = self.built(i)
        right, _, first, other = self.built(j)
        if not (one and other):
            return False
        get, x, y = self.score.get, 0, 0
        while True:
            u, v = left[x], right[y]
            over = get(last[x] + first[y])
            if over is not None and over > u and over >= v:  # of equal ones the first from the left
                return False
            if u >= v:
                if x == len(left) - 1:
                    return True
                x += 1
            else:
                y += 1

    # --- lattice over a text; -1 stands for no piece before, as at a place that every path passes ---

    def ending(self, s: str, end: int, floor: int) -> list[tuple[int, int]]:
        """(start, id) of the pieces that end at a place, none from before `floor`."""
        get = self.id.get
        return [(k, i) for k in range(max(floor, end - self.longest), end) if (i := get(s[k:end])) is not None]

    def segment(self, s: str) -> tuple[int, ...]:
        """Ids of a stretch between places that every path passes. The forward pass keeps the one piece that can end at each place."""
        tails, known, pair, whole = self.tails, self._pairs.get, self.pair, self.whole
        n = len(s)
        last = [-1] * (n + 1)  # -1: a place that every path passes
        back = [0] * (n + 1)
        for end in range(1, n + 1):
            k = end - 1
            i = tails.get(s[k])
            if i is None or i < 0 and s[k] not in self.id:  # a character without a piece cuts the path
                back[end] = k
                continue
            while i is not None:
                if i >= 0:
                    p = last[k]
                    ok = known(p << 20 | i) if p >= 0 else whole(i)
                    if ok or (ok is None and pair(p, i)):
                        last[end], back[end] = i, k
                        break
                k -= 1
                # Beyond a character without a piece no piece goes on.
                i = tails.get(s[k:end]) if k >= 0 else None
            else:
                raise ValueError(f"no path through {s[:40]!r}")
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
            else:
                out += [self.byte[b] for b in reversed(s[n - 1].encode("utf-8", "surrogatepass"))]
            n = back[n]
        return tuple(reversed(out))

    def words(self, every: set[str]) -> dict[str, bytes]:
        """Ids of different stretches, as `segment` finds them. In order, words share beginnings with the one before, and the forward pass
        goes on from there."""
        out: dict[str, bytes] = {}
        tails, known, pair, length = self.tails, self._pairs.get, self.pair, self.length
        last, before, done = [-1] * (_WORD + 1), "", 0
        for s in sorted(every):
            n = len(s)
            if n > _WORD:
                out[s] = array("i", self.segment(s)).tobytes()
                continue
            k, most = 0, min(n, done)
            while k < most and s[k] == before[k]:
                k += 1
            before = s
            for end in range(k + 1, n + 1):
                j = end - 1
                i = tails.get(s[j])
                if i is None or i < 0 and s[j] not in self.id:  # a character without a piece
                    break
                while i is not None:
                    if i >= 0:
                        if j:
                            p = last[j]
                            ok = known(p << 20 | i)
                            if ok is None:
                                ok = pair(p, i)
                        else:
                            ok = self.whole(i)
                        if ok:
                            last[end] = i
                            break
                    j -= 1
                    i = tails.get(s[j:end]) if j >= 0 else None
                else:
                    raise ValueError(f"no path through {s[:40]!r}")
            else:
                done, way = n, []
                while n:
                    i = last[n]
                    way.append(i)
                    n -= length[i]
                way.reverse()
                out[s] = array("i", way).tobytes()
                continue
            done = end - 1
            out[s] = array("i", self.segment(s)).tobytes()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of whole texts; each different word is looked at once."""
        split = [None if t is None else self._split(normalised(t)) for t in texts]
        self._learn(set().union(*(w for w in split if w)))
        return [None if w is None else np.frombuffer(b"".join(self.chunks(w)), np.int32) for w in split]

    def _learn(self, every: set[str]) -> None:
        """Makes words known. Of those met before, the ones that recur stay."""
        if len(self._words) > WORDS:
            self._older, self._words = self._words, {}
        known, older = self._words, self._older
        new = every.difference(known)
        again = [w for w in new if w in older]
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        known.update(self.words(new.difference(again)))

    def encode_free(self, s: str) -> list[int]:
        """Ids of a normalised text whose ends every path passes."""
        w = self._split(s)
        self._learn(set(w))
        return array("i", b"".join(self.chunks(w))).tolist()

    def _at_cut(self, word: str, k: int, leading: bool) -> tuple[list[State], int]:
        """States at a cut of a word, and bits of those that lead to its end, or are reached from its beginning."""
        key = (word, k, leading)
        got = self._cuts.get(key)
        if got is None:
            if len(self._cuts) > CUTS:
                self._cuts.clear()
            states = self.states(word, k)
            if states == [(k, k)]:
                got = states, 1
            elif leading:
                got = states, self._leading(word, states)
            else:
                got = states, self._reached(word, states)
            self._cuts[key] = got
        return got

    def _reached(self, word: str, states: list[State]) -> int:
        """Bits of the states that a path from the word's beginning reaches: the row that a matrix has for it."""
        first = min(a for a, _ in states)
        at = self.reach(word, {(0, 0): 1}, max(1, max(a for a, _ in states))) if first or len(states) > 1 else {0: {-1: 1}}
        bits = 0
        for j, (a, b) in enumerate(states):
            i = self.id[word[a:b]]
            if any(own and (self.whole(i) if p < 0 else self.pair(p, i)) for p, own in at.get(a, {}).items()):
                bits |= 1 << j
        return bits

    def _leading(self, word: str, states: list[State]) -> int:
        """Bits of the states from which a path leads to the word's end."""
        n = len(word)
        at = self.reach(word, {x: 1 << j for j, x in enumerate(states)}, n)
        bits = 0
        for own in at.get(n, {}).values():
            bits |= own
        return bits

    def _piece_path(self, word: str, enter: State, leave: State) -> bytes:
        key = (word, enter, leave)
        got = self._cuts.get(key)
        if got is None:
            if enter == (0, 0) and leave[0] > 0:  # one path leads to each place
                own = (self.id[word[leave[0] : leave[1]]],) if leave[1] > leave[0] else ()
                got = (*self.segment(word[: leave[0]]), *own)
            else:
                got = self.trace(word, enter, leave, enter[1], leave[1])
            got = self._cuts[key] = array("i", got).tobytes()
        return got

    def chunks(self, words: list[str]) -> list[bytes]:
        """Ids of a text that consists of words (all known) between places that every path passes, in parts: the text is cut after each
        `CHUNK` characters, chunks give matrices, their scan the states at the cuts, and each chunk is traced back."""
        known = self._words.__getitem__
        ends = list(accumulate(map(len, words)))
        n = ends[-1] if ends else 0
        if n <= CHUNK:
            return list(map(known, words))  # one chunk, and a path through every word
        # Cuts: the word they lie in, and the place there (0: between words).
        cuts = []
        for c in range(CHUNK, n, CHUNK):
            i = bisect_right(ends, c)
            cuts.append((i, c - (ends[i - 1] if i else 0)))
        here: list[State] = [(0, 0)]
        matrices = []
        before = (-1, 0)
        bits = 1
        for i, k in [*cuts, (len(words), 0)]:
            own = before[0] == i  # both ends in one long word
            if own and k:
                matrices.append(self.matrix(words[i], before[1], k))
            else:
                if before[1]:
                    here, bits = self._at_cut(words[before[0]], before[1], True)
                else:
                    here, bits = [(0, 0)], 1
                there, reached = self._at_cut(words[i], k, False) if k else ([(0, 0)], 1)
                matrices.append((here, there, [bits if reached >> j & 1 else 0 for j in range(len(there))]))
            before = (i, k)
        states = cut_states(matrices)
        out: list[bytes] = []
        before, enter = (0, 0), (0, 0)
        for (i, k), leave in zip([*cuts, (len(words), 0)], states[1:], strict=True):
            j, a = before
            if j == i and a:
                out.append(self._piece_path(words[i], enter, leave))
            else:
                if a:
                    out.append(self._piece_path(words[j], enter, (len(words[j]),) * 2))
                    j += 1
                out += map(known, words[j:i])
                if k:
                    out.append(self._piece_path(words[i], (0, 0), leave))
            before, enter = (i, k), leave
        return out

    def passes(self, s: str, k: int) -> bool:
        """Whether every path passes a place inside a text."""
        return (s[k] == SPACE and s[k - 1] != SPACE) or s[k - 1] not in self.id or s[k] not in self.id

    def first_pass(self, s: str, start: int, end: int) -> int | None:
        return next((k for k in range(max(start, 1), min(end, len(s) - 1) + 1) if self.passes(s, k)), None)

    def last_pass(self, s: str, start: int, end: int) -> int | None:
        return next((k for k in range(min(end, len(s) - 1), max(start, 1) - 1, -1) if self.passes(s, k)), None)

    def states(self, s: str, cut: int) -> list[State]:
        """Pieces that cover the character before a cut; of a place that every path passes, the one state (cut, cut)."""
        if cut == 0 or cut == len(s) or self.passes(s, cut):
            return [(cut, cut)]
        return [(a, b) for a in range(max(0, cut - self.longest), cut) for b in range(cut, min(len(s), a + self.longest) + 1) if s[a:b] in self.id]

    def reach(self, s: str, begin: dict[State, int], stop: int) -> dict[int, dict[int, int]]:
        """From states with bit sets, the bit sets of (end, id) up to pieces that cover the character before `stop`."""
        at: dict[int, dict[int, int]] = {}
        for (a, b), bits in begin.items():
            own = at.setdefault(b, {})
            i = self.id[s[a:b]] if b > a else -1
            own[i] = own.get(i, 0) | bits
        lowest = min(b for _, b in begin)
        for end in range(lowest + 1, min(len(s), stop + self.longest) + 1):
            if s[end - 1] not in self.id:  # goes to bytes, whatever comes before
                if end - 1 in at and end <= stop:
                    every = 0
                    for bits in at[end - 1].values():
                        every |= bits
                    at[end] = {-1: every}
                continue
            for k, i in self.ending(s, end, lowest):
                if k >= stop or k not in at:
                    continue
                bits = 0
                for p, own in at[k].items():
                    if self.whole(i) if p < 0 else self.pair(p, i):
                        bits |= own
                if bits:
                    here = at.setdefault(end, {})
                    here[i] = here.get(i, 0) | bits
            if end < stop and self.passes(s, end) and end in at:
                every = 0
                for bits in at[end].values():
                    every |= bits
                at[end] = {-1: every}
        return at

    def matrix(self, s: str, start: int, stop: int) -> tuple[list[State], list[State], list[int]]:
        """States at both ends of a chunk, and for each one at the end the bits of those at the start that lead to it."""
        left, right = self.states(s, start), self.states(s, stop)
        begin = {x: 1 << k for k, x in enumerate(left)}
        head = self.first_pass(s, start + 1, stop - 1)
        if head is not None:
            # All paths meet at a place inside: what comes from the start, and what goes to the end.
            got = 0
            for (a, b), bits in begin.items():
                got |= bits if b == head else 0
            for bits in self.reach(s, {x: v for x, v in begin.items() if x[1] <= head} or {(head, head): 0}, head).get(head, {}).values():
                got |= bits
            tail = self.last_pass(s, head, stop - 1)
            begin = {(tail, tail): got}
        at = self.reach(s, begin, stop)
        rows = []
        for a, b in right:
            if a == b:
                bits = 0
                for v in at.get(b, {}).values():
                    bits |= v
            else:
                bits = at.get(b, {}).get(self.id[s[a:b]], 0)
                if (a, b) in begin:  # a piece longer than the chunk
                    bits |= begin[a, b]
            rows.append(bits)
        return left, right, rows

    def trace(self, s: str, enter: State, leave: State, start: int, stop: int) -> list[int]:
        """Ids of the pieces after `enter` up to `leave`, itself included: those whose last character lies in the chunk or that cover the cut."""
        if enter == leave and enter[1] > enter[0]:
            return []
        a, z = enter[1], leave[1]
        if 0 < a < len(s) and self.passes(s, a):
            enter = (a, a)
        head = self.first_pass(s, a + 1, leave[0] if leave[1] > leave[0] else z - 1) if z > a else None
        if head is None:
            return self._path(s, enter, leave)
        tail = self.last_pass(s, head, leave[0] if leave[1] > leave[0] else z - 1)
        return self._path(s, enter, (head, head)) + self._between(s[head:tail]) + self._path(s, (tail, tail), leave)

    def _between(self, s: str) -> list[int]:
        return self.encode_free(s) if s else []

    def _path(self, s: str, enter: State, leave: State) -> list[int]:
        """Backtrace of the one path between two states without a place that all paths pass inside."""
        start, end = enter[1], leave[1]
        if start == end:
            return []
        part = s[start:end]
        if enter[0] == enter[1] and leave[0] == leave[1]:
            return list(self.segment(part))
        at = self.reach(s[:end], {enter: 1}, end)
        cur = (end, self.id[s[leave[0] : leave[1]]] if leave[1] > leave[0] else next(iter(at[end])))
        out = []
        while cur[0] > start:
            end, i = cur
            out.append(i)
            k = end - len(self.piece[i])
            cur = (k, next(p for p in at[k] if (self.whole(i) if p < 0 else self.pair(p, i))))
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def texts(self, ids: list[np.ndarray | None]) -> pa.Array:
        """What `decode` gives for whole encodings, for many at once."""
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
        flat = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)])
        begin = ends[:-1][np.diff(ends) > 0]
        if not all(self.raw[i][:1] == b" " for i in flat[begin].tolist()):
            return pa.array([None if x is None else self.decode(x.tolist()) for x in ids], pa.string())
        flat[begin] += len(self.raw)  # without the space before the text
        got = self._bytes.take(pa.array(flat))
        at = np.frombuffer(got.buffers()[1], np.int32, len(flat) + 1, got.offset * 4)
        return pa.StringArray.from_buffers(len(ids), pa.py_buffer(np.ascontiguousarray(at[ends])), got.buffers()[2], pa.array([x is not None for x in ids], pa.bool_()).buffers()[1])


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def multiply(a: tuple, b: tuple) -> tuple:
    """Max-plus product of two neighbouring chunks' matrices."""
    left, middle, rows = a
    other, right, more = b
    if middle != other:
        raise ValueError("chunks do not meet")
    out = []
    for bits in more:
        got, k = 0, 0
        while bits:
            if bits & 1:
                got |= rows[k]
            bits >>= 1
            k += 1
        out.append(got)
    return left, right, out


def scan(matrices: list[tuple]) -> list[tuple]:
    """All prefix products, pairs first (as a parallel scan does)."""
    if len(matrices) == 1:
        return matrices
    pairs = scan([multiply(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else multiply(pairs[k // 2 - 1], matrices[k]))
    return out


def cut_states(matrices: list[tuple]) -> list[State]:
    """The state of the only whole path at each cut, both ends included."""
    prefix = scan(matrices)
    state = prefix[-1][1][0]
    out = [state]
    for k in range(len(matrices) - 1, -1, -1):
        left, right, rows = matrices[k]
        into = rows[right.index(state)]
        here = prefix[k - 1] if k else None
        found = [x for j, x in enumerate(left) if into >> j & 1 and (here is None or here[2][j])]
        if len(found) != 1:
            raise ValueError(f"{len(found)} paths")
        state = found[0]
        out.append(state)
    return out[::-1]


_MODELS: dict[str, Model] = {}


def _forget() -> None:
    for m in _MODELS.values():
        for kept in (m._words, m._older, m._cuts, m._pairs, m._built):
            kept.clear()


caches("pieces", _forget)


def model(folder: str, name: str) -> Model:
    task_of("pieces")
    path = os.path.join(folder, name)
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `SLICE` bytes in a column."""
    for b in batches:
        rows = max(1, int(b.num_rows * SLICE / max(SLICE, b.column(column).nbytes)))
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _flat(lists: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *(x for x in lists if x is not None)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in lists], pa.bool_()))


def _long(texts: DataFrame, folder: str, name: str) -> DataFrame:
    """key, text (different long texts) to key, ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder, name)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = normalised(text)
                n = -(-len(s) // PART)
                for k in range(n):
                    a, z = k * PART, min(len(s), (k + 1) * PART)
                    low, high = max(0, a - m.longest - 1), min(len(s), z + m.longest + 1)
                    row = [[key], [k], [n], [low], [a - low], [z - low], [high == len(s)], [s[low:high]]]
                    kinds = (pa.binary(), *[pa.int32()] * 5, pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["key", "k", "n", "low", "start", "stop", "last", "part"])

    schema = "key binary, k int, n int, low int, start int, stop int, last boolean, part string"
    # The chunks are dealt out by themselves, so that a giant text keeps many tasks busy.
    chunks = texts.mapInArrow(cut, schema).repartition("key", "k")
    pair = pa.list_(pa.int32())

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder, name)
        for b in batches:
            rows = b.to_pylist()
            got = []
            for r in rows:
                left, right, bits = m.matrix(r["part"], r["start"], r["stop"])
                flat = lambda x, low=r["low"]: [v + low for p in x for v in p]
                got.append((r["key"], r["k"], flat(left), flat(right), [v.to_bytes((v.bit_length() + 7) // 8, "little") for v in bits]))
            cols = list(zip(*got, strict=True)) or [[]] * 5
            kinds = (pa.binary(), pa.int32(), pair, pair, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "k", "left", "right", "bits"])

    def combine(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["k"])
        pairs = lambda v: list(zip(v[::2], v[1::2], strict=True))
        states = cut_states([(pairs(r["left"]), pairs(r["right"]), [int.from_bytes(x, "little") for x in r["bits"]]) for r in rows])
        return pa.table(
            {"key": pa.array([r["key"] for r in rows], pa.binary()), "k": pa.array([r["k"] for r in rows], pa.int32()),
             "enter": pa.array([list(x) for x in states[:-1]], pair), "leave": pa.array([list(x) for x in states[1:]], pair)}
        )

    # A text has as many matrices as chunks, each of a few states: far less than the text, which is one value anyway.
    cuts = chunks.mapInArrow(transfer, "key binary, k int, left array<int>, right array<int>, bits array<binary>").groupBy("key").applyInArrow(combine, "key binary, k int, enter array<int>, leave array<int>")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder, name)
        for b in batches:
            rows = b.to_pylist()
            ids = [np.array(m.trace(r["part"], tuple(v - r["low"] for v in r["enter"]), tuple(v - r["low"] for v in r["leave"]), r["start"], r["stop"]), np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.binary()), pa.array([r["k"] for r in rows], pa.int32()), _flat(ids)], ["key", "k", "ids"])

    traced = chunks.join(cuts, ["key", "k"]).select("key", "k", "low", "start", "stop", "part", "enter", "leave").mapInArrow(back, "key binary, k int, ids array<int>")
    return traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, text: str = "text", to: str = "ids", folder: str = TOKENIZERS, name: str = MODEL, decoded: str | None = None) -> DataFrame:
    """Adds the ids of a text column; and, if a name for it is given, the text decoded from them, by the same worker."""
    new = [to, *([decoded] if decoded else [])]
    base, kept, at = by_place(docs, text, new)
    whole = F.col(f"_{at}")
    giant = F.coalesce(F.length(whole) >= PART, F.lit(False))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())][: len(new)]
    schema = T.StructType([*base.schema.fields, *fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder, name)
        for b in _slices(batches, at):
            ids = m.encode_batch(b.column(at).to_pylist())
            more = [m.texts(ids)] if decoded else []
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), _flat(ids), *more], [*b.schema.names, *(f.name for f in fields)])

    short = base.where(~giant).mapInArrow(go, schema)
    key = F.unhex(F.md5(whole.cast("binary")))
    long_ = base.where(giant)
    ids = _long(long_.select(key.alias("key"), whole.alias("text")).dropDuplicates(["key"]), folder, name)
    joined = long_.join(ids.withColumnsRenamed({"key": "_key", "ids": "_ids"}), key == F.col("_key")).select(*base.columns, F.col("_ids").alias("ids"))
    return short.unionByName(decode(joined, "ids", "decoded", folder, name) if decoded else joined).toDF(*kept, *new)


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", folder: str = TOKENIZERS, name: str = MODEL) -> DataFrame:
    """Adds the text of a column of ids."""
    base, kept, at = by_place(df, ids, [to])
    schema = T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder, name)
        for b in _slices(batches, at):
            col = b.column(at)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).cumsum().tolist()
            null, out, a = col.is_null().to_pylist(), [], 0
            for z, none in zip(ends, null, strict=True):
                out.append(None if none else m.decode(flat[a:z].tolist()))
                a = z
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return base.mapInArrow(go, schema).toDF(*kept, to)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = encode(docs, decoded="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"),
        F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))).alias("round_trip"),
    )


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
