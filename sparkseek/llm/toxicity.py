"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learnt from a bounded sample of labelled documents that aren't held out: whole words and word stems whose
share of toxic documents is far above chance, chosen one after another by what they add (so words that merely come along
in the same documents stay out). All words are run through one deterministic automaton, built as needed, which is the
product of the lexicon's trie with the Levenshtein automata of its entries (one edit for words and stems of `FUZZY_FROM`
letters or more, none for shorter ones). Each hit is weighed by the `WINDOW` words before it: quotation marks and reporting verbs lower its
weight, an address raises it. A logistic regression over the sums, fitted on the same sample, gives the score.

Texts are used whole and lower case. Defined results: a null or empty text has no hits and gets the score of such texts;
without labels to learn from all scores are 0; extra columns pass through (of a name that clashes with an output, the
output stays); of several labels of a document the highest counts; rows may repeat; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm.common import by_place, held_out, table, task_of

#: Bounds of the labelled sample: documents of either label, and characters of each. They bound the lexicon, too: every entry covers a toxic
#: document of the sample that none before it covers, and a candidate has to occur in many of them.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 20_000
STEMS = range(3, 8)
FUZZY_FROM = 5
WINDOW = 4
THRESHOLD = 0.3
#: An entry needs this likelihood ratio over chance (as the best of about so many candidates), and this one in documents without other entries.
BY_CHANCE, MARGINAL = 1e5, 100
#: Other documents with an entry count so many times when entries are chosen.
WARY = 5
QUOTED, ADDRESSED, FUZZY = 0.3, 1.5, 0.6
_WORD = re.compile(r"\w+")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
# Words that report speech, and that address someone.
REPORTING = frozenset("said says say wrote writes quote quoted quotes called calls dit écrit cite sagte schrieb zitiert dijo escribió cita".split())
ADDRESS = frozenset("you your yours u du dein deine ihr tu ton toi vous votre usted tú vosotros".split())
FEATURES = ("weight", "exact", "fuzzy", "quoted", "density")


class Automaton:
    """All words within the edits allowed of an entry. Entries that end in * are stems, and match any longer word that begins so;
    with fuzzy_stems, one that begins with a string within the edits allowed."""

    MAX_STATES = 100_000

    def __init__(self, entries: list[str], fuzzy_stems: bool = False):
        self.child: list[dict[str, int]] = [{}]
        self.edits: list[dict[bool, int]] = [{}]  # of a node that ends an entry: is it a stem -> edits allowed
        self.most = [0]
        for e in entries:
            stem, word = e.endswith("*"), e.rstrip("*")
            allowed = 1 if len(word) >= FUZZY_FROM and (fuzzy_stems or not stem) else 0
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in word:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.edits.append({})
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.edits[node][stem] = max(allowed, self.edits[node].get(stem, 0))
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.final: list[int] = []  # fewest edits of an entry that ends here; -1: none
        self.stem: list[int] = []  # the same for stems that ended on the way
        self.start = self._state({(0, 0)}, -1)

    def _state(self, items: set[tuple[int, int]], stem: int) -> int:
        todo = list(items)
        while todo:  # letters of the entry that the word lacks
            node, e = todo.pop()
            for n in self.child[node].values():
                if e < self.most[n] and (n, e + 1) not in items:
                    items.add((n, e + 1))
                    todo.append((n, e + 1))
        here = min((e for node, e in items if e <= self.edits[node].get(True, -1)), default=-1)
        after = min((e for e in (stem, here) if e >= 0), default=-1)
        key = frozenset(items) | {(-1, stem), (-2, after)}
        if key not in self.ids:
            ends = [e for node, e in items if e <= self.edits[node].get(False, -1)] + [stem] * (stem >= 0)
            self.ids[key] = len(self.sets)
            self.sets.append(frozenset(items))
            self.step.append({})
            self.final.append(min(ends, default=-1))
            self.stem.append(after)
        return self.ids[key]

    def _next(self, s: int, c: str) -> int:
        items = set()
        for node, e in self.sets[s]:
            if e < self.most[node]:
                items.add((node, e + 1))  # a letter too many
            for own, n in self.child[node].items():
                cost = e + (own != c)
                if cost <= self.most[n]:
                    items.add((n, cost))
        got = self._state(items, self.stem[s]) if items or self.stem[s] >= 0 else -2
        self.step[s][c] = got
        return got

    def match(self, word: str) -> int:
        """Fewest edits to an entry, or -1."""
        if len(self.sets) > self.MAX_STATES:
            self._reset()
        s = self.start
        for c in word:
            s = self.step[s].get(c, -1) if c in self.step[s] else self._next(s, c)
            if s == -2:
                return -1
        return self.final[s]


class Scorer:
    """Hits of a text and their weights; words seen before are remembered."""

    def __init__(self, entries: list[str]):
        self.automaton, self.seen = Automaton(entries, fuzzy_stems=True), {}

    def features(self, text: str) -> tuple[float, ...]:
        low = text.lower()
        words = _WORD.findall(low)
        seen, match = self.seen, self.automaton.match
        if len(seen) > 200_000:
            seen.clear()
        hits = []
        for i, w in enumerate(words):
            e = seen.get(w)
            if e is None:
                e = seen[w] = match(w)
            if e >= 0:
                hits.append((i, e))
        if not hits:
            return (0.0,) * len(FEATURES)
        weight = exact = fuzzy = quoted = 0.0
        places = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        for i, e in hits:
            w = 1.0 if e == 0 else FUZZY
            before = words[max(0, i - WINDOW) : i]
            left = low[places[max(0, i - WINDOW)][0] : places[i][0]]
            right = low[places[i][1] : places[min(len(words) - 1, i + WINDOW)][1] + 1]
            # An opening mark before it without a closing one between, and a closing one after it.
            marks = [c for c in left if c in _OPEN or c in _CLOSE]
            in_marks = bool(marks) and marks[-1] in _OPEN and (marks[-1] != '"' or len([c for c in marks if c == '"']) % 2 == 1) and any(c in _CLOSE for c in right)
            if in_marks or REPORTING.intersection(before):
                w *= QUOTED
                quoted += 1
            elif ADDRESS.intersection(before):
                w *= ADDRESSED
            exact += e == 0
            fuzzy += e > 0
            weight += w
        return math.log1p(weight), math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), 10 * weight / len(words)


def word_features(text: str) -> set[str]:
    """Words and stems (with a *) of a text."""
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) >= 3:
            out.add(w)
            out.update(w[:k] + "*" for k in STEMS if k < len(w))
    return out


def _surprise(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Half of the G statistic of a toxic and b other documents against the share of toxic ones; 0 where they are no more than chance."""
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(a > 0, a * np.log(a / (n * share)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - share))), 0)
    return np.where(a > n * share, g, 0.0)


def choose(docs: np.ndarray, words: np.ndarray, names: list[str], others: np.ndarray, n_toxic: int, share: float, least: float) -> list[str]:
    """Greedy cover of toxic documents. docs, words: pairs of a toxic document and a candidate in it; others: other documents of each candidate."""
    left, out = np.ones(n_toxic, bool), []
    rank = np.array([(not x.endswith("*"), len(x)) for x in names], dtype=[("whole", bool), ("n", int)])
    rank = np.argsort(np.argsort(rank, order=("whole", "n"), kind="stable"))
    while True:
        use = left[docs]
        a = np.bincount(words[use], minlength=len(names)).astype(float)
        g = _surprise(a, WARY * others, share)  # of what isn't covered yet
        best = int(np.lexsort((rank, g))[-1]) if len(g) else -1
        if best < 0 or g[best] < least:
            return out
        out.append(names[best])
        left[docs[words == best]] = False
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; the intercept comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float]] | None:
    """The lexicon and the regression's weights; None if there are no labels of both kinds."""
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    per = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    if len(per) < 2:
        return None
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(23))
    parts = [known.where((F.col("toxic") > 0) == t).where(F.pmod(order, F.lit(1 << 20)) < min(1.0, 1.5 * SAMPLE_DOCS / n) * (1 << 20)).orderBy(order).limit(SAMPLE_DOCS) for t, n in per.items()]
    ids = parts[0].unionByName(parts[1])  # two numbers for each of 2 * SAMPLE_DOCS rows at most: small enough to broadcast
    text = F.coalesce(docs["text"], F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic")).distinct()
    sample = sample.persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in word_features(t):
                    n.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array([v[1] for v in n.values()], pa.int64()), pa.array([v[0] for v in n.values()], pa.int64())], ["f", "a", "b"]
            )

    try:
        n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if len(n) < 2:
            return None
        share = n[True] / (n[True] + n[False])
        counts = sample.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        # Far above chance even for the luckiest of a million candidates; the driver gets these only.
        least = math.log(BY_CHANCE)
        g = F.col("a") * F.log(F.col("a") / ((F.col("a") + F.col("b")) * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / ((F.col("a") + F.col("b")) * (1 - share)))).otherwise(0.0)
        best = counts.where((F.col("a") > 0) & (F.col("a") > (F.col("a") + F.col("b")) * max(share, 0.5))).withColumn("g", g).where(F.col("g") >= least)
        cand = best.orderBy(F.desc("g"), "f").select("f", "b").toPandas()
        names = cand["f"].tolist()
        index = {f: i for i, f in enumerate(names)}

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [sorted(index[f] for f in word_features(t) if f in index) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["w"])

        rows = [r.w for r in sample.where("toxic").select("text").mapInArrow(pairs, "w array<int>").collect()]
        docs_at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        entries = choose(docs_at, np.array([w for r in rows for w in r], int), names, cand["b"].to_numpy().astype(float), len(rows), share, math.log(MARGINAL))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Scorer(entries)
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([s.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

        got = sample.mapInArrow(measure, "x array<double>, y boolean").collect()
    finally:
        sample.unpersist()
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    true = per[True] / (per[True] + per[False])  # the sample holds other shares of the labels
    weight = np.where(y > 0, true / share, (1 - true) / (1 - share))
    return entries, _fit(x, y, weight).tolist()


def score(docs: DataFrame, model: tuple[list[str], list[float]] | None, text: str = "text") -> DataFrame:
    """Adds score, predicted, and the hits' summed weight as toxic_weight."""
    names = ("score", "predicted", "toxic_weight")
    base, kept, at = by_place(docs, text, names)
    schema = T.StructType(
        [*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_weight", T.DoubleType())]
    )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("toxicity")
        s = Scorer(model[0]) if model else None
        for b in batches:
            texts = b.column(at).to_pylist()
            if s:
                x = np.array([s.features(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(model[1][:-1]) + model[1][-1], -30, 30)))
                w = np.expm1(x[:, 0])
            else:
                p = w = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(kept))), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(w)], [*b.schema.names, *names]
            )

    return base.mapInArrow(go, schema).toDF(*kept, *names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
