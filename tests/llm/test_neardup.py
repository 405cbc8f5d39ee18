import random

import numpy as np
import pytest

from sparkseek.llm import neardup as N
from sparkseek.llm.components import components


def plain(a, b):
    x, y = dict(zip(*(v.tolist() for v in a), strict=True)), dict(zip(*(v.tolist() for v in b), strict=True))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def test_probability_jaccard():
    r = random.Random(1)
    for _ in range(200):
        a, b = (N.weighted([r.choice("abc") for _ in range(r.randint(1, 25))]) for _ in range(2))
        assert N.probability_jaccard(a, b) == pytest.approx(plain(a, b))
    assert N.probability_jaccard(a, a) == pytest.approx(1)


def test_signatures_estimate():
    r = random.Random(2)
    base = [f"w{r.randint(0, 90)}" for _ in range(400)]
    texts = [base]
    for k in (1, 4, 12):
        t = list(base)
        for _ in range(k):
            t[r.randrange(400)] = f"x{r.random()}"
        texts.append(t)
    texts += [["a"], ["a", "b"], ["z"] * 60, []]
    m = 4000
    sig = N.signatures(*N.shingles(texts), len(texts), m)
    for k in (1, 2, 3):
        assert (sig[0] == sig[k]).mean() == pytest.approx(N.probability_jaccard(N.weighted(texts[0]), N.weighted(texts[k])), abs=0.03)
    alone = N.signatures(*N.shingles([texts[2]]), 1, m)
    assert np.array_equal(alone[0], sig[2]) and not sig[-1].any() and sig[:-1].all()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == linked and all(root(k) == root(v) and v == min(x for x in linked if root(x) == root(k)) for k, v in got.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "in"]) for _ in range(r.randint(1, 5)))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 150))]
        docs.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(len(t))] = word()
            docs.append(" ".join(t).upper() if r.random() < 0.3 else " ".join(t) + "!")
    return docs + [docs[0]] * 5 + ["", None, "...", "one two", "One, two!", "alone"]


@pytest.mark.parametrize("seed,block", [(0, 2048), (1, 4)])
def test_classes(spark, monkeypatch, seed, block):
    monkeypatch.setattr(N, "BLOCK", block)
    texts = corpus(seed)
    words = [N.words_of(t) for t in texts]
    w = [N.weighted(x) for x in words]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if words[i] == words[j] or (words[i] and words[j] and N.probability_jaccard(w[i], w[j]) >= N.SIMILAR):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = {x.doc_id: x.class_id for x in N.classes(d).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    if seed == 0:
        more = spark.createDataFrame([*rows, (None, "x", 1), (3, texts[3], 1)], d.schema)
        left = N.deduplicate(more)
        assert left.columns == d.columns
        ids = sorted((x.doc_id if x.doc_id is not None else -1) for x in left.collect())
        assert ids == [-1, *sorted(set(got.values()))]
        assert N.classes(d.limit(0)).count() == 0
