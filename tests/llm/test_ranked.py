import math
import random
import re

import numpy as np
import pytest

from sparkseek.llm import ranked as R
from sparkseek.session import delete

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, tokens = len(own), sum(len(t) for _, t in own)
    df: dict[str, int] = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked: dict[int | None, set[str]] = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, q in asked.items():
        found = []
        for i, t in own:
            m = 50 + 50 * len(t) * n_docs // tokens
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in q if x in t)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [[f"{p}{i}" for i in range(60)] for p in "abé"]
    return [(i, " ".join(rng.choices(words[i % 3], [1 / (j + 1) for j in range(60)], k=rng.randint(3, 60))).title()) for i in range(n)]


def key(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


@pytest.mark.parametrize("postings,cluster,k", [(400, 5, 7), (10**6, 512, 50)])
def test_against_brute_force(spark, postings, cluster, k):
    docs = corpus(240)
    docs += [(300, None), (301, ""), (302, " .,;\x00\x7f"), (None, "a1 a2 b3"), (None, "a1"), (303, docs[4][1]), (304, docs[4][1]), (4, docs[4][1]), (4, docs[4][1]), (305, "a0 " * 30_000 + "rare"), (306, "x\u00a0y ÀÉ Çx İ")]
    items = [(1, docs[4][1]), (2, "B1, B2; b59"), (3, None), (4, "zzz-none"), (5, ""), (None, "rare é5"), (6, "a1"), (6, "b1 b1"), (7, "x\u00a0y àé ÀÉ"), (8, " ".join(t for _, t in docs[:40] if t))]
    index = R.build_index(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, HASH string").repartition(3), postings, cluster)
    got = R.search(index, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, term int"), k)
    assert key((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == key(plain(docs, items, k))
    assert index.docs == len(docs) - 3 and index.shards.count() >= (10 if postings == 400 else 1)
    seen = [x for r in index.shards.collect() for x in np.frombuffer(r.docs, np.int64)[np.frombuffer(r.known, np.uint8) > 0].tolist()]
    assert sorted(seen) == sorted(i for i, t in docs if i is not None and terms(t))
    assert all(len(r.cuts) // 4 - 1 >= len(r.docs) // 8 / cluster for r in index.shards.collect())
    delete(spark, index.path)


def test_bisection_separates_and_saves(spark):
    docs = corpus(120)
    starts, numbers, names = R._numbered([sorted({t.encode() for t in terms(x)}) for _, x in docs])
    parts = R.bisect(starts, numbers, len(names), 20)
    assert sorted(np.concatenate(parts).tolist()) == list(range(120)) and all(len(p) <= 20 for p in parts)

    def bits(order):
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        at: dict[int, list[int]] = {}
        for d in range(len(order)):
            for t in numbers[starts[d] : starts[d + 1]]:
                at.setdefault(int(t), []).append(place[d])
        return sum(math.log2(b - a) for x in at.values() for a, b in zip([-1, *sorted(x)], sorted(x), strict=False))

    assert bits(np.concatenate(parts)) < 0.85 * bits(np.arange(120))
    assert sum(max(np.bincount(p % 3)) == len(p) for p in parts) >= len(parts) // 2


def test_stops_early(spark):
    docs = corpus(600)
    index = R.build_index(spark.createDataFrame(docs, "doc_id long, text string"), 4000, 20)
    hits = R.search_block(index, {0: [b"a7", b"a30"], 1: [b"b3", b"b50"]}, 5)
    met, visited = hits.where("item = -1").selectExpr("sum(doc_id)", "sum(score)").first()
    assert met >= 2 * 600 / 20 and visited < 0.5 * met
    delete(spark, index.path)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.search(R.build_index(none), ask).count() == 0
    assert R.search(R.build_index(some), ask.limit(0)).count() == 0
    assert [tuple(r) for r in R.search(R.build_index(some), ask).collect()] == [(r[0], 1, r[2], r[3]) for r in plain([(1, "a b")], [(1, "a")], 5)]
    assert R.search(R.build_index(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")), ask).count() == 0
