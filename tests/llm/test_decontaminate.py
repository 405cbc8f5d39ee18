import random

import numpy as np
import pytest

from sparkseek.llm import decontaminate as D


def distance(item: bytes, text: bytes):
    """Fewest edits of the item within the text, and the first end."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row), row.index(min(row))


def text(r, n, words=("the", "and", "tion", "er", "on", "hend", "ofthe", "retion", "é")):
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n))


def changed(r, s, k):
    s = list(s)
    for _ in range(k):
        i = r.randrange(len(s))
        how = r.randrange(3)
        if how == 0:
            s[i] = r.choice("xyz ")
        elif how == 1:
            s.insert(i, r.choice("xyz"))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    r = random.Random(seed)
    items = [(i, text(r, r.randint(1, 25))) for i in range(12)] + [(90, "ab"), (91, "xyz"), (92, "")]
    docs = []
    for _ in range(25):
        t = text(r, r.randint(0, 40))
        if r.random() < 0.7:
            own = r.choice(items[:12])[1]
            t += "\n  " + changed(r, own, r.randint(0, max(1, len(own) // 8))).upper() + " " + text(r, r.randint(0, 9))
        docs.append(t)
    folded = [(i, D.fold(t)) for i, t in items]
    got = D.Index(folded).hits([D.fold(t) for t in docs])
    n = 0
    for t, hits in zip(docs, got, strict=True):
        want = {}
        for i, b in folded:
            if b:
                e, end = distance(b, D.fold(t))
                if e <= (D.budget(len(b)) if len(b) >= D.Q else 0):
                    want[i] = (e, end)
        assert {h[0]: (h[1], h[3]) for h in hits} == want
        n += len(hits)
        for i, e, a, z in hits:
            assert distance(dict(folded)[i], D.fold(t)[a:z])[0] == e
    assert n > 5


def test_places():
    t = "  Ab\n\t cÉ  d"
    f = D.fold(t)
    a = f.index("é".encode())
    p = D.places(t)
    assert len(p) == len(f) and p[a] == p[a + 1] == 8 and t[8] == "É"


def test_query(spark):
    item = "Thtieding. Onhe in haedea it ha with orbleat thesstea heerthly. Erensh oron nt thinorsh."
    docs = [(1, f"before {item} after", "x", 9), (2, None, "x", 0), (3, "", None, 0), (4, "clean words only here", "x", 1), (5, item.upper().replace(" ", "\n "), "y", 1), (5, item, "y", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, start int")
    b = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = sorted(map(tuple, D.find_leaks(d, b).collect()))
    assert got[0] == (1, 7, 0, 7, 7 + len(item)) and [x[0] for x in got] == [1, 5, 5]
    left = D.drop_leaks(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert D.find_leaks(d.limit(0), b).count() == 0 and D.find_leaks(d, b.limit(0)).count() == 0


def test_blocks(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, text(r, 20)) for i in range(30)]
    docs = spark.createDataFrame([(i, "words " + t) for i, t in items], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.find_leaks(docs, b).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, D.find_leaks(docs, b).collect())) == whole and len(whole) >= 30


def test_long_text():
    r = random.Random(4)
    item = text(r, 30)
    t = text(r, 60_000) + " " + item
    assert [h[0] for h in D.Index([(1, D.fold(item))]).hits([D.fold(t)])[0]] == [1]
    assert np.array_equal(D._grams(np.frombuffer(b"abcdefghij", np.uint8)), [int.from_bytes(b"abcdefghij"[k : k + 8], "little") for k in range(3)])


def test_common_words_stay_bounded():
    """Items that share frequent words: what is looked at together stays bounded, and little is aligned."""
    import resource
    import time

    r = random.Random(11)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8)))
    items = [(k, D.fold(f"which of the {word()} of the {word()} {word()} is one of the {word()} of the {word()}")) for k in range(5000)]
    index = D.Index(items)
    texts = [D.fold(" ".join(r.choice(["of the", word(), word(), word(), word()]) for _ in range(700))) for _ in range(4)] + [b"x " + items[7][1] + b" y"]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got = index.hits(texts)
    assert 7 in [h[0] for h in got[-1]] and not any(got[:-1])
    assert time.time() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


@pytest.mark.parametrize("bound", [1, 50, 10**9])
def test_halving_changes_nothing(bound, monkeypatch):
    monkeypatch.setattr(D, "OCCURRENCES", bound)
    r = random.Random(12)
    items = [(k, D.fold("".join(r.choice("abc de") for _ in range(r.randint(3, 60))))) for k in range(40)]
    texts = []
    for _ in range(15):
        t = "".join(r.choice("abc de") for _ in range(r.randint(0, 900)))
        for _, x in r.sample(items, 3):
            x = x.decode()
            k = r.randrange(len(x) + 1)
            t += " " + x[:k] + r.choice(["", "z"]) + x[k:] + " " + "q" * r.randint(0, 300)
        texts.append(D.fold(t))
    got = D.Index(items).hits(texts)
    monkeypatch.setattr(D, "OCCURRENCES", 1 << 20)
    assert got == D.Index(items).hits(texts) and any(got)


def test_drop_leaks_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "nothing of it", 5, "a"), (2, "here is the answer to the question of the day, all of it", 6, "b")], "doc_id long, text string, leaks int, _leaks string")
    items = spark.createDataFrame([(1, "the answer to the question of the day"), (None, None)], "item_id long, text string")
    assert [tuple(r) for r in D.drop_leaks(docs, items).collect()] == [(1, "nothing of it", 5, "a")]


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    docs = spark.createDataFrame([(k, f"some words before question number {k} about the thing {k * 7919} and after") for k in range(12)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"question number {k} about the thing {k * 7919}") for k in range(12)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).where("edits = 0").collect()}
    assert got >= {(k, k) for k in range(12)}
