import math
import random

import numpy as np

from sparkseek.llm import langid as L
from sparkseek.llm.common import held_out


def brute(counts, text):
    """PPM code length, byte by byte, from a dictionary of 5-grams with their counts."""
    tables = []
    for order in range(L.ORDER, -1, -1):
        t = {}
        for g, n in counts.items():
            ctx, s = g[L.ORDER - order : L.ORDER], g[-1]
            t.setdefault(ctx, {}).setdefault(s, 0)
            t[ctx][s] += n
        tables.append((order, t))
    data = b"\n" * L.ORDER + text.lower().encode()
    bits = 0.0
    for i in range(L.ORDER, len(data)):
        for order, t in tables:
            seen = t.get(data[i - order : i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits += math.log2((total + kinds) / seen[data[i]])
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def grams_of(texts):
    out = {}
    for t in texts:
        d = b"\n" * L.ORDER + t.lower().encode()
        for i in range(L.ORDER, len(d)):
            g = d[i - L.ORDER : i + 1]
            out[g] = out.get(g, 0) + 1
    return out


def as_arrays(counts):
    return np.array([int.from_bytes(g, "big") for g in counts], np.uint64), np.array(list(counts.values()))


def words(r, syllables, n):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


ONE, TWO = ["the", "tion", "er", "and", "of"], ["der", "ung", "sch", "ö", "ein"]


def test_code_lengths(monkeypatch):
    r = random.Random(1)
    counts = {"x": grams_of([words(r, ONE, 60)]), "y": grams_of([words(r, TWO, 60)])}
    m = L.Model({k: as_arrays(v) for k, v in counts.items()})
    texts = [words(r, ONE + TWO, 9), "", "zzz日本", words(r, ONE, 30), "a", words(r, TWO, 400)]
    want = [[brute(counts[k], t) for k in ("x", "y")] for t in texts]
    assert np.allclose(m.lengths(texts), want, rtol=1e-5)
    monkeypatch.setattr(L, "PIECE", 64)
    assert np.allclose(m.lengths(texts), want, rtol=1e-5)


def test_predict(spark):
    r = random.Random(2)
    rows = [(i, words(r, ONE if i % 2 else TWO, 30), "en" if i % 2 else "de", None) for i in range(160)]
    rows += [(200, None, "en", None), (201, "", "en", 3), (202, "12 !! 34", None, None), (203, words(r, ONE, 20_000), None, None), (None, "the tion", None, None), (5, "DER UNG", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = L.train(d)
    got = L.predict(d, m).withColumn("h", held_out("doc_id"))
    out = {(x.doc_id, x.text): x for x in got.collect()}
    assert len(out) == len(rows) and m.languages == ["de", "en"]
    held = [x for x in out.values() if x.h and x.lang and x.doc_id < 200]
    assert len(held) > 20 and all(x.lang == x.lang_pred for x in held)
    assert [out[k].lang_pred for k in ((200, None), (201, ""), (202, "12 !! 34"), (5, "DER UNG"))] == ["und", "und", "und", "de"]
    assert out[200, None].score == 0.0 and 0 <= out[5, "DER UNG"].score <= 1
    assert L.train(d.where("lang is null")) is None and L.predict(d.limit(0), m).count() == 0
    assert {x.lang_pred for x in L.predict(d, None).collect()} == {"und"}


def test_all_languages(spark):
    own = lambda k: chr(0x4E00 + 2 * k) + chr(0x4E01 + 2 * k)
    rows = [(i, own(k) * 30, f"l{k:02}") for k in range(70) for i in range(10 * k, 10 * k + 10)]
    rows += [(i, own(70) * 15_000, "long") for i in range(700, 710)]
    m = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == ["l" + f"{k:02}" for k in range(70)] + ["long"]
    assert [m.languages[k] for k in m.lengths([own(k) * 5 for k in range(71)]).argmin(1)] == m.languages
