import random

import pytest

from sparkseek.llm import toxicity as X
from sparkseek.llm.common import held_out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(entries, word):
    best = -1
    for e in entries:
        if e.endswith("*"):
            ok = 0 if word.startswith(e[:-1]) and len(word) > len(e) - 1 else -1
        else:
            d = distance(e, word)
            ok = d if d <= (1 if len(e) >= X.FUZZY_FROM else 0) else -1
        if ok >= 0 and (best < 0 or ok < best):
            best = ok
    return best


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    r = random.Random(seed)
    entries = ["".join(r.choice("abc") for _ in range(r.randint(2, 8))) + r.choice(["", "", "*"]) for _ in range(12)] + ["moron", "scum"]
    a = X.Automaton(entries)
    for _ in range(3000):
        w = "".join(r.choice("abcd") for _ in range(r.randint(0, 10)))
        assert a.match(w) == brute(entries, w), w
    assert [a.match(x) for x in ("moron", "morron", "m0ron", "maroons", "scum", "scun", "")] == [0, 1, 1, -1, 0, -1, -1]


def test_windows():
    s = X.Scorer(["moron", "idiot"])
    plain, quoted, said, you = (s.features(t)[0] for t in ("what a moron here", 'he wrote down "what a moron" here', "they said moron to us", "you moron there"))
    assert you > plain > said and quoted < plain
    assert s.features("clean words")[0] == 0 and s.features("")[4] == 0 and s.features("morron")[2] > 0


def test_learning(spark):
    r = random.Random(4)
    words = ["the", "tion", "ering", "ounds", "hesta"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [r.choice(words) for _ in range(20)]
        if bad:
            w[r.randrange(20)] = r.choice(["moron", "grobly" + r.choice(words), "idiot"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad if r.random() > 0.03 else not bad)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "what a morron", "x"), (903, " ".join(words) * 3000, "x"), (902, "what a morron", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    m = X.train(docs, lab)
    assert {"moron", "idiot"} <= set(m[0]) and any(e.startswith("gro") for e in m[0])
    got = X.score(docs, m).withColumn("h", held_out("doc_id")).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    held = [x for x in got if x.h and x.doc_id < 400]
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) / len(held) > 0.97
    assert X.train(docs, lab.limit(0)) is None and {x.score for x in X.score(docs, None).collect()} == {0.0}
    assert X.score(docs.limit(0), m).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_stems(seed):
    r = random.Random(seed)
    entries = ["".join(r.choice("abc") for _ in range(r.randint(3, 7))) + r.choice(["", "*", "*"]) for _ in range(8)]
    a = X.Automaton(entries, fuzzy_stems=True)

    def stems(w):
        near = [min(distance(e[:-1], w[:k]) for k in range(len(w))) for e in entries if e.endswith("*") and len(e) > X.FUZZY_FROM and w]
        return min((d for d in near if d <= 1), default=-1)

    for _ in range(2000):
        w = "".join(r.choice("abcd") for _ in range(r.randint(0, 10)))
        assert a.match(w) == min((d for d in (brute(entries, w), stems(w)) if d >= 0), default=-1), w
    assert [X.Scorer(["grobl*"]).features(w)[2] > 0 for w in ("groblering", "grxblering", "groobleering", "gxxblering")] == [False, True, True, False]
