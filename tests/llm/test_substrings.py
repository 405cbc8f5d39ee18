import hashlib
import random

import numpy as np
import pytest

from sparkseek.llm import substrings as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - S.LENGTH + 1):
            s = d[i : i + S.LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - S.LENGTH + 1):
            if seen[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = True
        kept = bytes(x for x, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), len(S._runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_suffix_order(seed):
    r = random.Random(seed)
    stretches = ["".join(r.choice("ab\0é") for _ in range(r.randint(1, 60))).encode() for _ in range(8)] + [b"aaaa", b"bbbbba", b"\0\0", b"\xff\xff"]
    raw = b"\0".join(stretches) + b"\0"
    size = np.array([len(s) for s in stretches])
    begin = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    text[begin + size] = 0
    end = np.repeat(begin + size, size + 1)
    order = S.suffix_order(np.append(text, np.int16(1)), raw, np.arange(len(raw)), end)
    keys = [raw[i : end[i]] for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(raw)))


def words(r, n):
    return " ".join("".join(r.choice(["th", "er", "on", "é", "an"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    shared = [words(r, k) for k in (60, 90, 200)] + ["x" * 900, "ab" * 400, "line\n" * 120]
    texts = [None, "", "short", words(r, 300), words(r, 300)]
    for _ in range(25):
        parts = []
        for _ in range(r.randint(1, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 3)
            parts += [words(r, r.randint(0, 40)), s[a : len(s) - r.randint(0, len(s) // 3)]]
        texts.append(" ".join(parts))
    return [*texts, texts[-1], texts[-1], texts[7], "y" * 400, "y" * 399, "z" * 401, words(r, 3000) + shared[2]]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [2048, 3])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "PIECE", 20_000)
    texts = corpus(seed)
    got = S.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts)
    for r in got:
        if r.kept is not None:
            assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_long_text_in_pieces(monkeypatch):
    r = random.Random(1)
    data = words(r, 2500).encode()
    whole = S.anchors(data)
    monkeypatch.setattr(S, "_PLACE_BITS", 11)
    got = S.anchors(data)
    # Every start has one anchor, whatever the pieces; hashes are of the same bytes.
    for h, p, a, z in (whole, got):
        assert (np.concatenate([np.arange(i, j + 1) for i, j in zip(a, z, strict=True)]) == np.arange(len(data) - S.LENGTH + 1)).all()
        assert ((p >= z) & (p - a <= S.LENGTH - S.GRAM) | (p >= a)).all()


def test_no_rows_and_odd_ids(spark):
    d = spark.createDataFrame([], "doc_id long, text string, key string")
    assert S.remove_repeats(d).count() == 0
    t = "some text " * 80
    rows = [(None, t, "k"), (None, t, "k"), (5, t + "!", "k"), (5, "other", None)]
    got = sorted(((r.doc_id or 0, r.n_removed) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()))
    assert got == [(0, 800), (0, 800), (5, 0), (5, 800)]


def test_shared_passages_are_reported(spark):
    """Passages of 50 words or more that are too short to be removed; copies share all they have."""
    r = random.Random(5)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(n))
    passage, longer = fresh(50), fresh(4) + " " + "w" * 40 + " " + fresh(45) + " é x"
    assert len(passage) < S.LENGTH and len(longer) < S.LENGTH
    texts = [f"{fresh(120)} {passage} {fresh(30)}", f"{fresh(7)}\n{passage}", f"{passage.replace(' ', chr(10), 9)} {fresh(80)}", f"{fresh(60)} {longer}", f"{longer}  {fresh(2)}"]
    alone = [fresh(400), fresh(30), passage.rsplit(" ", 1)[0], "", None, f"{fresh(90)} {' '.join(passage.split()[:15])} {fresh(90)}"]
    rows = [*texts, *alone, alone[0] + " end", "copy " + fresh(60), fresh(70)]
    rows += [rows[-1], "few words", "few words"]
    got = {x.doc_id: x for x in S.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[k].n_removed == 0 < got[k].n_shared for k in range(5))
    assert all(got[k].n_shared == 0 for k in (6, 7, 8, 9, 10, 12, 15, 16))
    assert got[5].n_shared and got[11].n_shared and got[13].n_shared == got[14].n_shared == len(S.passages(rows[13].encode()))


@pytest.mark.parametrize("seed", range(5))
def test_shared_words_share_a_run(seed):
    r = random.Random(seed)
    texts = [[r.choice(["a", "bc", "é", "longerthan8", "x" * 17, "yz"]) for _ in range(r.randint(40, 200))] for _ in range(12)]
    for k in range(1, 12, 2):
        texts[k][10:10] = texts[k - 1][5 : 5 + 35 + 5 * k]
    found = [set(S.passages("\n ".join(t).encode()).tolist()) for t in texts]
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    for a in range(12):
        for b in range(a):
            assert found[a] & found[b] or not grams(texts[a], S.WORDS) & grams(texts[b], S.WORDS)
            assert grams(texts[a], S.RUN) & grams(texts[b], S.RUN) or not found[a] & found[b]
