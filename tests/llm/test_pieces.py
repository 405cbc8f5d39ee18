import random

import numpy as np
import pytest

from sparkseek.llm import pieces as P

LONG = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def m():
    return P.model(P.TOKENIZERS, P.MODEL)


@pytest.fixture(scope="module")
def library():
    import os

    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(P.TOKENIZERS, P.MODEL))


def text(r, n):
    kinds = ["the", "tion", "an", "er", " ", "  ", "\n", "é", "ß", "日", "本語", "𓀀", "\t", "0", "12", "----", "====", "a", "s", ".", "\x00", "<s>", "ing"]
    return "".join(r.choice(kinds) for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_same_as_library(m, library, seed):
    t = text(random.Random(seed), seed * 3)
    ids = m.encode_free(P.normalised(t))
    assert ids == library.encode(t)
    assert m.decode(ids) == t


def by_chunks(m, t, size):
    s = P.normalised(t)
    cuts = [*range(0, len(s), size), len(s)]
    states = P.cut_states([m.matrix(s, a, z) for a, z in zip(cuts, cuts[1:], strict=False)])
    return [i for a, z, x, y in zip(cuts, cuts[1:], states, states[1:], strict=False) for i in m.trace(s, x, y, a, z)]


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("size", [1, 5, 17, 40])
def test_chunks(m, library, seed, size):
    r = random.Random(seed)
    t = text(r, 60) if seed % 2 else "".join(r.choice(["tion", "ing", "er", "a", "th", "est", "=", "日本"]) for _ in range(60))
    assert by_chunks(m, t, size) == library.encode(t)


def test_scan_is_associative(m):
    s = P.normalised("internationalisationofthewholething" * 5)
    cuts = list(range(0, len(s), 13)) + [len(s)]
    ms = [m.matrix(s, a, z) for a, z in zip(cuts, cuts[1:], strict=False)]
    one = ms[0]
    for k, x in enumerate(ms[1:], 1):
        one = P.multiply(one, x)
        assert P.scan(ms)[k] == one
    assert P.multiply(ms[0], P.multiply(ms[1], ms[2])) == P.multiply(P.multiply(ms[0], ms[1]), ms[2])


def test_columns(spark, library, monkeypatch):
    monkeypatch.setattr(P, "PART", 50)
    monkeypatch.setattr(P, "CHUNK", 20)
    r = random.Random(9)
    texts = [None, "", " ", "a", "  two  spaces ", "tion" * 400, text(r, 300), text(r, 300), "=" * 999, " " * 333, "x " * 200, "日" * 120]
    texts += [texts[6], texts[6]]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    got = {x.doc_id: x for x in P.decode(P.encode(d)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == (None if t is None else library.encode(t)) and got[i].decoded == t
    both = P.encode(d, decoded="decoded")
    assert sorted(map(repr, both.collect())) == sorted(map(repr, P.decode(P.encode(d)).select(*both.columns).collect()))
    assert P.encode(d.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 16, 50])
def test_batches_by_chunks(m, library, size, monkeypatch):
    """Whole texts go through matrices, scan and backtrace, however small the chunks; words longer than several chunks, too."""
    monkeypatch.setattr(P, "CHUNK", size)
    r = random.Random(size)
    texts = [None, "", "a", *(text(r, 80) for _ in range(20)), "internationalisationofthewholething" * 4, LONG * 9 + " " + "=" * 70 + "\n" + "日本" * 30]
    got = m.encode_batch(texts)
    assert got[0] is None and [x.tolist() for x in got[1:]] == [library.encode(t) for t in texts[1:]]


def test_words_are_forgotten(m, library, monkeypatch):
    monkeypatch.setattr(P, "WORDS", 20)
    monkeypatch.setattr(P, "CUTS", 5)
    monkeypatch.setattr(P, "CHUNK", 7)
    r = random.Random(3)
    for _ in range(30):
        t = " ".join("".join(r.choice("etaoin") for _ in range(r.randint(1, 9))) for _ in range(40))
        assert m.encode_batch([t])[0].tolist() == library.encode(t)


def test_documents_have_several_chunks(m, monkeypatch):
    """On the driver's table most texts are cut, so that the scan decides between states."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    scans, inner = [], P.cut_states
    monkeypatch.setattr(P, "cut_states", lambda x: scans.append(len(x)) or inner(x))
    m.encode_batch(texts)
    assert sum(scans) + len(texts) - len(scans) == sum(max(1, -(-len(P.normalised(t)) // P.CHUNK)) for t in texts)
    assert len(scans) > len(texts) / 2 and sum(scans) > 1.8 * len(texts)


def test_pairs_by_how_pieces_are_built(m, monkeypatch):
    """As BPE by its definition, which is not run over the text of each pair."""
    r = random.Random(5)
    ids = sorted(m.piece)
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(10_000)]
    for i in r.sample(ids, 4_000):
        s = m.piece[i]
        pairs += [(m.id[s[:k]], m.id[s[k:]]) for k in range(1, len(s)) if s[:k] in m.id and s[k:] in m.id]
        pairs += [(m.id[s[:k]], r.choice(ids)) for k in range(1, len(s)) if s[:k] in m.id]
    want = [m.merges(m.piece[i] + m.piece[j]) == [m.piece[i], m.piece[j]] for i, j in pairs]
    assert 0.05 < sum(want) / len(want) < 0.95
    m._pairs.clear()
    monkeypatch.setattr(m, "merges", None)
    assert [m.pair(i, j) for i, j in pairs] == want


def test_texts_of_many(m):
    r = random.Random(2)
    for texts in ([], [None], [""], [None, "", " ", "a", "  b", "日本 𓀀", *(text(r, 50) for _ in range(20)), None, ""]):
        got = m.texts(m.encode_batch(texts))
        got.validate(full=True)
        assert got.to_pylist() == texts
    some = [m.encode_batch(["a b"])[0], np.array([m.id["a"], m.id["b"]], np.int32)]
    assert m.texts(some).to_pylist() == [m.decode(x.tolist()) for x in some]
