import hashlib
import math

import numpy as np
import pytest

from sparkseek.llm import pq

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """The same by full comparison with Python integers; rows: vec_id, integers."""
    w = len(rows[0][1]) // parts
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    books = [[r[1][p * w : (p + 1) * w] for r in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for k in range(rounds + 1):
        got = [[nearest(r[1][p * w : (p + 1) * w], books[p]) for p in range(parts)] for r in rows]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [r[1][p * w : (p + 1) * w] for r, g in zip(rows, got, strict=True) if g[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [([e for _, e in g], sum(d for d, _ in g)) for g in got], books


def test_against_full_comparison(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    vectors = [(middles[rng.integers(12)] + rng.normal(size=8) * 0.2).astype(np.float32).tolist() for _ in range(180)]
    rows = [(1000 - 3 * i, v, i % 3 if i % 7 else None) for i, v in enumerate(vectors)]
    rows += [rows[5], rows[5], (rows[6][0], vectors[7], 1), (None, vectors[8], 1)] + [(5000 + i, vectors[9], 2) for i in range(60)]
    bad = [(1, None, 0), (2, [*vectors[0][:7], None], 0), (3, [*vectors[0][:7], math.nan], 0), (4, [*vectors[0][:7], math.inf], 0), (-5, [-math.inf] * 8, 1)]
    odd = [(99_999, vectors[0][:7], 0), (99_998, [], None), (99_997, vectors[0] + vectors[1], 0), (99_996, [3e38] * 8, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad + odd], SCHEMA + ", V string").repartition(5)
    coded, books = pq.compress(df, parts=4, entries=16, rounds=4)
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows]
    want, want_books = plain(ints, 4, 16, 4)
    assert [b.tolist() for b in books] == want_books
    none = lambda x: -1 if x is None else x
    got = sorted((none(r.vec_id), none(r.label), list(r.code), r.error) for r in coded.where("code is not null").collect())
    assert got == sorted((none(r[0]), none(r[2]), c, d) for r, (c, d) in zip(rows, want, strict=True))
    assert sorted(r.vec_id for r in coded.where("code is null and error is null").collect()) == sorted(r[0] for r in odd)
    assert pq.codebooks_sha256(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("size", [3, 1 << 12, 1 << 26])
def test_search_is_exact_and_short(size):
    rng = np.random.default_rng(size)
    c = rng.integers(-size, size, (64, 4))
    c[40], c[41] = c[3], c[3]  # the lower index has to win
    x = np.concatenate([c[rng.integers(64, size=300)] + rng.integers(-max(1, size // 50), max(2, size // 50), (300, 4)), rng.integers(-size, size, (50, 4))])
    every = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
    lists = pq.Entries(c)
    for start in (None, rng.integers(64, size=len(x)), every.argmin(1).astype(int)):
        entry, distance, looked = lists.nearest(x, start)
        assert entry.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()
    assert size == 3 or looked < 0.5 * every.size  # started at the right entry
    assert lists.nearest(x[:0])[0].tolist() == []


def test_small_tables(spark):
    assert pq.compress(spark.createDataFrame([], SCHEMA))[0].count() == 0
    coded, books = pq.compress(spark.createDataFrame([(None, [1.0] * 4, 1), (None, None, 1)], SCHEMA))
    assert [(r.vec_id, r.code) for r in coded.collect()] == [(None, None)] and books == []
    coded, books = pq.compress(spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.5] * 4, None)], SCHEMA))
    assert sorted((r.vec_id, list(r.code), r.error) for r in coded.collect()) == [(1, [0] * 4, 0), (2, [0] * 4, 0)] and [len(b) for b in books] == [2] * 4


def test_query(spark, tmp_path):
    rows = [(i, [float(i % 3)] * 8, None if i % 2 else 4) for i in range(20)] + [(30, [0.25] * 8, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = pq.op11_pq(spark, str(tmp_path)).collect()
    assert len(got) == 21 and len({r.codebooks_sha256 for r in got}) == 1 and all(len(r.code) == 8 for r in got)
    assert {r.label_error for r in got if r.vec_id % 2 or r.vec_id == 30} == {sum(r.error for r in got if r.vec_id % 2 or r.vec_id == 30)}
