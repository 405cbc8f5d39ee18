"""The store as a log: what a commit writes, merging, splitting, and readers in between."""

import os
import random

import pytest

from sparkseek.operators import lexical
from sparkseek.operators.store import DEPTH, Store, bucket_code, to_merge
from sparkseek.schemas import CHUNK, FILE

from pyspark.sql import functions as F


def rows(spark, items):
    """items: path, ordinal, content."""
    return spark.createDataFrame([(f"{p}#{o}", p, o, c, None, ("line_range", 1, 1, ""), False) for p, o, c in items], CHUNK)


def held(s):
    return sorted((r.path, r.ordinal, r.content) for r in s.table("chunks").collect())


def written(folder, before=frozenset()):
    """Bytes of data files that weren't there before, and the names of all."""
    now = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}
    return sum(os.path.getsize(f) for f in now - before), now


def check_postings(spark, s):
    """Searches by the stored postings give what the chunks themselves give."""
    q = spark.createDataFrame([(1, "common word3", ""), (2, "new", "/a")], "query_id int, query string, scope string")
    got = {(r.query_id, r.id): round(r.score, 9) for r in lexical.bm25_stored(q, *s.postings()).collect()}
    assert got == {(r.query_id, r.id): round(r.score, 9) for r in lexical.bm25(q, s.table("chunks")).collect()}
    n, avgdl = s.postings()[1].first()
    own = lexical.corpus_stats(s.table("chunks")).first()
    assert (n, round(avgdl, 9)) == (own.n, round(own.avgdl or 0.0, 9))


def test_which_are_merged():
    assert to_merge([5, 1, 1], 4) == []
    assert to_merge([100, 1, 1, 1], 4) == [1, 2, 3]
    assert sorted(to_merge([4, 1, 1, 2], 4)) == [0, 1, 2, 3]
    sizes, moved = [], 0
    for _ in range(2000):
        sizes.append(1)
        if pick := to_merge(sizes, 8):
            moved += sum(sizes[k] for k in pick)
            sizes = [x for k, x in enumerate(sizes) if k not in pick] + [sum(sizes[k] for k in pick)]
        assert len(sizes) < 24
    assert moved < 2000 * 11  # each row about as often as the logarithm of all


def test_a_small_commit_writes_little(spark, tmp_path):
    """What is written for one file does not depend on how many there are."""
    took = []
    for n in (200, 4000):
        s = Store(spark, str(tmp_path / str(n)))
        rng = random.Random(n)
        text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
        s.commit(chunks=rows(spark, [(f"/a/{k}", 0, text()) for k in range(n)]), files=spark.createDataFrame([(f"/a/{k}", 1, 1, "h", [f"/a/{k}#0"], False) for k in range(n)], FILE))
        before = written(s.folder)[1]
        one = spark.createDataFrame([("/a/7",)], "path string")
        s.commit({"chunks": one, "files": one}, chunks=rows(spark, [("/a/7", 0, "new text of one file")]), files=spark.createDataFrame([("/a/7", 2, 2, "g", ["/a/7#0"], False)], FILE))
        took.append(written(s.folder, before)[0])
        assert s.table("chunks").count() == n == s.table("files").count()
        assert s.table("files").where("path = '/a/7'").first().hash == "g"
    assert max(took) < 40_000 and took[1] < 1.2 * took[0]


def test_any_course_of_commits(spark, tmp_path):
    """Adds, changes, removals and returns, with merges and splits on the way, against a dictionary."""
    s = Store(spark, str(tmp_path / "s"), fanout=3, bucket_rows=6)
    rng, want = random.Random(5), {}
    for step in range(9):
        put = {f"/a/{rng.randrange(80)}": [f"common word{rng.randrange(5)} {step}" for _ in range(rng.randrange(1, 4))] for _ in range(20)}
        drop = set(rng.sample(sorted(want), min(len(want), 8))) if step % 2 else set()
        for p in drop | set(put):
            want.pop(p, None)
        want |= put
        gone = spark.createDataFrame([(p,) for p in sorted(drop | set(put))], "path string")
        s.commit({"chunks": gone}, chunks=rows(spark, [(p, o, c) for p, own in put.items() for o, c in enumerate(own)]))
        assert held(s) == sorted((p, o, c) for p, own in want.items() for o, c in enumerate(own)), step
    check_postings(spark, s)
    now = s._pointer()[1]
    assert now["chunks_split"] and len(now["chunks"]) > 1 << DEPTH
    s.compact()
    after = s._pointer()[1]
    assert held(s) == sorted((p, o, c) for p, own in want.items() for o, c in enumerate(own))
    assert all(len(own) == 1 for own in after["chunks"].values()) and not any(after["chunks_gone"].values())
    check_postings(spark, s)
    files = len(written(s.folder)[1])
    s.vacuum(keep=1)
    assert len(written(s.folder)[1]) < files / 2
    check_postings(spark, s)
    # every row lies in the bucket that its path has
    split = after["chunks_split"]
    for b, own in after["chunks"].items():
        assert s._read([x[0] for x in own], s._schema("chunks")).where(bucket_code(F.col("path"), split) != int(b)).isEmpty()


def test_one_path_is_not_split_for_ever(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), bucket_rows=4)
    s.commit(chunks=rows(spark, [("/a/one", k, f"common {k}") for k in range(20)]))
    now = s._pointer()[1]
    assert len(now["chunks"]) == 1 and now["chunks_unsplit"] == [int(b) for b in now["chunks"]]
    before = written(s.folder)[1]
    s.add(rows(spark, [("/a/two", 0, "new")]))
    assert s.table("chunks").count() == 21 and written(s.folder, before)[0] < 20_000


def test_wide_postings(spark, tmp_path, monkeypatch):
    """Postings of large commits lie by buckets of terms, those of small ones flat; both are read together."""
    from sparkseek.operators import store

    monkeypatch.setattr(store, "WIDE", 30)
    s = Store(spark, str(tmp_path / "s"))
    s.add(rows(spark, [(f"/a/{k}", 0, f"common word{k} and others") for k in range(20)]))
    s.add(rows(spark, [("/a/3", 0, "common new")]))
    assert {x[2].split("/")[1] for own in s._pointer()[1]["chunks"].values() for x in own} == {"wide", "flat"}
    check_postings(spark, s)
    s.vacuum(keep=1)
    check_postings(spark, s)


@pytest.mark.parametrize("what", ["empty", "again"])
def test_edges(spark, tmp_path, what):
    s = Store(spark, str(tmp_path / "s"))
    if what == "empty":
        s.commit(chunks=rows(spark, []))
        assert s.exists() and held(s) == [] and s.postings()[0].isEmpty() and s.postings()[1].first().n == 0
        s.compact()
        s.delete(ids=["x"])
        assert held(s) == []
    else:  # a removed row comes back, and goes again
        for k in range(3):
            s.add(rows(spark, [("/a/x", 0, f"text {k}")]))
            assert held(s) == [("/a/x", 0, f"text {k}")]
            s.delete(where={"path": "/a/x"})
            assert held(s) == [] and s.postings()[1].first().n == 0
