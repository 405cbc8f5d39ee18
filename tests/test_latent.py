import random

import numpy as np
import pytest

from sparkseek.engine import Engine
from sparkseek.operators import latent
from sparkseek.operators.embed import HashingEmbedder, embed_chunks, embed_queries
from sparkseek.operators.vector import vector_arm

TOPICS, WORDS = 6, 24


def word(topic, k):
    return f"t{topic}w{k}"


def corpus(seed, n):
    """Texts of a topic share few words with each other, and all share some without meaning."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        topic = k % TOPICS
        said = [word(topic, r.randrange(WORDS)) for _ in range(5)] + [f"common{r.randrange(40)}" for _ in range(8)]
        r.shuffle(said)
        out.append((f"c{k:04d}", f"/t{topic}/{k}", " ".join(said)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, path string, content string")


def dense(texts, features):
    a = np.zeros((len(texts), features))
    for k, t in enumerate(texts):
        for f, n in latent.counted(t, features).items():
            a[k, f] = 1 + np.log(n)
    df = (a > 0).sum(0)
    idf = np.where(df > 0, np.log(((a > 0).any(1).sum() + 1) / np.maximum(df, 1)), 0)
    a *= idf
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n > 0, n, 1), idf


@pytest.mark.parametrize("entries", [50, 1 << 16])
def test_singular_vectors(spark, monkeypatch, entries):
    monkeypatch.setattr(latent, "ENTRIES", entries)
    rows = [*corpus(1, 240), ("e", "/e", ""), ("n", "/n", None), ("l", "/l", " ".join(word(k % 6, k % 20) for k in range(3000)))]
    m = latent.learn(frame(spark, rows).repartition(5), dim=5, passes=12, features=512)
    a, idf = dense([t for _, _, t in rows], 512)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(m.idf, idf) and m.dim == 5
    assert np.allclose(np.linalg.norm(a @ m.vectors, axis=0), s[:5], rtol=1e-4)
    assert np.allclose(m.vectors @ m.vectors.T, vt[:5].T @ vt[:5], atol=5e-3)
    want = a @ vt[:5].T
    n = np.linalg.norm(want, axis=1)
    got = m.embed([t or "" for _, _, t in rows])
    assert np.allclose(got[n > 0] @ got[n > 0].T, (want / np.where(n > 0, n, 1)[:, None])[n > 0] @ (want / np.where(n > 0, n, 1)[:, None])[n > 0].T, atol=2e-2)


def test_recall(spark):
    """Texts of one topic near the front, where the texts share no word of meaning with the query."""
    rows = corpus(2, 600)
    queries = [(k, f"{word(t, a)} {word(t, (a + 7) % WORDS)}", "") for k, (t, a) in enumerate((t, a) for t in range(TOPICS) for a in range(0, WORDS, 3))]
    said = {k: set(q.split()) for k, q, _ in queries}
    content = {i: set(c.split()) for i, _, c in rows}
    recall = {}
    for name, e in (("hashing", HashingEmbedder()), ("latent", latent.learn(frame(spark, rows), dim=8))):
        own = embed_chunks(frame(spark, rows), e)
        q = embed_queries(spark.createDataFrame(queries, "query_id int, query string, scope string"), e)
        hits = {}
        for r in vector_arm(q, own, len(rows)).collect():
            if not said[r.query_id] & content[r.id]:
                hits.setdefault(r.query_id, []).append((r["rank"], r.path))
        topic = {k: k // (WORDS // 3) for k, _, _ in queries}
        recall[name] = np.mean([np.mean([p.startswith(f"/t{topic[k]}/") for _, p in sorted(h)[:3]]) for k, h in hits.items()])
        assert len(hits) == len(queries)
    assert recall["latent"] > 0.9 and recall["latent"] > recall["hashing"] + 0.3, recall


def test_small_and_stored(spark, tmp_path):
    none = latent.learn(frame(spark, []), dim=4, features=64)
    assert not none.embed(["a b", ""]).any() and none.dim == 4
    empty = latent.learn(frame(spark, [("a", "/a", None), ("b", "/b", "")]), dim=4, features=64)
    assert not empty.embed(["a"]).any()
    few = latent.learn(frame(spark, [("a", "/a", "one two"), ("b", "/b", "three"), ("b", "/b", "three")]), dim=4, features=64)
    assert not few.vectors[:, 2:].any() and not few.embed(["unseen"]).any()
    m = latent.learn(frame(spark, corpus(3, 60)), features=256)
    m.table(spark).write.parquet(str(tmp_path / "m"))
    again = latent.from_table(spark.read.parquet(str(tmp_path / "m")), m.name)
    texts = ["t0w1 t0w2 common3", "search_query: t1w1", ""]
    assert np.array_equal(again.embed(texts), m.embed(texts)) and np.allclose(np.linalg.norm(m.embed(texts[:2]), axis=1), 1)
    assert m.name == latent.learn(frame(spark, corpus(3, 60)).repartition(3), features=256).name != few.name


def test_in_the_engine(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k, (_, _, text) in enumerate(corpus(4, 24)):
        (tmp_path / "d" / f"f{k}.txt").write_text(text)
    e = Engine(spark, str(tmp_path / "store"), latent.learn(frame(spark, corpus(4, 24)), dim=6))
    assert e.index([str(tmp_path / "d")])["added"] == 24
    assert e.embedder.name.startswith("latent-6-")
    want = {k for k, (_, _, text) in enumerate(corpus(4, 24)) if word(2, 3) in text.split()}
    found = {int(r.path.rsplit("/f")[-1].removesuffix(".txt")) for r in e.locate(word(2, 3)).collect()}
    assert found >= want and found - want  # by its vector, texts that do not hold the word as well


def rows_of(b):
    return [list(zip(f, n, strict=True)) for f, n in zip(b.column("features").to_pylist(), b.column("counts").to_pylist(), strict=True)]


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_features_of_many_texts(monkeypatch, size):
    """Cut, hashed and counted as arrays: the same as by one term after the other."""
    monkeypatch.setattr(latent, "BYTES", size)
    r = random.Random(9)
    letters = "aAbZ09_-éßİΣ中\U0001f600\ud800 ./(\"\n\t\x0b\x1c\x85    　"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(120))) for _ in range(300)]
    texts += [None, "", " ", "x" * 47, "x" * 48, "x" * 49 + " y", "é" * 200 + "/" + "b" * 500, "a " * 70_000, " /.a", "A a"]
    for features in (7, 1 << 15):
        assert rows_of(latent._lists(texts, features)) == [sorted(latent.counted(t, features).items()) for t in texts]
    assert latent._lists([], 7).num_rows == 0


def test_texts_are_cut_once(spark):
    """The embeddings of the chunks come from what the embedder was learnt from."""
    rows = [*corpus(5, 120), ("e", "/e", ""), ("n", "/n", None), ("d", "/d", "... //"), ("l", "/l", " ".join(word(k % 6, k % 20) for k in range(3000)))]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = frame(spark, rows).repartition(3)
    m, own = latent.learnt(df.mapInArrow(seen, df.schema), dim=6, features=256)
    got = {r.id: r for r in own.collect()}
    assert read.value == len(rows) and own.columns == ["id", "path", "embedding"] and got["l"].path == "/l"
    want = m.embed([t or "" for _, _, t in rows])
    assert all(np.allclose(got[i].embedding, v, atol=1e-6) for (i, _, _), v in zip(rows, want, strict=True)) and not np.any(got["d"].embedding)
    assert np.allclose(m.vectors, latent.learn(df, dim=6, features=256).vectors, atol=1e-5)


def test_few_tasks_multiply_little(spark, monkeypatch):
    """What a pass shuffles doesn't grow with the number of partitions: the sums of a task are as large however few rows it has."""
    tasks = []
    real = latent._multiplied
    monkeypatch.setattr(latent, "_multiplied", lambda rows, *a: (tasks.append(rows.rdd.getNumPartitions()), real(rows, *a))[1])
    df = frame(spark, corpus(6, 120)).repartition(30)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        m = latent.learn(df, dim=4, features=256)
        monkeypatch.setattr(latent, "LEAST", 100)
        again = latent.learn(df, dim=4, features=256)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks == [1] * 4 + [12] * 4 and np.allclose(m.vectors, again.vectors, atol=1e-5) and m.name == again.name
