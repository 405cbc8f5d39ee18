import os

import pytest
from pyspark.sql import functions as F

from sparkseek.engine import Engine, IdentityError
from sparkseek.operators.embed import HashingEmbedder


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "docs").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "docs" / "parser.md").write_text("# Parser\n\nThe parser reads tokens and builds a tree. It stops at errors.\n")
    (root / "docs" / "cache.md").write_text("# Cache\n\nEntries expire after an hour of idleness. Eviction is by age.\n")
    (root / "main.py").write_text("import os\n\ndef start_server(port):\n    return port\n\ndef stop_server():\n    pass\n")
    (root / "conf.yaml").write_text("server:\n  port: 80\ncache:\n  size: 3\n")
    (root / ".env").write_text("SECRET=1\n")
    (root / ".git" / "x.txt").write_text("never\n")
    (root / "bad.txt").write_bytes(b"a\x00b")
    return root


def test_life_of_an_index(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.index([str(tree)], dry_run=True)["would_index"] == sorted(str(tree / x) for x in ("conf.yaml", "docs/cache.md", "docs/parser.md", "main.py"))
    first = e.index([str(tree)])
    assert (first["added"], first["indexed"], first["updated"]) == (4, 4, 0) and first["chunks"] == 2 + 3 + 2
    again = e.sync()
    assert (again["unchanged"], again["indexed"], again["removed"]) == (4, 0, 0)
    rows = e.locate("eviction idleness").where("class = 'strong'").orderBy("rank").collect()
    assert rows[0].path == str(tree / "docs/cache.md")
    assert e.locate("eviction idleness", scope=str(tree / "nowhere")).where("class = 'strong'").count() == 0
    x = e.excerpt("start_server port").where("rank = 1").collect()[0]
    assert x.path == str(tree / "main.py") and "def start_server" in x.text and x.rendered.startswith(f"{tree}/main.py:")
    os.remove(tree / "docs" / "cache.md")
    (tree / "docs" / "parser.md").write_text("# Parser\n\nRewritten for zebras and other animals of the savanna, in short.\n")
    third = e.sync()
    assert (third["removed"], third["updated"], third["unchanged"]) == (1, 1, 2)
    assert e.locate("zebras").collect()[0].path == str(tree / "docs/parser.md")
    s = e.status()
    assert s["files"] == 3 and s["roots"] == [{"root": str(tree), "chunks": s["chunks"]}] and s["identity"]["dim"] == 64
    got = e.read(str(tree / "main.py") + ":3-4")
    assert got["lines"] == ["def start_server(port):", "    return port"] and (got["start"], got["end"]) == (3, 4)
    assert e.read(str(tree / ".env")) is None
    assert [r.name for r in e.list_dir(str(tree)).collect()][:2] == [".git", "docs"]
    with pytest.raises(IdentityError):
        Engine(spark, str(tmp_path / "store"), HashingEmbedder(32)).sync()
    assert Engine(spark, str(tmp_path / "store"), HashingEmbedder(32)).reindex()["indexed"] == 3


def test_unreadable_root_keeps_its_files(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.index([str(tree)])
    os.rename(tree, str(tree) + "-away")
    r = e.sync()
    assert r["removed"] == 0 and e.status()["files"] == 4 and r["quarantined"] == 1


def test_transient_roots_expire(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.index([str(tree)], transient=True)
    e.config["transient"]["retention_days"] = -1
    assert e.sync([])["removed"] == 4 and e.status()["files"] == 0 and e.roots() == []


def test_eval(spark, tree, tmp_path):
    cases = tmp_path / "cases.jsonl"
    cases.write_text('# note\n{"query": "parser tokens tree", "expect_path": "parser.md", "expected_text": "builds a tree"}\n{"query": "start_server", "expect_path": "main.py", "scope": "docs"}\n')
    m = Engine(spark, str(tmp_path / "store")).eval_locate(str(cases), str(tree)).first()
    assert (m.n, m.recall_1, m.excerpt_accuracy, m.scoped_recall_1) == (2, 100.0, 100.0, 50.0)
    said = tmp_path / "said.jsonl"
    said.write_text('{"input": "open a.py", "expected": {"action": "open", "path": "a.py"}, "tier": 1}\n')
    assert Engine(spark, str(tmp_path / "store")).eval_intent(str(said)).first().param_accuracy == 100.0


def test_streaming(spark, tmp_path):
    from sparkseek.streaming.ingest import event_counts, ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One file that arrives. " * 9)
    got = []
    add = lambda df: got.extend(r.path for r in df.collect())
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "ck"), add)
    (tmp_path / "in" / "b.txt").write_text("Another one. " * 9)
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "ck"), add)
    assert [os.path.basename(p) for p in got] == ["a.txt", "b.txt"]
    e = spark.sql("select timestamp'2024-01-01 00:05:00' ts, 'x' event_type, 2.0D value union all select timestamp'2024-01-01 00:07:00', 'x', 3.0D")
    assert event_counts(e).first().n == 2


def test_search_without_embedder(spark, tree, tmp_path):
    """Strong lexical results need no embedder; where it is asked for and fails, the lexical results stay."""
    e = Engine(spark, str(tmp_path / "store"))
    e.index([str(tree)])
    asked = []

    def broken(q):
        asked.append(q)
        raise OSError("no embedder")

    e.cache.get = broken
    assert e.locate("eviction idleness").where("class = 'strong'").count() and asked == []
    with pytest.warns(UserWarning, match="lexical results only"):
        assert e.locate("zz-nothing-like-it").count() == 0
    assert len(asked) == 1
    with pytest.warns(UserWarning):
        assert e.search(e.queries("eviction idleness"), use_vector=True).where("class = 'strong'").count()


def test_search_renews_transient_roots(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.index([str(tree)], transient=True)
    roots = e.store.table("roots").withColumn("last_access", F.lit(5).cast("long"))
    e.store.commit(roots=roots)
    e.locate("eviction")
    assert e.store.table("roots").first().last_access == 5
    e.locate("eviction", scope=str(tree / "docs"))
    assert e.store.table("roots").first().last_access > 5


def test_actions_and_payloads(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.index([str(tree)])
    got = e.payload("eviction idleness")
    assert got["code"] == 0 and got["results"][0]["path"] == str(tree / "docs/cache.md")
    none = e.payload("zz-nothing", scope=str(tree / "docs" / "none"))
    assert none["code"] == 2 and not none["results"] and "message" in none
    assert not e.stale() and e.reconcile() is None
    (tree / "new.md").write_text("# New\n\nA file that has just come into being, with words of its own.\n")
    assert e.stale() and e.reconcile()["added"] == 1
    done = e.act(f"open {tree}/main.py")
    assert done["action"] == "open" and done["result"][0] == str(tree / "main.py")


def test_latency_is_of_each_case(spark, tree, tmp_path):
    cases = tmp_path / "cases.jsonl"
    cases.write_text("".join('{"query": "%s", "expect_path": "main.py"}\n' % q for q in ("server", "parser tokens")))
    m = Engine(spark, str(tmp_path / "store")).eval_locate(str(cases), str(tree)).first()
    assert 0 < m.p50_ms < m.p95_ms
