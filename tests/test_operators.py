import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import scalars as S
from sparkseek.operators import chunking as C
from sparkseek.operators import excerpt, fuse, router, sync
from sparkseek.operators import lexical
from sparkseek.operators.store import Store
from sparkseek.schemas import LOCATOR
from sparkseek.sources import files, walk


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


# --- scalars ---


@pytest.mark.parametrize("text,n", [("", 0), ("hello", 1), ("x" * 29, 7), ("😀😀😀", 0)])
def test_token_estimate(spark, text, n):
    assert one(spark, S.estimate_tokens(F.lit(text))) == n == C.tokens(text)


def test_tokenize(spark):
    assert one(spark, S.tokenize(F.lit("Err_conn a\u00a0B (x),y;z `q` a=b, a"))) == ["err_conn", "a", "b", "x", "y", "z", "q", "a=b", "a"]


def test_scopes(spark):
    p = F.lit("/p/appliance.md")
    assert one(spark, S.has_raw_prefix(p, F.lit("/p/app"))) and not one(spark, S.under_scope(p, F.lit("/p/app")))
    assert one(spark, S.under_scope(p, F.lit("/"))) and one(spark, S.under_scope(p, F.lit(""))) and one(spark, S.under_scope(F.lit("/p/app"), F.lit("/p/app/")))
    assert one(spark, S.ancestors(F.lit("/a/b/c.txt"))) == ["/", "/a", "/a/b"] and one(spark, S.ancestors(F.lit("/x"))) == ["/"]


@pytest.mark.parametrize("n,shown", [(412, "412B"), (1280, "1.2KB"), (1536, "1.5KB"), (1 << 20, "1.0MB"), (5 << 30, "5.0GB")])
def test_human_bytes(spark, n, shown):
    assert one(spark, S.human_bytes(F.lit(n).cast("long"))) == shown


def test_small_formats(spark):
    assert one(spark, S.human_int(F.lit(1234567))) == "1,234,567" and one(spark, S.human_int(F.lit(-1234))) == "-1234"
    assert one(spark, S.format_duration(F.lit(0.12))) == "120ms" and one(spark, S.format_duration(F.lit(1.44))) == "1.4s"
    assert one(spark, S.display_path(F.lit("/h/u/x"), "/h/u")) == "~/x" and one(spark, S.display_path(F.lit("/h/user"), "/h/u")) == "/h/user"
    assert tuple(one(spark, S.split_target(F.lit("a:b.go:3-9")))) == ("a:b.go", "3-9") and one(spark, S.split_target(F.lit("x:y"))).lines is None
    assert one(spark, S.clamp_range(F.lit(9), F.lit(0), F.lit(5))) is None and tuple(one(spark, S.clamp_range(F.lit(2), F.lit(99), F.lit(5)))) == (2, 5)
    assert one(spark, S.looks_like_path(F.lit("what is it"))) is False and one(spark, S.looks_like_path(F.lit("a.md"))) is True
    assert files.read_range("a\nb\nc\n", 2, 0) == ["b", "c"] and files.read_range("a\n", 3, 4) is None


# --- chunkers ---


def fragments_by_hand(t):
    """The state machine: blank line, end of sentence, line before a heading, end."""
    out, i, start = [], 0, 0
    while i < len(t):
        if t.startswith("\n\n", i) or t.startswith(". ", i):
            i += 2
        elif t[i] == "\n" and t[i + 1 : i + 2] == "#":
            i += 1
        elif i + 1 == len(t):
            i += 1
        else:
            i += 1
            continue
        out.append(t[start:i])
        start = i
    return out


def test_fragments(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["\n", ". ", "#", "a", "b c", " ", "."]) for _ in range(r.randint(1, 30))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", C.fragments_column(F.col("t")).alias("f")).collect():
        assert row.f == fragments_by_hand(row.t) == [x.text for x in C.fragments(row.t)]


def test_packing():
    how = C.Chunking(20, 5, 3)
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    got = C.pack_text(text, how)
    assert len(got) > 10 and all(c in text for c, _, _ in got)
    for (a, _, _), (b, _, _) in itertools.pairwise(got):
        assert text.index(b) < text.index(a) + len(a)  # they overlap or touch
    assert C.pack_text("", how) == [] and [c for c, _, _ in C.pack_text("x", how)] == ["x"]
    long = C.pack_text("word " * 400, C.Chunking(20, 0, 3))
    assert "".join(c for c, _, _ in long) == "word " * 400
    heads = C.pack_text("# A\n" + "text here. " * 8 + "\n# B\nmore of it.", C.Chunking(60, 0, 1))
    assert any(c.startswith("# B") for c, _, _ in heads)
    assert C.Chunking(0, 0, 0).sound() == C.Chunking(256, 50, 20) and C.Chunking(8, 9, 1).sound().overlap_tokens == 2


def test_code_segments_agree(spark):
    text = "import x\n\ndef a(b):\n  pass\nclass Q:\n  def m(): pass\n\nfunction f() {}\nasync def no(): pass\n"
    df = spark.createDataFrame([("/x.py", text)], "path string, content string")
    native = [(r.content, r.kind, r.start, r.end, r.symbol) for r in C.segment_code(df).orderBy("start").collect()]
    assert native == C.generic_code(text, C.Chunking())
    assert [x[4] for x in native] == ["", "def a(b)", "class Q", "function f()"]


GO = 'package p\n\nimport "x"\n\n// Doc.\nfunc (r *R) Do(a int) error {\n\treturn `}{`\n}\n\ntype T struct {\n\tA int // }\n}\n\nvar s = "{"\n'


def test_go():
    assert C.go_declarations(GO) == [(3, 3, ""), (6, 8, "func (r *R) Do(a int) error"), (10, 12, "type T"), (14, 14, "")]
    assert C.go_declarations("package p\nfunc f() {\n") is None and C.go_declarations("no go at all") is None
    kinds = [(k, a, z, s) for _, k, a, z, s in C.go_code(GO, C.Chunking(256, 50, 0))]
    assert ("symbol", 6, 8, "func (r *R) Do(a int) error") in kinds and any(k == "line_range" for k, *_ in kinds)
    big = C.go_code("package p\n\nfunc F() {\n" + "\tcall(one, two, three)\n" * 200 + "}\n", C.Chunking(64, 0, 1))
    assert sum(c.startswith("func F()\n... ") for c, *_ in big) > 3


def test_chunk_files(spark):
    rows = [("/a.md", "Text here. More of it."), ("/b.json", '{\n  "k": 1\n}\n'), ("/c.go", GO), ("/d.txt", ""), ("/e.py", "def x():\n  1\n")]
    got = C.chunk_files(spark.createDataFrame(rows, "path string, content string")).collect()
    by = {p: sorted((r.ordinal, r.id) for r in got if r.path == p) for p, _ in rows}
    assert not by["/d.txt"] and all([o for o, _ in v] == list(range(len(v))) for v in by.values())
    assert all(re.fullmatch(r"[0-9a-f]{16}-\d+", r.id) for r in got)
    pages = C.chunk_pages(spark.createDataFrame([("/p.pdf", 1, "One page."), ("/p.pdf", 2, ""), ("/p.pdf", 3, "Third.")], "path string, page int, content string")).orderBy("ordinal").collect()
    assert [(r.locator.kind, r.locator.start, r.ordinal) for r in pages] == [("page", 1, 0), ("page", 3, 1)]


# --- excerpts ---


def expanded(spark, path, source, start, end, most, kind="line_range", content="x"):
    df = spark.createDataFrame([(path, content, (kind, start, end, ""), source)], f"path string, content string, locator {LOCATOR}, source string")
    r = excerpt.expand(df, most).first()
    return r.start_line, r.end_line, r.excerpt


def test_expand(spark):
    prose = "one\ntwo\nthree\n\nfive\nsix"
    assert expanded(spark, "/a.md", prose, 3, 3, 10)[:2] == (1, 3)
    assert expanded(spark, "/a.md", prose, 1, 6, 2) == (1, 2, "one\ntwo")
    assert expanded(spark, "/a.go", "package p\n\nvar a = 1\n\nfunc f() {\n\tx()\n\ty()\n\tz()\n}\n", 7, 7, 10)[:2] == (5, 9)
    assert expanded(spark, "/a.yaml", "a: 1\n\nb:\n  c: 1\n  d: 2\n  e: 3\nf: 4\n", 5, 6, 10)[:2] == (3, 6)
    assert expanded(spark, "/a.py", "import q\ndef f():\n  a\n  b\n  c\n", 4, 4, 10)[:2] == (2, 6)
    assert expanded(spark, "/a.rs", "fn f() {\n a\n b\n}\nfn g() {\n}\n", 3, 3, 2)[:2] == (2, 3)
    assert expanded(spark, "/a.md", "", 3, 4, 5) == (3, 4, "x") and expanded(spark, "/a.md", None, 3, 4, 5)[2] == "x"
    assert expanded(spark, "/a.pdf", "p\n\nfind me\nrest", 2, 2, 5, "page", "find me") == (2, 2, "find me\nrest")


def reference_bounds(kind, lines, start, end, most):
    """Line by line, as a reader would grow it."""
    if end - start + 1 >= most:
        return start, min(end, start + most - 1)
    stop = {"prose": lambda x: x.strip() == "", "structured": lambda x: x != "" and x[0] not in " \t#/"}[kind]
    while start > 1 and end - start + 2 <= most and not (stop(lines[start - 2]) if kind == "prose" else stop(lines[start - 1])):
        start -= 1
    while end < len(lines) and end - start + 2 <= most and not stop(lines[end]):
        end += 1
    return start, end


def test_expand_against_walk(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        lines = [r.choice(["", " ", "a", "  b", "# c", "k:", "/d"]) for _ in range(r.randint(1, 14))]
        a = r.randint(1, len(lines))
        rows.append((i, r.choice(["/x.md", "/x.yaml"]), "?", ("line_range", a, min(len(lines), a + r.randint(0, 3)), ""), "\n".join(lines)))
    df = spark.createDataFrame(rows, f"n int, path string, content string, locator {LOCATOR}, source string").where("source <> ''")
    for x in excerpt.expand(df, 6).collect():
        lines = x.source.split("\n")
        want = reference_bounds("prose" if x.path.endswith("md") else "structured", lines, x.locator.start, x.locator.end, 6)
        assert (x.start_line, x.end_line) == want, (x, want)
        assert x.excerpt == "\n".join(lines[want[0] - 1 : want[1]])


def test_render(spark):
    df = spark.createDataFrame([("/a.md", "b\tc", ("line_range", 2, 2, ""), "a\nb\tc\nd", 1, 3)], f"path string, content string, locator {LOCATOR}, excerpt string, start_line int, end_line int")
    out = excerpt.render(df, info=F.lit("(bm25)")).first().rendered.split("\n")
    assert len(out[0]) == 80 and out[0].startswith("/a.md:1-3 ") and out[0].endswith("(bm25)")
    assert out[1:] == ["    1 | a", "    2 | b   c", "    3 | d", ""]
    assert "\x1b[33mb   c\x1b[0m" in excerpt.render(df, color=True).first().rendered
    assert excerpt.expand_tabs("\ta\n日\tb") == "    a\n日  b"


# --- fusion ---


def arm(spark, rows):
    return spark.createDataFrame([(1, i, f"/{i}", k) for k, i in enumerate(rows, 1)], "query_id int, id string, path string, rank int")


def test_fusion(spark):
    a, b = arm(spark, ["x", "y", "z"]), arm(spark, ["y", "w"])
    key = lambda df: [(r.id, round(r.score, 9), r.n_arms, r.rank) for r in df.orderBy("rank").collect()]
    got = key(fuse.fuse({"bm25": a, "vec": b}))
    assert got[0] == ("y", round(1 / 62 + 1 / 61, 9), 2, 1) and [x[0] for x in got] == ["y", "x", "w", "z"]
    assert got == key(fuse.fuse({"vec": a, "bm25": b})) and [x[0] for x in key(fuse.fuse({"bm25": a, "vec": b}, min_arms=2))] == ["y"]
    many = fuse.classify(fuse.fuse({"bm25": arm(spark, list("abcdefghijk"))}), 8)
    classes = {r.id: (r["class"], r.rank) for r in many.collect()}
    assert classes["e"] == ("strong", 5) and classes["f"] == ("weak", 1) and "i" not in classes
    weak_first = {"bm25": arm(spark, [])}
    both = fuse.two_phase(weak_first, b)
    assert {r.id for r in both.collect()} == {"y", "w"}


# --- router and references ---


@pytest.mark.parametrize("said,want", [
    ("open main.go", ("open", None, "main.go", None)), ("open the door please", None), ("find the meaning of life", None), ("find *.md now", ("locate", "*.md now", None, None)),
    ("head 20 a.txt", ("read", None, "a.txt", "20")), ("tail -5 a.txt", ("read", None, "a.txt", "-5")), ("Open x", None), ("copy the second one", ("copy", None, "the second one", None)), ("show me the config", None),
    ("ls", None), ("list docs", ("list", None, "docs", None)), ("read a\nb", None),
])
def test_fast_path(spark, said, want):
    got = one(spark, router.fast_path(F.lit(said)))
    assert (tuple(got) if got else None) == (want and (want[0], want[1], want[2], want[3]))


def test_session():
    s = router.Session()
    s.set("q", [{"path": "/a"}, {"path": "/b"}])
    assert s.step(-1) == 1 and s.step(1) == 0 and s.get(5) is None
    s.set_active(1)
    s.set_scope("/x")
    assert s.items == [] and s.active == 0
    assert router.resolve_scope("/r/sub", None, False, "auto", ["/r"]) == ("/r/sub", False)
    assert router.resolve_scope("/else", None, False, "auto", ["/r"]) == ("", True) and router.resolve_scope("/r", "/o", True, "auto", []) == ("", False)


def test_route_with_model(spark):
    model = lambda df: df.select("input", F.struct(F.lit("locate").alias("action"), F.col("input").alias("query"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("lines")).alias("intent"))
    got = {r.input: (r.intent.action, r.tier) for r in router.route(spark.createDataFrame([("open a.py",), ("where is it",)], "input string"), "input", model).collect()}
    assert got == {"open a.py": ("open", 1), "where is it": ("locate", 2)}


# --- sources ---


def test_walk(tmp_path):
    for p, text in {"a/b.md": "x", "a/drafts/c.md": "x", "a/keep.bak": "x", "a/x.bak": "x", "node_modules/d.js": "x", ".git/e.txt": "x", "_f.txt": "x", "g.png": "x", ".env.local": "x", "s/deep/anch/h.txt": "x", "anch/i.txt": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    (tmp_path / walk.IGNORE_FILE).write_text("# note\ndrafts/\n*.bak\n!keep.bak\n/anch\n")
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.link(tmp_path / "a" / "b.md", tmp_path / "zz.md")
    got = {os.path.relpath(p, tmp_path) for p, _, _ in walk.walk([str(tmp_path), str(tmp_path / "a")], walk.Excludes(dirs=["node_modules"]))}
    assert got == {"a/b.md", "a/keep.bak", "_f.txt", "s/deep/anch/h.txt", walk.IGNORE_FILE}
    assert walk.Excludes().with_flag("*.log, /tmp/x").files == ["*.log"] and walk.Excludes().with_flag("*.log, /tmp/x").paths == ["/tmp/x"]
    assert walk.glob_match("a[b-d]?", "acx") and not walk.glob_match("*.md", "x/y.md") and walk.glob_match("d", "d/e")
    with pytest.raises(OSError):
        list(walk.walk([str(tmp_path / "zz.md")]))


def test_admission(spark):
    rows = [("/a.txt", b"ok"), ("/b.txt", b"a\x00"), ("/c.txt", b"\xff"), ("/d.exe", b"ok"), ("/e.pdf", b"\x00"), ("/F.TXT", b"x" * 8191 + "é".encode()), ("/g.md", "é".encode() * 10)]
    df = spark.createDataFrame(rows, "p string, b binary")
    assert [r.p for r in df.where(walk.admitted(F.col("p"), F.octet_length("b"), F.col("b"))).collect()] == ["/a.txt", "/e.pdf", "/g.md"]


def test_datasets(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('// c\n\n{"query": "a", "expect_path": "b"}\n')
    assert files.dataset_kind(spark, str(p)) == "locate" and files.read_cases(spark, str(p), "locate").first().expect_path == "b"
    p.write_text("# none\n")
    with pytest.raises(ValueError):
        files.dataset_kind(spark, str(p))
    p.write_text('{"query"\n')
    with pytest.raises(Exception):
        files.read_cases(spark, str(p), "locate").collect()
    (tmp_path / "c.toml").write_text("[search]\nrrf_k = 10\n")
    assert files.load_config(str(tmp_path / "c.toml"))["search"] == {**files.DEFAULTS["search"], "rrf_k": 10} and files.load_config(None) == files.DEFAULTS
    pdf = spark.createDataFrame([("/a.pdf", b"x")], "path string, content binary")
    assert files.pdf_pages(pdf, None).first().error and [r.content for r in files.pdf_pages(pdf, lambda b: [" one ", ""]).collect()] == ["one", ""]


# --- sync and store ---


def test_sync_rules(spark):
    files_ = spark.createDataFrame([("/r/a", 1, 1, "h"), ("/r/b", 1, 1, "h"), ("/r/c", 2, 1, "h"), ("/r/d", 1, 1, "h"), ("/rr/e", 1, 1, "h")], "path string, size long, mtime_ns long, hash string")
    seen = spark.createDataFrame([("/r/a", 1, 1, "?"), ("/r/b", 1, 2, "h"), ("/r/c", 1, 1, "h"), ("/r/x", 1, 1, "h")], "path string, size long, mtime_ns long, hash string")
    assert {r.path: r.status for r in sync.classify_changes(seen, files_).collect()} == {"/r/a": "unchanged", "/r/b": "unchanged", "/r/c": "updated", "/r/x": "added"}
    assert [r.path for r in sync.orphans(files_, seen, spark.createDataFrame([("/r/",)], "root string")).collect()] == ["/r/d"]
    roots = spark.createDataFrame([("a", 100), ("b", 90), ("c", 95), ("d", 10)], "root string, last_access long")
    assert {r.root: r.reason for r in sync.expired_roots(roots, 86_400 + 50, 1, 2).collect()} == {"d": "age", "b": "count"}
    assert {r.root for r in sync.touch_roots(spark.createDataFrame([("/a", 1), ("/a/b", 1), ("/ab", 1)], "root string, last_access long"), "/a/b/c", 9).where("last_access = 9").collect()} == {"/a", "/a/b"}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    schema = "id string, path string, ordinal int, content string, embedding array<float>, locator " + LOCATOR + ", transient boolean"
    row = lambda i, t: (i, f"/{i}", 0, t, [1.0], ("line_range", 1, 1, ""), False)
    assert not s.exists() and s.table("chunks").count() == 0
    s.add(spark.createDataFrame([row("a", "one"), row("b", "two")], schema))
    s.add(spark.createDataFrame([row("b", "new"), row("c", "three")], schema))
    assert {r.id: r.content for r in s.table("chunks").collect()} == {"a": "one", "b": "new", "c": "three"}
    s.delete(where={"path": "/a"})
    s.delete(contains="three")
    assert [r.id for r in s.table("chunks").collect()] == ["b"]
    s.delete(ids=["b"])
    assert s.table("chunks").count() == 0 and s.exists()


def test_store_commits(spark, tmp_path):
    """A commit rewrites the buckets of its paths alone; readers see the newest whole pointer; one of two writers fails."""
    import json

    from sparkseek.operators.store import Conflict

    s = Store(spark, str(tmp_path / "s"))
    schema = "id string, path string, ordinal int, content string, embedding array<float>, locator " + LOCATOR + ", transient boolean"
    row = lambda i, t: (f"i{i}", f"/{i}", 0, t, None, ("line_range", 1, 1, ""), False)
    s.add(spark.createDataFrame([row(k, f"text{k} common") for k in range(60)], schema))
    first = s._pointer()
    s.add(spark.createDataFrame([row(7, "other common")], schema))
    number, now = s._pointer()
    moved = [k for k in now["chunks"] if now["chunks"][k] != first[1]["chunks"][k]]
    assert number == first[0] + 1 and len(moved) == 1 and len(now["chunks"]) > 5
    stored, stats = s.postings()
    assert stored.where("term = 'common'").count() == 60 and stored.where("term = 'text7'").count() == 0 and stats.first().n == 60
    q = spark.createDataFrame([(1, "other common", "")], "query_id int, query string, scope string")
    a = {r.id: round(r.score, 9) for r in lexical.bm25_stored(q, stored, stats).collect()}
    assert a == {r.id: round(r.score, 9) for r in lexical.bm25(q, s.table("chunks")).collect()} and len(a) == 60
    late = Store(spark, str(tmp_path / "s"))
    late._pointer = lambda: first
    with pytest.raises(Conflict):
        late.delete(ids=["i1"])
    (tmp_path / "s" / f"pointer-{number + 1:012d}").write_text(json.dumps(now)[:20])  # cut off
    assert s._pointer()[0] == number and s.table("chunks").count() == 60
    (tmp_path / "s" / f"pointer-{number + 1:012d}").unlink()
    s.vacuum(keep=1)
    assert s.table("chunks").count() == 60 and s.postings()[0].where("term = 'common'").count() == 60


def test_budget(spark):
    df = spark.createDataFrame([(1, k, "x" * 20) for k in (1, 2, 3)], "query_id int, rank int, content string")
    assert [C.token_budget(df, 5, m).count() for m in (25, 20, 19, 4)] == [3, 3, 2, 0]
