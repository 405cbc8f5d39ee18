import hashlib
import random
import re

from sparkseek.llm import pii as P

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(t):
    out = []
    for kind, p in BASE:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    r = random.Random(5)
    parts = ["a", "@", ".", "1", "2", "5", "-", " ", "+", "_", "b", "(", ")", "é", "𓀀", "12", "255", "4111 1111 1111 1111", "x.y@z.de", "+1 (017) 555-7713", "10.0.0.1", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(50)) for _ in range(1500)] + [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.4", "x@y.z " * 3000, "9" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = P.find_pii(d).select("doc_id", P._listed(*P.BASE).alias("s")).collect()
    assert len(got) == len(texts)
    for x in got:
        assert x.s == brute(texts[x.doc_id] or ""), texts[x.doc_id]


def test_added_spans_and_scores(spark):
    t = "IBAN DE89370400440532013000 but not DE89370400440532013001; 123-45-6789 alone; my social security number: 123-45-6789"
    x = P.find_pii(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert [t[s.start : s.end] for s in x.pii_iban] == ["DE89370400440532013000"] and x.pii_iban[0].score > 0.9
    assert all(s.score >= P.MIN_SCORE for s in x.pii_ssn)
    assert P.find_pii(spark.createDataFrame([(1, "code 123-45-6789 here")], "doc_id long, text string")).first().pii_ssn == []


def test_redact(spark):
    rows = [(1, "mail a.b@c.de and 4111 1111 1111 1111 or 1.2.3.4!", 9, "k"), (2, None, None, "k"), (3, "clean é", 7, None), (4, "+1.2.3.4.56789 x", 1, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, pii_email string")
    got = {x.doc_id: x for x in P.redact(d.drop("pii_email")).collect()}
    assert got[1].text == "mail <EMAIL> and <CARD> or <IP>!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean é" and got[3].n_chars == 7
    assert "1.2" not in got[4].text and got[4].text.endswith(" x")
    assert P.redact(d.limit(0).drop("pii_email")).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "x.y@z.de and 10.0.0.1"), (2, None), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(P.op5_pii(spark, str(tmp_path)).collect())
    assert (got[0].n_email, got[0].n_ip, got[0].spans) == (1, 1, "email:0:8,ip:13:21")
    assert got[0].base_sha256 == hashlib.sha256(b"email:0:8,ip:13:21").hexdigest() and got[1].spans == "" and len(got) == 3


def test_many_matches_take_time_in_proportion(spark):
    import time

    took = []
    for n in (10_000, 40_000):
        text = "é4 a@b.de, " * n
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        x = P.find_pii(d).select("pii_email").first().pii_email
        y = P.redact(d).first().text
        took.append(time.time() - began)
        assert len(x) == n and (x[-1].start, x[-1].end) == (len(text) - 8, len(text) - 2)
        assert y == "é4 <EMAIL>, " * n
    assert took[1] < 8 * max(took[0], 1), took  # sixteen times as long if it were quadratic


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, P.BLOCK - 1, P.BLOCK, P.BLOCK + 1, 3 * P.BLOCK + 5):
        d = spark.createDataFrame([([(7 * k) % 11 for k in range(n)],)], "v array<int>")
        got = d.select(P.running(F.col("v"), lambda x: x, lambda a, b: a + b).alias("s"), P.running(F.col("v"), lambda x: x, F.greatest).alias("m")).first()
        v = [(7 * k) % 11 for k in range(n)]
        assert got.s == [sum(v[:k]) for k in range(n)] and got.m == [max(v[:k], default=0) for k in range(n)]


def test_secrets(spark):
    t = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and API_KEY: abcdefghij0123456789, token = short'
    x = P.find_pii(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert [t[s.start : s.end] for s in x.pii_secret] == ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962', "API_KEY: abcdefghij0123456789"]
    assert all(0 <= s.score <= 1 for k in P.PATTERNS for s in x[f"pii_{k}"])


def test_redact_keeps_clashing_columns(spark):
    rows = [(1, "mail a.b@c.de", 3, "own", "mine", "r")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, pii_email string, _new string, redacted string")
    x = P.redact(d).first()
    assert (x.text, x.pii_email, x._new, x.redacted, x.n_chars) == ("mail <EMAIL>", "own", "mine", "r", 12)


def test_redact_overlaps(spark):
    """Against a walk over the spans by hand."""
    r = random.Random(8)
    parts = ["+1.2.3.4.56789", " ", "4111 1111 1111 1111", "a@1.2.3.4", "x.y@z.de", "+49 30 123456-78", "é", "10.0.0.1", " 12"]
    texts = ["".join(r.choice(parts) for _ in range(12)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {x.doc_id: sorted((s.start, -s.end, s.kind) for k in P.PATTERNS for s in x[f"pii_{k}"]) for x in P.find_pii(d).collect()}
    for x in P.redact(d).collect():
        t, at, out = texts[x.doc_id], 0, ""
        for s, e, k in spans[x.doc_id]:
            if s >= at:
                out += t[at:s] + f"<{k.upper()}>"
            at = max(at, -e)
        assert x.text == out + t[at:]


def test_long_secrets_go_whole(spark):
    long = "Ab1_" * 5000
    df = spark.createDataFrame([(1, f"the token={long} end", None), (2, "key " + "k" * 40, None)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in P.redact(df).collect()}
    assert "Ab1_" not in got[1].text and got[1].text.startswith("the ") and got[1].text.endswith(" end") and got[2].text == "key " + "k" * 40
