"""Extra columns whose names clash with those of outputs, with inner ones, or that need quotes."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from sparkseek.llm import chat, decontaminate, langid, neardup, pieces, pii, pq, ranked, substrings, toxicity, urlrep, warc, webp

NAMES = (
    "SCORE", "Lang_Pred", "bits_per_byte", "PREDICTED", "toxic_weight", "IDS", "Decoded", "_key", "_ids", "MEDIA", "samples", "READ", "LEAKS", "letters", "made", "a.b", "a`b", "_0", "_1",
    "_host1", "_RULES2", "_best", "Rule", "key", "k", "class_id", "n_rows", "redacted", "Spans", "hash", "copies", "terms", "shard", "code", "error", "refers_to", "_n", "_d", "segments", "mask",
)
TEXT = "The quick brown fox writes to a@example.org and then sleeps until the end of the day"


def widened(df):
    """The table with a column of each name that it doesn't have; the first go before its own columns."""
    new = [F.lit(f"extra {n}").alias(n) for n in NAMES if n.lower() not in {c.lower() for c in df.columns}]
    return df.select(*new[:7], "*", *new[7:])


def docs_of(spark):
    rows = [(k, f"{TEXT} {k}", "en", "s") for k in range(8)] + [(8, None, None, None), (9, "", "en", "s"), (10, "Der schnelle braune Fuchs schläft bis zum Ende des Tages", "de", "s"), (11, TEXT + " 1", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def leaks(df):
    return decontaminate.with_leaks(df, df.sparkSession.createDataFrame([(1, "brown fox writes to a@example.org and then")], "item_id long, text string"))


#: Operators that pass columns through: what they give beside, and the operator.
THROUGH = {
    "langid": (("lang_pred", "score", "bits_per_byte"), lambda d: langid.predict(d, langid.train(d))),
    "toxicity": (("score", "predicted", "toxic_weight"), lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))))),
    "encode": (("ids", "decoded"), lambda d: pieces.encode(d, decoded="decoded")),
    "decode": (("decoded",), lambda d: pieces.decode(d.withColumn("own_ids", F.array(F.lit(17), F.lit(20))), "own_ids").drop("own_ids")),
    "webp": (("media", "samples"), lambda d: webp.read_media(webp.store_media(d.withColumn("own_bytes", F.col("text").cast("binary")), "own_bytes")).drop("own_bytes")),
    "leaks": (("leaks",), leaks),
}


@pytest.mark.parametrize("name", sorted(THROUGH))
def test_columns_pass_through(spark, monkeypatch, name):
    monkeypatch.setattr(pieces, "PART", 70)  # so that both ways of encoding are taken
    new, f = THROUGH[name]
    docs = docs_of(spark)
    wide = widened(docs)
    got, plain = f(wide), f(docs)
    others = [c for c in wide.columns if c.lower() not in new]
    assert got.columns == [*others, *new] and plain.columns == [*docs.columns, *new]
    rows, want = got.collect(), {r.doc_id: tuple(r[c] for c in new) for r in plain.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[len(others) :]) == want[r.doc_id]
        assert all(r[i] == f"extra {c}" for i, c in enumerate(others) if c not in docs.columns)


def test_case_of_the_text_column(spark):
    docs = docs_of(spark).withColumnRenamed("text", "Text")
    assert pieces.encode(docs).columns == ["doc_id", "Text", "lang", "source", "ids"] and langid.predict(docs, None).count() == 12


#: Operators that leave extra columns out, or whose results are compared without them.
ALONE = {
    "chat": lambda s, w: chat.read_back(chat.format_turns(w(s.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")))),
    "neardup": lambda s, w: neardup.classes(w(docs_of(s))),
    "pii": lambda s, w: pii.find_pii(w(docs_of(s))).select("doc_id", "pii_email"),
    "substrings": lambda s, w: substrings.remove_repeats(w(docs_of(s).withColumn("text", F.repeat("text", 9)))),
    "warc": lambda s, w: warc.assemble(warc.read_records(warc.write_archives(w(s.createDataFrame([(1, "http://a.b/", "x" * 2000), (2, None, "x" * 2000)], "page_id long, url string, html string"))))).select("capture.warc_type", "capture.target_uri", "capture.payload_digest", "capture.fields"),
    "pq": lambda s, w: pq.compress(w(s.createDataFrame([(k, [k / 7, 0.5, -k / 3, 1.0], k % 2) for k in range(9)], "vec_id long, embedding array<float>, label int")), entries=3)[0],
    "urlrep": lambda s, w: urlrep.judge(w(s.createDataFrame([(1, "http://a.net/"), (2, "http://example.com/de/")], "page_id long, url string")), s.createDataFrame([(1, 1)], "page_id long, unwanted int"), urlrep.rule_table(s)),
    "rules": lambda s, w: urlrep.with_rule(w(s.createDataFrame([("a.net", "/"), ("b.org", "/fr/")], "host string, path string")), urlrep.rule_table(s)).select("host", "rule", "action"),
    "ranked": lambda s, w: ranked.search(ranked.build_index(w(docs_of(s))), w(s.createDataFrame([(1, "brown fox Tages")], "item_id long, text string"))),
}


@pytest.mark.parametrize("name", sorted(ALONE))
def test_columns_do_not_matter(spark, name):
    f = ALONE[name]
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(f(spark, lambda df: df))
    assert want and rows(f(spark, widened)) == want


def test_stages_keep_columns(spark, tmp_path):
    wide = widened(docs_of(spark))
    spark.createDataFrame([(1, "no such text as this one anywhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, wide, str(tmp_path))
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows and all(r[i] == f"extra {c}" for r in rows for i, c in enumerate(wide.columns) if c in NAMES), name
    assert C.STAGES[-1][1](spark, wide, str(tmp_path)).count() == wide.count()
