import random

import corpus_pipeline as C
from sparkseek.llm import decontaminate, neardup, pieces


def test_stages(spark, tmp_path):
    r = random.Random(6)
    en, de = ["the", "tion", "er", "and", "of", "ing"], ["der", "ung", "sch", "ö", "ein", "keit"]
    text = lambda s, n: " ".join("".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, text(en if i % 3 else de, 60), "en" if i % 3 else "de", "s") for i in range(60)]
    item = text(en, 40)
    near = rows[10][1].replace(" ", "  ", 1) + " more"
    rows += [(100, rows[10][1], "en", "s"), (101, near, "en", "s"), (102, f"{rows[11][1]} {item} {text(en, 9)}", "en", "s"), (103, "1234 !!", "en", "s"), (104, None, "en", "s"), (105, text(en, 50) + " mail x.y@z.de now", "en", "s")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in C.run(spark, str(tmp_path)).collect()}

    texts = {i: t for i, t, _, _ in rows}
    want = {}
    w = {i: neardup.weighted(neardup.words_of(t)) for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    for i in sorted(w):
        if all(neardup.probability_jaccard(w[i], w[j]) < neardup.SIMILAR for j in want):
            want[i] = texts[i]
    index = decontaminate.Index([(1, decontaminate.fold(item))])
    want = {i: t for i, t in want.items() if not index.hits([decontaminate.fold(t)])[0]}
    want[105] = want[105].replace("x.y@z.de", "<EMAIL>")
    assert set(got) == set(want) and 102 not in got and not {100, 101, 103, 104} & set(got)
    m = pieces.model(pieces.TOKENIZERS, pieces.MODEL)
    for i, t in want.items():
        assert got[i].decoded == t and got[i].ids == m.encode_free(pieces.normalised(t)) and got[i].n_ids == len(got[i].ids)


def test_columns_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the tion of the", "en", "s", 15), (2, "der ung schein", "de", "s", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "x")], "item_id long, text string").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in C.STAGES][1:3] == ["MinHash near-dedup", "benchmark decontamination"] and len(C.STAGES) == 5
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
