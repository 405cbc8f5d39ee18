"""The registered queries of the training-data operators: columns, types, held-out marks and whole tables."""

import hashlib
import zlib

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op3_sentencepiece": {"doc_id": "bigint"},
    "op4_neardup": {"doc_id": "bigint", "class_id": "bigint"},
    "op5_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_substrings": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op7_decontaminate": {"doc_id": "bigint"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_webp": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op10_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op11_pq": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op12_urlrep": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op13_ranked": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


@pytest.fixture(scope="module")
def found(spark):
    asked = E.queries()
    return {name: asked[name](spark, SF) for name in COLUMNS}


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(found, name):
    types = dict(found[name].dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", ["op1_langid", "op8_toxicity"])
def test_held_out(spark, found, name):
    rows = found[name].collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts_of(spark))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    if name == "op8_toxicity":
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_substrings_against_brute_force(spark, found):
    """Every string of 400 bytes of the table in one dictionary."""
    texts = {i: t.encode() for i, t in texts_of(spark).items()}
    seen: dict[bytes, int] = {}
    digest = lambda t, k: hashlib.blake2b(t[k : k + 400], digest_size=12).digest()
    for t in texts.values():
        for k in range(len(t) - 399):
            d = digest(t, k)
            seen[d] = seen.get(d, 0) + 1
    rows = {r.doc_id: r for r in found["op6_substrings"].collect()}
    assert sorted(rows) == sorted(texts)
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[digest(t, k)] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].kept_sha256) == (len(t), sum(gone), hashlib.sha256(kept).hexdigest())


def test_media_and_classes(spark, found):
    texts = texts_of(spark)
    for r in found["op9_webp"].collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    classes = {r.doc_id: r.class_id for r in found["op4_neardup"].collect()}
    assert sorted(classes) == sorted(texts)
    first: dict[str, int] = {}
    for i in sorted(texts):
        assert classes[first.setdefault(texts[i], i)] == classes[i] <= i
