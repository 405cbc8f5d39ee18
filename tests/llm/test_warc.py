import gzip
import hashlib

from sparkseek.llm import warc as W


def test_records():
    recs = W.capture_records("k", 7, "http://a.b/c?d#e", "é body".encode(), None) + W.capture_records("l", 8, "", b"", 7)
    data = b"".join(recs)
    got = list(W.parse_archive(data))
    assert [h["warc-type"][0] for h, _ in got] == ["response", "request", "metadata", "revisit", "request", "metadata"]
    assert got[0][1].endswith("é body".encode()) and got[1][1].startswith(b"GET /c?d HTTP/1.1\r\nHost: a.b")
    assert [h for h, _ in W.parse_archive(gzip.decompress(recs[0]) + gzip.decompress(recs[1]))] == [h for h, _ in got[:2]]
    assert [h["warc-type"][0] for h, _ in W.parse_archive(data[:-40])] == ["response", "request", "metadata", "revisit", "request", "damaged"]


def test_damaged_records(spark):
    good = W.capture_records("k", 7, "http://a/b", b"body", None)
    odd = [b"WARC/1.0\r\nWARC-Type: response\r\n\r\nno length", b"WARC/1.0\r\nContent-Length: many\r\n\r\nx", b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort", b"not a record", b"<html>\r\n\r\n</html>"]
    latin = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Target-URI: http://a/\xe9\r\nContent-Length: 6\r\n\r\nk: \xe9\r\n"
    broken = bytearray(good[1])
    broken[20] ^= 255
    data = b"".join([good[0], *map(gzip.compress, odd), gzip.compress(latin), bytes(broken), good[2]])
    kinds = [h["warc-type"][0] for h, _ in W.parse_archive(data)]
    assert kinds[0] == "response" and kinds[1:6] == ["damaged"] * 5 and kinds[6] == "metadata" and kinds[-1] == "metadata" and "damaged" in kinds[7:-1]
    records = W.read_records(spark.createDataFrame([("a", 0, 1, data), ("b", 0, 1, b""), ("c", 0, 1, odd[0])], W.ARCHIVE_SCHEMA))
    got = records.collect()
    assert [r.fields["k"] for r in got if r.target_uri == "http://a/é"] == ["é"] and sum(r.warc_type == "damaged" for r in got) >= 7
    (row,) = W.assemble(records).collect()
    assert row.capture.payload_bytes == 4 and row.metadata is not None and row.request is None


def test_digests_of_headers():
    sha = hashlib.sha1(b"x")
    head = {"warc-type": ["revisit"], "warc-payload-digest": [f"SHA1:{sha.hexdigest().upper()}"]}
    assert W._row(head, b"HTTP/1.1 200 OK\r\nContent-Length: lots", True)[7:9] == (None, sha.hexdigest())
    assert [W._hex_digest(x) for x in ("", "md5:abc", "sha1:!!", "sha1:" + "A" * 31)] == [None] * 4


def test_query(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "u1", big, "k"), (5, "u5", big, None), (3, "u3", big, ""), (2, None, None, ""), (4, "u4", "small", ""), (6, "u6", "small", ""), (None, "n", big, ""), (9, "r", "é" * 700, ""), (9, "r", "é" * 700, ""), (10, "a\r\nWARC-Type: x", "é" * 499, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in W.op10_warc(spark, str(tmp_path)).collect())
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got == sorted([
        (1, 1500, "revisit", 5, sha(big)), (5, 1500, "response", None, sha(big)), (3, 1500, "revisit", 5, sha(big)), (2, 0, "response", None, sha("")), (4, 5, "response", None, sha("small")),
        (6, 5, "response", None, sha("small")), (-1, 1500, "revisit", 5, sha(big)), (9, 1400, "response", None, sha("é" * 700)), (9, 1400, "response", None, sha("é" * 700)), (10, 998, "response", None, sha("é" * 499)),
    ])


def test_assembly(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(50)], "page_id long, url string, html string")
    records = W.read_records(W.write_archives(pages))
    got = W.assemble(records).collect()
    assert len(got) == 50 and all(r.request.target_uri == r.capture.target_uri == r.metadata.target_uri for r in got)
    assert {bytes(r.capture.payload).decode() for r in got} == {f"<p>{i}</p>" for i in range(50)}
    lone = W.assemble(records.where("warc_type <> 'response'"))
    assert lone.count() == 0 and W.assemble(records.where("warc_type = 'response'")).where("request is null").count() == 50
    assert W.read_records(W.write_archives(pages.limit(0))).count() == 0
