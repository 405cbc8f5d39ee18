"""WARC: archives of request, response, revisit and metadata records, and their assembly into captures.

Writing: each page becomes a capture (a response, or a revisit of the page with the largest id among those with the same
payload of at least `MIN_REVISIT` bytes), a request and a metadata record. Records are gzip members of their own, packed
into archives of about `ARCHIVE_BYTES`, which Spark stores as rows of a binary column, so any file system that Spark
reaches will do. Reading parses every record again; requests and metadata reach their capture through
WARC-Concurrent-To, gathered by one grouping with partial aggregation.

Defined results: a null html is an empty payload, a null url an empty target; a null page_id stays null and never is the
one referred to (a payload seen only with null ids is a response each time); rows that repeat a page_id with the largest
id of their payload are all responses; requests and metadata without a capture yield no row; empty tables give empty
results; extra columns of the input are ignored; a record that can't be read becomes one of type `damaged`, which belongs to no
capture, and the others of its archive are read; headers and fields that aren't UTF-8 are taken as Latin-1.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import table
from sparkseek.session import materialise

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_SCHEMA = "archive string, seq int, n_records int, content binary"
RECORD_SCHEMA = (
    "record_id string, warc_type string, concurrent_to array<string>, target_uri string, date string, status int, "
    "fields map<string,string>, payload_bytes long, payload_digest string, payload binary"
)


def record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _one_line(s: str) -> str:
    return re.sub(r"[\r\n]+", " ", s)


def capture_records(key: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> list[bytes]:
    """The records of one page; `key` makes their ids unique."""
    rid = {k: uuid.uuid5(uuid.NAMESPACE_URL, f"{key}/{k}").urn for k in ("capture", "request", "metadata")}
    url = _one_line(url)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", url)]
    own = [*common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        capture = record("response", rid["capture"], own, http + payload)
    else:
        capture = record("revisit", rid["capture"], [*own, ("WARC-Profile", _PROFILE)], http)
    host, path = re.fullmatch(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)([^#]*).*", url).groups()
    ask = f"GET {path or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    to = ("WARC-Concurrent-To", f"<{rid['capture']}>")
    fields = f"page-id: {'' if page_id is None else page_id}\r\nrefers-to-page: {'' if refers_to is None else refers_to}\r\n".encode()
    return [
        capture,
        record("request", rid["request"], [*common, to, ("Content-Type", "application/http; msgtype=request")], ask),
        record("metadata", rid["metadata"], [*common, to, ("Content-Type", "application/warc-fields")], fields),
    ]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, buf, size, n, row = TaskContext.get().partitionId(), 0, [], 0, 0, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f"part-{part:05d}-{seq:05d}.warc.gz"]), pa.array([seq], pa.int32()), pa.array([n], pa.int32()), pa.array([b"".join(buf)], pa.binary())],
            ["archive", "seq", "n_records", "content"],
        )

    for b in batches:
        for page_id, url, html, ref in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            made = capture_records(f"{part}/{row}/{page_id}", page_id, url or "", (html or "").encode(), ref)
            row += 1
            buf += made
            n += len(made)
            size += sum(map(len, made))
            if size >= ARCHIVE_BYTES:
                yield out()
                seq, buf, size, n = seq + 1, [], 0, 0
    if buf:
        yield out()


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: the page whose payload this one repeats, or null."""
    p = pages.select("page_id", "url", "html", F.octet_length(F.coalesce("html", F.lit(""))).alias("_n"))
    p = p.withColumn("_d", F.when(F.col("_n") >= MIN_REVISIT, F.sha1(F.col("html").cast("binary"))))
    first = (
        p.where(F.col("_d").isNotNull())
        .groupBy("_d", "_n")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1 and _first is not null")
    )
    j = p.join(first, ["_d", "_n"], "left")
    return j.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Archives of all pages, stored in the shared folder and read back as (archive, seq, n_records, content)."""
    rows = with_references(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.col("refers_to").cast("long"))
    return materialise(rows.mapInArrow(_pack, ARCHIVE_SCHEMA), name)


def _members(data: bytes, step: int = 1 << 14) -> Iterator[bytes | None]:
    """Gzip members, fed piece by piece: what a member leaves over is copied, so it has to stay small. A member that is damaged or
    ends early is None; reading goes on where the next one seems to begin."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out, begin = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                piece = view[at : at + step]
                if not piece:
                    raise zlib.error("the archive ends early")
                out.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
        except zlib.error:
            yield None
            at = data.find(b"\x1f\x8b\x08", begin + 1)
            if at < 0:
                return
        else:
            yield b"".join(out)


def _decoded(raw: bytes) -> str:
    """UTF-8, or Latin-1 where it isn't."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


_DAMAGED: tuple[dict[str, list[str]], bytes] = ({"warc-type": ["damaged"]}, b"")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Records of one archive (gzip members, or plain) in order. What can't be read yields a record of type `damaged`: a member that
    doesn't unpack, and bytes without a WARC header or a usable Content-Length (with them the rest of their member)."""
    raw = _members(data) if data[:2] == b"\x1f\x8b" else iter([data])
    for text in raw:
        if text is None:
            yield _DAMAGED
            continue
        at = 0
        while at < len(text):
            end = text.find(b"\r\n\r\n", at)
            version, *lines = _decoded(text[at : max(end, at)]).split("\r\n")
            head: dict[str, list[str]] = {}
            for x in lines:
                k, _, v = x.partition(":")
                head.setdefault(k.strip().lower(), []).append(v.strip())
            size = _whole(head.get("content-length", [""])[0])
            if not version.startswith("WARC/") or size is None or end + 4 + size > len(text):
                yield _DAMAGED
                break
            yield head, text[end + 4 : end + 4 + size]
            at = end + 4 + size
            while text[at : at + 2] == b"\r\n":
                at += 2


def _whole(s: str) -> int | None:
    return int(s) if re.fullmatch(r"[0-9]{1,18}", s) else None


def _hex_digest(said: str) -> str | None:
    """A SHA-1 digest as it stands in a header, base 32 or hexadecimal, as lower-case hexadecimal; None if it is neither."""
    kind, _, value = said.partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value).hex() if re.fullmatch(r"[A-Z2-7]{32}", value) else None


def _row(head: dict[str, list[str]], block: bytes, with_payload: bool) -> tuple:
    """In the order of RECORD_SCHEMA."""
    get = lambda k: head[k][0] if k in head else None
    kind = get("warc-type")
    status = n = digest = payload = None
    fields: list[tuple[str, str]] = []
    if kind in ("response", "revisit"):
        top, _, body = block.partition(b"\r\n\r\n")
        lines = top.decode("latin-1").split("\r\n")
        m = re.match(r"HTTP/\S+ (\d+)", lines[0])
        status = int(m[1]) if m else None
        if kind == "response":
            n, digest, payload = len(body), hashlib.sha1(body).hexdigest(), body if with_payload else None
        else:  # what the stored headers say of the full payload
            n = next((_whole(x.partition(":")[2].strip()) for x in lines if x.lower().startswith("content-length:")), None)
            digest = _hex_digest(get("warc-payload-digest") or "")
    elif kind == "metadata":
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in _decoded(block).split("\r\n") if x)]
    to = [x.strip("<>") for x in head.get("warc-concurrent-to", ())]
    return (get("warc-record-id") or "").strip("<>"), kind, to, get("warc-target-uri"), get("warc-date"), status, list(dict(fields).items()), n, digest, payload


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD_SCHEMA))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows: list[tuple] = []
                for head, block in parse_archive(data.as_py()):
                    rows.append(_row(head, block, with_payload))
                    if len(rows) == 1024:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return archives.select("content").mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, capture, request and metadata (null where there is none). Of several requests or
    metadata records of one capture, the one with the largest record id is taken."""
    cols = [c for c in records.columns if c != "concurrent_to"]
    is_capture = F.col("warc_type").isin("response", "revisit")
    linked = records.withColumn("capture_id", F.explode(F.when(is_capture, F.array("record_id")).otherwise(F.col("concurrent_to"))))
    plain = [c for c in cols if c != "fields"]  # a map can't be compared: as pairs
    row = F.struct(*plain, F.array_sort(F.map_entries("fields")).alias("fields"))
    pick = lambda cond: F.max(F.when(cond, row))
    got = linked.groupBy("capture_id").agg(
        pick(is_capture).alias("capture"), pick(F.col("warc_type") == "request").alias("request"), pick(F.col("warc_type") == "metadata").alias("metadata")
    )
    return got.where(F.col("capture").isNotNull())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = assemble(read_records(write_archives(table(spark, sf_dir, "pages")), with_payload=False))
    return captures.select(
        F.expr("try_cast(map_from_entries(metadata.fields)['page-id'] as long)").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.warc_type").alias("record_type"),
        F.expr("try_cast(map_from_entries(metadata.fields)['refers-to-page'] as long)").alias("refers_to"),
    )


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL = {
    "op10_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, b, max(page_id) AS r FROM p WHERE b >= {MIN_REVISIT} GROUP BY d, b)
        SELECT page_id, CAST(p.b AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN r IS NULL OR page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN r IS NOT NULL AND page_id <> r THEN r END AS refers_to
        FROM p LEFT JOIN m ON p.d = m.d AND p.b = m.b""",
}
