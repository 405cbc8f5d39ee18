"""Schemas of the engine's tables."""

from pyspark.sql.types import _parse_datatype_string as _s  # noqa: F401

LOCATOR = "struct<kind:string,start:int,end:int,symbol:string>"
CHUNK = f"id string, path string, ordinal int, content string, embedding array<float>, locator {LOCATOR}, transient boolean"
FILE = "path string, mtime_ns bigint, size bigint, hash string, chunks array<string>, transient boolean"
IDENTITY = "embedding_model string, dim int, prefix_scheme string, chunker_version int"
ROOT = "root string, last_access bigint"
QUARANTINE = "path string, reason string, time timestamp"
LOCATE_CASE = "query string, expect_path string, scope string, expected_text string"
INTENT = "struct<action:string,query:string,path:string,lines:string>"
INTENT_CASE = f"input string, expected {INTENT}, tier int"
KINDS = ("line_range", "page", "symbol")
