"""Reading: file contents by tasks, text lines, PDF pages by a plug-in, evaluation datasets, configuration."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.schemas import INTENT_CASE, LOCATE_CASE


def read_files(paths: DataFrame) -> DataFrame:
    """Adds content (binary), hash, and error for files that can't be read. For paths that every executor sees."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            data, errors, hashes = [], [], []
            for p in b["path"]:
                try:
                    with open(p, "rb") as f:
                        x = f.read()
                    data.append(x)
                    errors.append(None)
                    hashes.append(hashlib.sha256(x).hexdigest())
                except OSError as e:
                    data.append(None)
                    errors.append(str(e))
                    hashes.append(None)
            yield b.assign(content=data, hash=hashes, error=errors)

    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    schema = StructType([*paths.schema.fields, StructField("content", BinaryType()), StructField("hash", StringType()), StructField("error", StringType())])
    return paths.mapInPandas(go, schema)


def parsed_text(content: F.Column) -> F.Column:
    """Text with plain line breaks, and without the last one."""
    return F.regexp_replace(F.regexp_replace(content.cast("string"), r"\r+\n", "\n"), r"\r*\n?\z", "")


#: Turns the bytes of a PDF into the texts of its pages. None is built in; a plug-in may set one.
PdfParser = Callable[[bytes], list[str]]


def pdf_pages(files: DataFrame, parser: PdfParser | None) -> DataFrame:
    """path, page, content, error: a row per page, or one with the error; without a parser every file is an error."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for p, x in zip(b["path"], b["content"], strict=True):
                try:
                    if parser is None:
                        raise RuntimeError("no PDF parser is installed")
                    rows += [(p, k, t.strip(), None) for k, t in enumerate(parser(bytes(x)), 1)]
                except Exception as e:
                    rows.append((p, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page", "content", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(go, "path string, page int, content string, error string")


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    t = F.trim("value")
    return spark.read.text(path).where((t != "") & ~t.startswith("#") & ~t.startswith("//"))


def dataset_kind(spark: SparkSession, path: str) -> str:
    """By the keys of the first case: intent, locate or unknown."""
    first = _data_lines(spark, path).head(1)
    if not first:
        raise ValueError(f"{path} holds no cases")
    keys = set(json.loads(first[0][0]))
    return "intent" if "expected" in keys else "locate" if "expect_path" in keys else "intent" if "tier" in keys else "unknown"


def read_cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cases of an evaluation dataset; a line that is no JSON fails the read."""
    schema = INTENT_CASE.replace("struct<", "struct<") if kind == "intent" else LOCATE_CASE
    return _data_lines(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


DEFAULTS: dict = {
    "index": {"max_file_size_mb": 10, "follow_symlinks": False, "extensions": [], "dirs": []},
    "exclude": {"dirs": ["node_modules", "vendor", "__pycache__"], "files": [], "paths": []},
    "chunking": {"max_tokens": 256, "overlap_tokens": 50, "min_tokens": 20},
    "search": {"rrf_k": 60, "max_results": 8, "min_arms": 1, "scope_mode": "auto", "oversample_floor": 0.01},
    "transient": {"retention_days": 7, "max_roots": 5},
    "models": {"embedding": "hashing-64", "intent": ""},
}


def load_config(path: str | None) -> dict:
    """TOML over the defaults; a missing file means the defaults."""
    own: dict = {}
    if path and os.path.exists(os.path.expanduser(path)):
        with open(os.path.expanduser(path), "rb") as f:
            own = tomllib.load(f)
    return {k: {**v, **own.get(k, {})} for k, v in DEFAULTS.items()} | {k: v for k, v in own.items() if k not in DEFAULTS}


def read_range(text: str, start: int, end: int) -> list[str] | None:
    """Lines start to end (0: the last); None if start lies beyond them. One trailing break is no line."""
    lines = text.removesuffix("\n").split("\n")
    start = max(1, start)
    if start > len(lines):
        return None
    end = len(lines) if end == 0 or end > len(lines) else end
    return lines[min(start, end) - 1 : end]


def list_directory(spark: SparkSession, path: str, files: DataFrame, scope: str = "") -> DataFrame:
    """name, path, is_dir, size (files only), chunks, outside_scope: directories first, then by name."""
    rows = []
    for e in os.scandir(path):
        is_dir = e.is_dir()
        rows.append((e.name, e.path, is_dir, None if is_dir else e.stat().st_size))
    return listed(spark.createDataFrame(rows, "name string, path string, is_dir boolean, size bigint"), files, scope)


def listed(entries: DataFrame, files: DataFrame, scope: str = "") -> DataFrame:
    """The entries of a directory with what is on record for them. files: path, chunks (ids)."""
    from sparkseek.functions.scalars import under_scope

    counts = files.select("path", F.size("chunks").alias("n"))
    got = entries.join(counts, "path", "left").withColumn("chunks", F.coalesce("n", F.lit(0))).drop("n")
    return got.withColumn("outside_scope", ~under_scope(F.col("path"), F.lit(scope))).orderBy(F.desc("is_dir"), "name")
