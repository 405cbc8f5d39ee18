"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, redaction of personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Defined results: a document without letters or with an uncertain language is rejected; of each near-duplicate class the
least doc_id stays; a document that holds a benchmark item goes; spans of personal data are replaced by their kind (n_chars
follows); the last stage adds ids and the text decoded from them. Null texts are rejected by the first stage. Of rows that repeat a
doc_id with one text, one stays; rows without doc_id are judged by language, benchmark and personal data alone.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import decontaminate, langid, neardup, pieces, pii
from sparkseek.llm.common import by_place, table
from sparkseek.session import bounded_batches, delete, scratch, shared_dir, ship

#: Least posterior of the language, and most bits a byte under its model, for a document to stay.
LEAST_SCORE, MOST_BITS = 0.5, 12.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    base, names, at = by_place(docs, "text")  # a column of the documents may be called like one of the prediction
    found = langid.predict(base, langid.train(docs), text=f"_{at}")
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE) & (F.col("bits_per_byte") <= MOST_BITS)).select(*base.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pii.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    coded = pieces.encode(docs, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded")


STAGES = [
    ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", benchmark_decontamination), ("PII", personal_data),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = os.path.join(top, str(k))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if k:  # the stage before isn't read any more
            delete(spark, os.path.join(top, str(k - 1)))
        docs = spark.read.parquet(path)
    return docs


#: The stages can't be put in SQL; tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None
