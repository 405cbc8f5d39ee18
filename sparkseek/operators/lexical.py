"""BM25 over chunks, for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.scalars import tokenize, under_scope
from sparkseek.functions.sizes import blocks, if_small
from sparkseek.session import materialise

K1, B = 1.5, 0.75
TERM_BUCKETS = 32


def indexed_text() -> F.Column:
    return F.concat_ws(" ", "path", "content")


def doc_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "path", F.size(tokenize(indexed_text())).alias("dl"))


def _counted(chunks: DataFrame) -> DataFrame:
    """id, path, dl, term, tf: tokens are sorted where their chunk is, and runs of equal ones counted."""
    terms = chunks.select("id", "path", F.sort_array(tokenize(indexed_text())).alias("_terms"))
    starts = F.transform("_terms", lambda x, k: F.when((k == 0) | (x != F.get("_terms", k - 1)), k))
    # A column of its own, as a lambda would work it out anew for each of its elements.
    runs = terms.withColumn("_first", F.filter(starts, lambda k: k.isNotNull()))
    tf = lambda k, j: (F.coalesce(F.get("_first", j + 1), F.size("_terms")) - k).cast("long")
    return runs.select("id", "path", F.size("_terms").alias("dl"), F.inline(F.transform("_first", lambda k, j: F.struct(F.get("_terms", k).alias("term"), tf(k, j).alias("tf")))))


def postings(chunks: DataFrame, key: tuple[str, ...] = ("id", "path", "dl")) -> DataFrame:
    """term, the columns of key, tf. A chunk is counted where it is, and nothing of it is shuffled; only chunks whose id occurs more than
    once are brought together by term and key. Chunks without an id count as one."""
    ids = chunks.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    repeated = if_small(ids.where("n > 1").select(F.col("id").alias("_repeated")))
    shown = lambda some: _counted(some).select("term", *key, "tf")
    same = F.col("id").eqNullSafe(F.col("_repeated"))
    once, again = (chunks.join(repeated, same, how) for how in ("left_anti", "left_semi"))
    return shown(once).unionByName(shown(again).groupBy("term", *key).agg(F.sum("tf").alias("tf")))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return doc_lengths(chunks).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """Chunks in which each term occurs; distinct terms of a chunk are taken before anything is shuffled."""
    return chunks.select(F.explode(F.array_distinct(tokenize(indexed_text()))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, scope, term, qtf. Terms that a query repeats count as often."""
    return queries.select("query_id", "scope", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "scope", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, id, path, score for all chunks with a score over 0 in the query's scope. df, n and avgdl are of the whole corpus.

    Without an index: the chunks are tokenised once, and of each its length and the queries' terms in it are written; statistics and
    scores come from these. `bm25_stored` serves the same from stored postings."""
    q = query_terms(queries)
    got = materialise(_met(chunks, q.select("term").distinct()), "met")
    stats = got.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = got.select("id", "path", "dl", F.explode("terms").alias("term")).groupBy("term", "id", "path", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return scores(q, tf, stats)


def _met(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, path, dl of every chunk, and its tokens that are among the wanted terms."""
    base = chunks.select("id", "path", tokenize(indexed_text()).alias("_all"))

    def among(terms: list[str]) -> Column:
        return F.filter("_all", lambda x: x.isin(terms) if terms else F.lit(False))

    parts = [among([r.term for r in some.collect()]) for some in blocks(wanted, "term")]  # `SMALL` at most in each
    return base.select("id", "path", F.size("_all").alias("dl"), F.concat(*parts).alias("terms"))


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def stored_form(chunks: DataFrame) -> DataFrame:
    """Postings with the bucket of their term, by which they are written in folders of their own."""
    return postings(chunks).withColumn("term_bucket", term_bucket(F.col("term")))


def bm25_stored(queries: DataFrame, stored: DataFrame, stats: DataFrame) -> DataFrame:
    """The same as `bm25` from postings in `stored_form`; folders that hold none of the queries' terms aren't read."""
    q = query_terms(queries)
    wanted = q.select("term", term_bucket(F.col("term")).alias("term_bucket")).distinct()
    tf = stored.join(if_small(wanted), ["term_bucket", "term"]).select("term", "id", "path", "dl", "tf")
    return scores(q, tf, stats)


def scores(q: DataFrame, tf: DataFrame, stats: DataFrame) -> DataFrame:
    """BM25 of hits (term, id, path, dl, tf: all chunks that have one of the terms). stats: one row of n and avgdl."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = if_small(q.join(df, "term"))
    hits = tf.join(terms, "term").where(under_scope(F.col("path"), F.col("scope"))).crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id", "path").agg(F.sum(F.col("qtf") * weight).alias("score")).where("score > 0")


def ranked(arm: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rank within the query: by score (rounded, so that sums in another order rank alike), then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    out = arm.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out
