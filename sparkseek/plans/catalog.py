"""Queries over the driver's tables, one or more per operator, each with DuckDB SQL where SQL can express it.

A document is a file /source/lang/doc<id>.txt with one chunk; its vector, if any, is the embedding with its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions import scalars as S
from sparkseek.operators import blocks, chunking, evaluation, excerpt, fuse, latent, lexical, paths, percentiles, ranks, router, store, sync, vector
from sparkseek.session import materialise, settled
from sparkseek.sources import files as sources
from sparkseek.sources import walk

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    df = docs.select("doc_id", path.alias("path"), F.lit(0).alias("ordinal"), F.coalesce("text", F.lit("")).alias("content"), "source", "lang")
    return df.withColumn("id", S.chunk_id(F.col("path"), F.col("ordinal")))


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


C = """c AS (SELECT doc_id, source, lang, '/' || source || '/' || lang || '/doc' || doc_id || '.txt' AS path, coalesce(text, '') AS content,
    sha256('/' || source || '/' || lang || '/doc' || doc_id || '.txt')[1:16] || '-0' AS id FROM documents)"""
_CLASS = r"[^\t\n\x0B\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}/\\.,;:()\[\]{}\"''`!?<>]+"
TOK = f"regexp_extract_all(lower(path || ' ' || content), '{_CLASS}')"


def literal(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


SEARCHES = [(1, "and the retition", ""), (2, "erenth doc7 txt", ""), (3, "and the retition", "/src1"), (4, "the the of", "/src1/en"), (5, "de la ouvi", ""), (6, "zz-none", ""), (7, "doc7.txt", ""), (8, "src1en9", "/src1")]
SCOPED = lambda alias: f"({alias}.scope = '' OR path = {alias}.scope OR starts_with(path, {alias}.scope || '/'))"


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id int, query string, scope string")


BM25 = f"""{C}, qs AS (SELECT * FROM {literal(SEARCHES)} AS v(query_id, query, scope)),
  q AS (SELECT query_id, scope, term, count(*) AS qtf FROM (SELECT query_id, scope, unnest(regexp_extract_all(lower(query), '{_CLASS}')) AS term FROM qs) GROUP BY ALL),
  tk AS (SELECT id, path, {TOK} AS tok FROM c), tf AS (SELECT id, path, len(tok) AS dl, unnest(tok) AS term FROM tk),
  n AS (SELECT id, path, dl, term, count(*) AS tf FROM tf GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM n GROUP BY term),
  st AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM tk),
  bm AS (SELECT query_id, id, path, sum(qtf * ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
         FROM n JOIN df USING (term) JOIN q USING (term) CROSS JOIN st WHERE {SCOPED('q')} GROUP BY query_id, id, path),
  bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm WHERE score > 0)"""


@query("tokenize_counts", f"WITH {C} SELECT id, CAST(len({TOK}) AS INT) AS n_tokens, CAST(len(list_distinct({TOK})) AS INT) AS n_terms FROM c")
def _(spark, d):
    t = S.tokenize(lexical.indexed_text())
    return chunks(spark, d).select("id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


@query("doc_lengths", f"WITH {C} SELECT id, path, CAST(len({TOK}) AS INT) AS dl FROM c")
def _(spark, d):
    return lexical.doc_lengths(chunks(spark, d))


@query("corpus_stats", f"WITH {C} SELECT count(*) AS n, round(avg(len({TOK})), 6) AS avgdl FROM c")
def _(spark, d):
    return lexical.corpus_stats(chunks(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("postings", f"WITH {C}, t AS (SELECT id, unnest({TOK}) AS term FROM c) SELECT term, id, count(*) AS tf FROM t GROUP BY term, id")
def _(spark, d):
    return lexical.postings(chunks(spark, d), ("id",))


@query("term_df_topk", f"WITH {C}, t AS (SELECT id, unnest(list_distinct({TOK})) AS term FROM c) SELECT term, count(*) AS df FROM t GROUP BY term ORDER BY df DESC, term LIMIT 50")
def _(spark, d):
    return lexical.document_frequency(chunks(spark, d)).orderBy(F.desc("df"), "term").limit(50)


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The block index of all documents, written for one query, which deletes it (inside `settled`)."""
    return materialise(blocks.build(chunks(spark, d)), "blocks", wide=True)


def _top_k(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    return settled(spark, "bm25", lambda: blocks.top_k(queries, _index(spark, d), k))


def _bm25(k: int, extra: str = "") -> str:
    return f"WITH {BM25} SELECT query_id, id, path, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bmr WHERE rank <= {k}{extra}"


def _bm25_rows(spark, d, k: int) -> DataFrame:
    return _top_k(spark, d, searches(spark), k).select("query_id", "id", "path", F.round("score", 6).alias("score"), "rank")


@query("bm25_topk", _bm25(10))
def _(spark, d):
    return _bm25_rows(spark, d, 10)


@query("bm25_unindexed", _bm25(10))
def _(spark, d):
    got = settled(spark, "unindexed", lambda: lexical.ranked(lexical.bm25(searches(spark), chunks(spark, d)), 10))
    return got.select("query_id", "id", "path", F.round("score", 6).alias("score"), "rank")


@query("bm25_scoped_topk", _bm25(10, " AND query_id IN (3, 4)"))
def _(spark, d):
    q = searches(spark).where("scope <> ''")
    return _top_k(spark, d, q, 10).select("query_id", "id", "path", F.round("score", 6).alias("score"), "rank")


@query("bm25_dup_terms", _bm25(5, " AND query_id = 4"))
def _(spark, d):
    return _bm25_rows(spark, d, 5).where("query_id = 4")


PATHS = [(1, "src1en9", ""), (2, "SRC2/de", ""), (3, "doc7.txt", "/src1"), (4, "", ""), (5, "s c", "")]


def _path_arm_sql(queries: str) -> str:
    """CTEs up to pr: the path arm by all alignments, one character of the query after the other, and its ranks."""
    return f"""pq AS (SELECT *, '(?s)' || array_to_string(list_transform(string_split(lower(query), ''), lambda x: regexp_escape(x)), '.*') AS p, lower(query) AS ql FROM {queries} WHERE query <> ''),
  pm AS (SELECT query_id, ql, id, path FROM pq JOIN c ON {SCOPED('pq')} AND regexp_matches(lower(path), p)),
  pl0 AS (SELECT DISTINCT id, path FROM pm), pl1 AS (SELECT id, path, unnest(range(1, length(path) + 1)) AS i FROM pl0),
  pl AS (SELECT id, i, lower(path[i]) AS lc, CASE WHEN i = 1 THEN {paths.FIRST} WHEN contains('/-_ .\\', path[i - 1]) THEN {paths.AFTER_SEPARATOR}
         WHEN upper(path[i]) = path[i] AND lower(path[i]) <> path[i] AND upper(path[i - 1]) <> path[i - 1] THEN {paths.CAMEL} ELSE 0 END AS bonus FROM pl1),
  pa(query_id, id, ql, j, i, r, s) AS (SELECT query_id, id, ql, 1, i, 0, bonus + greatest({paths.LEADING_MOST}, {paths.LEADING} * (i - 1)) FROM pm JOIN pl USING (id) WHERE lc = ql[1]
    UNION ALL SELECT query_id, id, ql, j, i, r, max(s) FROM (SELECT pa.query_id, pa.id, pa.ql, pa.j + 1 AS j, pl.i, CASE WHEN pl.i = pa.i + 1 THEN pa.r + 1 ELSE 0 END AS r,
      pa.s + pl.bonus + CASE WHEN pl.i = pa.i + 1 THEN {paths.ADJACENT} * (pa.r + 1) ELSE 0 END AS s FROM pa JOIN pl ON pl.id = pa.id AND pl.i > pa.i AND pl.lc = pa.ql[pa.j + 1]) GROUP BY query_id, id, ql, j, i, r),
  ps AS (SELECT pm.query_id, pm.id, pm.path, CAST(max(s) - (length(pm.path) - length(pm.ql)) AS DOUBLE) AS score FROM pa JOIN pm ON pm.query_id = pa.query_id AND pm.id = pa.id WHERE j = length(pm.ql) GROUP BY pm.query_id, pm.id, pm.path, pm.ql),
  pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ps)"""


@query("path_subsequence_match", f"""WITH {C}, q AS (SELECT *, '(?s)' || array_to_string(list_transform(string_split(lower(query), ''), lambda x: regexp_escape(x)), '.*') AS p
    FROM {literal(PATHS)} AS v(query_id, query, scope) WHERE query <> '')
    SELECT query_id, query, path, id FROM q JOIN c ON {SCOPED('q')} AND regexp_matches(lower(path), p)""")
def _(spark, d):
    return paths.matches(spark.createDataFrame(PATHS, "query_id int, query string, scope string"), chunks(spark, d))


@query("path_arm_topk", f"WITH RECURSIVE {C}, {_path_arm_sql(literal(PATHS) + ' AS v(query_id, query, scope)')} SELECT query_id, id, path, score, CAST(rank AS INT) AS rank FROM pr WHERE rank <= 10")
def _(spark, d):
    return lexical.ranked(paths.path_arm(spark.createDataFrame(PATHS, "query_id int, query string, scope string"), chunks(spark, d)), 10).select("query_id", "id", "path", "score", "rank")


VECTORS = [(1, 7, ""), (2, 42, ""), (3, 7, "/src1"), (4, 100, "/src1/en"), (6, 12, ""), (7, 9, "")]


def _vector_queries(spark, d) -> DataFrame:
    q = spark.createDataFrame(VECTORS, "query_id int, vec_id long, scope string")
    return table(spark, d, "embeddings").join(F.broadcast(q), "vec_id").select("query_id", "embedding", "scope")


VEC = f"""{C}, vq AS (SELECT query_id, embedding AS qe, scope FROM {literal(VECTORS)} AS v(query_id, vec_id, scope) JOIN embeddings USING (vec_id)),
  vs AS (SELECT query_id, id, path, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS score
         FROM c JOIN embeddings ON vec_id = doc_id JOIN vq ON {SCOPED('vq')}),
  vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM vs)"""


def _vec(spark, d, k: int) -> DataFrame:
    return vector.vector_arm(_vector_queries(spark, d), with_vectors(spark, d), k)


#: Every embedding whose number is divisible by 20 is a query, against all.
EVERY = 20


def _every_20th(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").where(f"vec_id % {EVERY} = 0")
    return e.select(F.col("vec_id").alias("query_id"), "embedding", F.lit("").alias("scope"))


def _nearest(spark, queries: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """By the stored form of the vectors, written for one query."""
    return settled(spark, "vectors", lambda: vector.top_k(queries, materialise(vector.build(own), "clusters", wide=True), k))


@query("vector_topk", f"""WITH {C}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % {EVERY} = 0),
  s AS (SELECT query_id, id, path, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe) AS score FROM c JOIN embeddings ON vec_id = doc_id CROSS JOIN q),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s)
  SELECT query_id, id, path, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def _(spark, d):
    got = _nearest(spark, _every_20th(spark, d), with_vectors(spark, d), 20)
    return got.select("query_id", "id", "path", F.round("score", 6).alias("score"), "rank")


@query("latent_topk")
def _(spark, d):
    """Every document whose number is divisible by 20, with the nearest ones by vectors learnt from all documents. No SQL: singular
    vectors come from repeated products; tests hold them against a full decomposition."""

    def made() -> DataFrame:
        own = table(spark, d, "documents").select("doc_id", F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("")).alias("id"), F.lit("/").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
        have = materialise(latent.learnt(own)[1], "latent")
        queries = have.where(f"doc_id % {EVERY} = 0").select(F.col("doc_id").alias("query_id"), "embedding", F.lit("").alias("scope"))
        got = vector.top_k(queries, materialise(vector.build(have), "clusters", wide=True), 10)
        return got.select("query_id", F.when(F.col("id") != "", F.col("id").cast("long")).alias("doc_id"), F.round("score", 6).alias("score"), "rank")

    return settled(spark, "latent_topk", made)


@query("vector_scoped_topk", f"WITH {VEC} SELECT query_id, id, path, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM vr WHERE rank <= 20 AND query_id IN (3, 4)")
def _(spark, d):
    return _vec(spark, d, 20).where("query_id in (3, 4)").select("query_id", "id", "path", F.round("score", 6).alias("score"), "rank")


@query("vector_label_knn", f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % {EVERY} = 0),
  s AS (SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe), 6) DESC, lpad(CAST(vec_id AS VARCHAR), 20, '0')) AS rank FROM embeddings CROSS JOIN q)
  SELECT query_id, label, count(*) AS votes FROM s WHERE rank <= 15 GROUP BY query_id, label""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    own = e.select(F.lpad(F.col("vec_id").cast("string"), 20, "0").alias("id"), F.lit("/").alias("path"), "embedding")
    got = _nearest(spark, _every_20th(spark, d), own, 15)
    labels = e.select(F.lpad(F.col("vec_id").cast("string"), 20, "0").alias("id"), "label")
    return got.join(labels, "id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))


def _fusion_sql(u: str, x: str) -> str:
    """CTEs of the fusion of the rows of u (query_id, id, path, rank, arm): f<x> all, kk<x> classified, ranked anew and cut."""
    return f"""f00{x} AS (SELECT query_id, id, path, sum(1.0 / (60 + rank)) AS score, count(*) AS n_arms, min(rank) AS best_rank, list(DISTINCT arm) AS arms0 FROM {u} GROUP BY query_id, id, path),
  f0{x} AS (SELECT * EXCLUDE (arms0), list_filter(['path', 'bm25', 'vec'], lambda x: list_contains(arms0, x)) AS arms FROM f00{x}),
  f{x} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best_rank, id) AS rank FROM f0{x}),
  k0{x} AS (SELECT *, CASE WHEN n_arms >= 2 OR best_rank <= 5 THEN 'strong' ELSE 'weak' END AS class FROM f{x} WHERE rank <= 500),
  k{x} AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id, class ORDER BY rank) AS rank FROM k0{x}),
  kk{x} AS (SELECT * FROM k{x} WHERE rank <= CASE WHEN class = 'strong' THEN 8 ELSE 3 END)"""


ARMS = f"""{BM25}, {VEC.split(', vq AS')[1].join(['vq AS', ''])}, {_path_arm_sql('qs')},
  lex AS (SELECT query_id, id, path, rank, 'bm25' AS arm FROM bmr UNION ALL SELECT query_id, id, path, rank, 'path' FROM pr),
  u AS (SELECT * FROM lex UNION ALL SELECT query_id, id, path, rank, 'vec' FROM vr WHERE rank <= 32)"""
FUSED = f"RECURSIVE {ARMS}, {_fusion_sql('u', '')}"
_SHOW = "query_id, id, path, round(score, 6) AS score, CAST(n_arms AS INT) AS n_arms, array_to_string(arms, '+') AS arms, CAST(best_rank AS INT) AS best_rank, CAST(rank AS INT) AS rank"


def _arms(spark, d) -> dict[str, DataFrame]:
    """Path and BM25 arms come whole; the vector arm has its k, and fusion its cap."""
    q, c = searches(spark), chunks(spark, d)
    return {"path": ranks.exact_ranks(paths.path_arm(q, c)), "bm25": ranks.exact_ranks(blocks.whole_arm(q, _index(spark, d))), "vec": _vec(spark, d, 32)}


def _fused(spark, d, make) -> DataFrame:
    """What a function makes of the arms, written, so that the index and the arms can go."""
    return settled(spark, "fused", lambda: make(_arms(spark, d)))


def _show(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "path", F.round("score", 6).alias("score"), "n_arms", F.array_join("arms", "+").alias("arms"), "best_rank", "rank")


@query("rrf_fuse", f"WITH {FUSED} SELECT {_SHOW} FROM f WHERE rank <= 20")
def _(spark, d):
    return _fused(spark, d, lambda arms: _show(fuse.fuse(arms, cap=20)))


@query("rrf_min_arms", f"""WITH {FUSED}, g AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best_rank, id) AS rank FROM f WHERE n_arms >= 2)
    SELECT {_SHOW} FROM g WHERE rank <= 20""")
def _(spark, d):
    return _fused(spark, d, lambda arms: _show(fuse.fuse(arms, min_arms=2, cap=20)))


@query("hybrid_strong", f"WITH {FUSED} SELECT {_SHOW} FROM kk WHERE class = 'strong'")
def _(spark, d):
    return _fused(spark, d, lambda arms: _show(fuse.classify(fuse.fuse(arms)).where("class = 'strong'")))


@query("hybrid_weak", f"WITH {FUSED} SELECT {_SHOW} FROM kk WHERE class = 'weak'")
def _(spark, d):
    return _fused(spark, d, lambda arms: _show(fuse.classify(fuse.fuse(arms)).where("class = 'weak'")))


@query("dedupe_by_path", f"""WITH {FUSED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, class, source ORDER BY rank) AS o FROM (SELECT *, string_split(path, '/')[2] AS source FROM kk))
    SELECT query_id, class, source, id, CAST(row_number() OVER (PARTITION BY query_id, class ORDER BY rank) AS INT) AS rank FROM o WHERE o = 1""")
def _(spark, d):
    # Every file has one chunk here, so directories stand for files.
    by_source = lambda arms: fuse.classify(fuse.fuse(arms)).withColumn("path", F.split("path", "/")[1])
    return _fused(spark, d, lambda arms: fuse.dedupe_by_path(by_source(arms))).select("query_id", "class", F.col("path").alias("source"), "id", "rank")


@query("global_hit_count", f"WITH {FUSED} SELECT query_id, count(DISTINCT path) AS hits FROM kk WHERE class = 'strong' GROUP BY query_id")
def _(spark, d):
    return _fused(spark, d, fuse.strong_hits)


@query("two_phase_search", f"""WITH RECURSIVE {ARMS}, {_fusion_sql('lex', '1')}, done AS (SELECT DISTINCT query_id FROM kk1 WHERE class = 'strong'),
  u2 AS (SELECT * FROM u WHERE query_id NOT IN (SELECT query_id FROM done)), {_fusion_sql('u2', '2')}
  SELECT query_id, class, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kk1 WHERE query_id IN (SELECT query_id FROM done)
  UNION ALL SELECT query_id, class, id, round(score, 6), CAST(rank AS INT) FROM kk2""")
def _(spark, d):
    return _fused(spark, d, lambda arms: fuse.two_phase({k: arms[k] for k in ("path", "bm25")}, arms["vec"])).select("query_id", "class", "id", F.round("score", 6).alias("score"), "rank")


# --- scope, ids, tokens -------------------------------------------------------------------------------------------------


@query("scope_prefix_bleed", f"WITH {C} SELECT id, path FROM c WHERE starts_with(path, '/src1') AND NOT (path = '/src1' OR starts_with(path, '/src1/'))")
def _(spark, d):
    p = F.col("path")
    return chunks(spark, d).where(S.has_raw_prefix(p, F.lit("/src1")) & ~S.under_scope(p, F.lit("/src1"))).select("id", "path")


@query("scope_component", f"WITH {C} SELECT id, path FROM c WHERE starts_with(path, '/src1/')")
def _(spark, d):
    return chunks(spark, d).where(S.under_scope(F.col("path"), F.lit("/src1/"))).select("id", "path")


_DIRS = f"{C}, a AS (SELECT unnest(['', '/', '/' || source, '/' || source || '/' || lang]) AS dir FROM c), dc AS (SELECT dir, count(*) AS chunks FROM a GROUP BY dir)"


@query("dir_counts", f"WITH {_DIRS} SELECT dir, chunks FROM dc")
def _(spark, d):
    return sync.dir_counts(chunks(spark, d).select("path", F.lit(1).cast("long").alias("n_chunks")))


@query("scope_fraction", f"WITH {_DIRS} SELECT round((SELECT chunks FROM dc WHERE dir = '/src3') / (SELECT chunks FROM dc WHERE dir = ''), 9) AS fraction")
def _(spark, d):
    counts = sync.dir_counts(chunks(spark, d).select("path", F.lit(1).cast("long").alias("n_chunks")))
    return sync.scope_fraction(counts, "/src3").select(F.round("fraction", 9).alias("fraction"))


@query("count_under", f"WITH {C} SELECT count(*) FILTER (starts_with(path, '/src2/')) AS n_under, count(*) AS n_all FROM c")
def _(spark, d):
    return sync.count_under(chunks(spark, d), F.lit("/src2"))


@query("chunk_ids", f"WITH {C} SELECT doc_id, path, id FROM c")
def _(spark, d):
    return chunks(spark, d).select("doc_id", "path", "id")


@query("token_estimate", "SELECT doc_id, CAST(length(coalesce(text, '')) // 4 AS INT) AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("token_budget_prefix", f"""WITH {C}, r AS (SELECT source, doc_id, sum(length(content) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM c)
    SELECT source, doc_id, CAST(total AS BIGINT) AS total FROM r WHERE total + 50 <= 4000""")
def _(spark, d):
    ranked = chunks(spark, d).select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), "content")
    return chunking.token_budget(ranked, 50, 4000).select(F.col("query_id").alias("source"), F.col("rank").alias("doc_id"), F.col("total").cast("long").alias("total"))


@query("where_equality", f"WITH {C} SELECT id, path FROM c WHERE source = 'src1' AND lang = 'en'")
def _(spark, d):
    return store.where_equal(chunks(spark, d), source="src1", lang="en").select("id", "path")


@query("get_by_ids", f"WITH {C} SELECT doc_id AS pos, id, path FROM (SELECT DISTINCT doc_id FROM labels) JOIN c USING (doc_id)")
def _(spark, d):
    own = chunks(spark, d)
    ids = table(spark, d, "labels").select("doc_id").distinct().join(own.select("doc_id", "id"), "doc_id").select(F.col("doc_id").alias("pos"), "id")
    return store.by_ids(own.select("id", "path"), ids).select("pos", "id", "path")


@query("missing_ids", f"WITH {C}, v AS (SELECT '/gone/doc' || vec_id AS p, vec_id FROM embeddings) SELECT (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS missing")
def _(spark, d):
    own = chunks(spark, d).select(F.col("doc_id").cast("string").alias("id"))
    return store.missing_ids(own, table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id")))


@query("path_parts", f"WITH {C} SELECT id, string_split(path, '/')[-1] AS base, '/' || source || '/' || lang AS dir, '.txt' AS ext FROM c")
def _(spark, d):
    p = F.col("path")
    return chunks(spark, d).select("id", S.base_name(p).alias("base"), S.dir_name(p).alias("dir"), S.extension(p).alias("ext"))


@query("display_path", f"WITH {C} SELECT id, CASE WHEN starts_with(path, '/src1/') THEN '~' || path[6:] ELSE path END AS shown FROM c")
def _(spark, d):
    return chunks(spark, d).select("id", S.display_path(F.col("path"), "/src1").alias("shown"))


@query("metadata_round_trip", f"WITH {C} SELECT id, 'line_range' AS kind, 1 AS start, CAST(len(string_split(content, chr(10))) AS INT) AS \"end\" FROM c")
def _(spark, d):
    loc = F.struct(F.lit("line_range").alias("kind"), F.lit(1).alias("start"), F.size(F.split("content", "\n")).alias("end"), F.lit("").alias("symbol"))
    return chunks(spark, d).select("id", S.decode_metadata(S.encode_metadata(F.col("path"), loc)).alias("m")).select("id", "m.kind", "m.start", "m.end")


# --- text, segments, excerpts -------------------------------------------------------------------------------------------

_CLEAN = r"regexp_replace(regexp_replace(content, '\r+\n', chr(10), 'g'), '\n\z', '')"


@query("line_explode", f"WITH {C}, l AS (SELECT id, unnest(string_split({_CLEAN}, chr(10))) AS line FROM c) SELECT id, count(*) AS n_lines, CAST(max(length(line)) AS INT) AS longest FROM l GROUP BY id")
def _(spark, d):
    return chunking.lines_of(chunks(spark, d).select("id", "content")).groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest"))


CODE = [
    ("/a/x.py", "import os\n\ndef one(a):\n    return a\n\nclass Two:\n    def inner(self):\n        pass\n"), ("/a/y.rs", "pub fn three() {\n}\nimpl Four {\n}\n\n"), ("/a/z.sh", "echo only\n"), ("/a/w.js", "function five(x) { return x }\nfunc\n"),
]
KEYED = [
    ("/c/a.json", '{\n  "name": "x",\n  "deep": {\n    "inner": 1,\n      "far": 2\n  }\n}\n'), ("/c/b.yaml", "top: 1\n  sub: 2\n# note\nnext:\n  - a\n"), ("/c/c.toml", "title = 1\n[owner]\nname = 2\n\n[db.x]\nport = 3\n"), ("/c/d.yml", "\n\n"),
]


def _segment_sql(rows: list[tuple], boundary: str, label: str, shown: str) -> str:
    return f"""WITH f AS (SELECT * FROM {literal(rows)} AS v(path, content)), l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM f),
    b AS (SELECT *, ({boundary}) AS b, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM l), s AS (SELECT *, sum(b::INT) OVER (PARTITION BY path ORDER BY k) AS seg FROM b),
    g AS (SELECT path, seg, CAST(min(k) AS INT) AS start, CAST(max(k) AS INT) AS "end", arg_min(CASE WHEN b THEN {label} END, k) AS label0, max(CASE WHEN b THEN {label} END) AS label, string_agg(line, chr(10) ORDER BY k) || chr(10) AS content FROM s GROUP BY path, seg)
    SELECT path, start, "end", {shown} FROM g WHERE length(regexp_replace(content, '\\s', '', 'g')) > 0"""


_DECL_SQL = r"regexp_matches(line, '^(func|def|class|function|fn|type|impl|pub\s+fn)\s+([a-zA-Z0-9_:]+)')"


@query("segment_code", _segment_sql(CODE, _DECL_SQL, "trim(regexp_extract(line, '^([^{:]*)', 1))", "coalesce(label, '') AS symbol, CASE WHEN coalesce(label, '') <> '' THEN 'symbol' ELSE 'line_range' END AS kind, content"))
def _(spark, d):
    return chunking.segment_code(spark.createDataFrame(CODE, "path string, content string"))


_E = "regexp_extract(path, '(\\.[^./]*)$', 1)"
_JSON, _YAML, _TOML = r"'^\s*\"([^\"]+)\"\s*:'", r"'^([a-zA-Z0-9_-]+)\s*:'", r"'^(?:\[([a-zA-Z0-9_.-]+)\]|([a-zA-Z0-9_-]+)\s*=)'"
_KEY_SQL = f"length(regexp_extract(line, '^([ \\t]*)', 1)) <= 4 AND (({_E} = '.json' AND regexp_matches(line, {_JSON})) OR ({_E} IN ('.yaml', '.yml') AND regexp_matches(line, {_YAML})) OR ({_E} = '.toml' AND regexp_matches(line, {_TOML})))"
_KEY_NAME = f"CASE ext WHEN '.json' THEN regexp_extract(line, {_JSON}, 1) WHEN '.toml' THEN coalesce(nullif(regexp_extract(line, {_TOML}, 1), ''), regexp_extract(line, {_TOML}, 2)) ELSE regexp_extract(line, {_YAML}, 1) END"


@query("segment_structured", _segment_sql(KEYED, _KEY_SQL, _KEY_NAME, "label AS key, CASE WHEN label IS NOT NULL THEN label || chr(10) || content ELSE content END AS content"))
def _(spark, d):
    return chunking.segment_structured(spark.createDataFrame(KEYED, "path string, content string"))


@query("chunk_text_stats")
def _(spark, d):
    got = chunking.chunk_files(chunks(spark, d).select("path", "content"))
    return got.groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"), F.max("locator.end").alias("last_line"))


@query("chunk_fragments")
def _(spark, d):
    return chunks(spark, d).select("id", F.size(chunking.fragments_column(F.col("content"))).alias("n_fragments"))


@query("excerpt_prose", f"""WITH {C}, l AS (SELECT id, string_split(content, chr(10)) AS ls FROM c), s AS (SELECT id, ls, CAST(least(2, len(ls)) AS INT) AS s FROM l),
  b AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda k: trim(regexp_replace(ls[k], '\\s', ' ', 'g')) = '') AS bl FROM s),
  h AS (SELECT *, coalesce(list_max(list_filter(bl, lambda k: k <= s - 1)), 0) + 1 AS lo0, coalesce(list_min(list_filter(bl, lambda k: k > s)), len(ls) + 1) - 1 AS hi0 FROM b),
  g AS (SELECT *, greatest(least(lo0, s), least(s, s - 11)) AS st FROM h), e AS (SELECT *, least(greatest(hi0, s), greatest(s, st + 11)) AS en FROM g)
  SELECT id, CAST(st AS INT) AS start_line, CAST(en AS INT) AS end_line, array_to_string(ls[st:en], chr(10)) AS excerpt FROM e""")
def _(spark, d):
    return _expanded(spark, d).select("id", "start_line", "end_line", "excerpt")


def _expanded(spark, d) -> DataFrame:
    lines = F.split("content", "\n")
    at = F.least(F.lit(2), F.size(lines))
    loc = F.struct(F.lit("line_range").alias("kind"), at.alias("start"), at.alias("end"), F.lit("").alias("symbol"))
    df = chunks(spark, d).select("id", "path", F.element_at(lines, at).alias("line"), loc.alias("locator"), F.col("content").alias("source"))
    return excerpt.expand(df.withColumnRenamed("line", "content"))


@query("excerpt_render")
def _(spark, d):
    return excerpt.render(_expanded(spark, d), info=F.lit("(bm25, rank 1)")).select("id", "rendered")


# --- sync -----------------------------------------------------------------------------------------------------------------
# On record: the labelled documents, with another hash where their quality is 0. Seen: all documents.


def _seen(spark, d) -> DataFrame:
    return chunks(spark, d).select("doc_id", "path", F.length("content").cast("long").alias("size"), F.col("doc_id").alias("mtime_ns"), F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def _recorded(spark, d) -> DataFrame:
    q = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return _seen(spark, d).join(q, "doc_id").select("path", "size", F.when(F.col("quality") == 0, F.lit(-1)).otherwise(F.col("mtime_ns")).cast("long").alias("mtime_ns"), F.when(F.col("quality") == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"), F.lit(1).cast("long").alias("n_chunks"))


_STATUS = f"{C}, ql AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id), st AS (SELECT path, CASE WHEN quality IS NULL THEN 'added' WHEN quality = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM c LEFT JOIN ql USING (doc_id))"


@query("change_classify", f"WITH {_STATUS} SELECT path, status FROM st")
def _(spark, d):
    return sync.classify_changes(_seen(spark, d), _recorded(spark, d)).select("path", "status")


@query("orphans", f"WITH {C} SELECT path FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND (starts_with(path, '/src1/') OR starts_with(path, '/src2/en/'))")
def _(spark, d):
    roots = spark.createDataFrame([("/src1/",), ("/src2/en",)], "root string")
    return sync.orphans(_seen(spark, d), _recorded(spark, d), roots).select("path")


@query("sync_summary", f"""WITH {_STATUS} SELECT count(*) AS scanned, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'added') AS added,
    (SELECT count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS removed, (SELECT count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS removed_chunks FROM st""")
def _(spark, d):
    seen, known = _seen(spark, d), _recorded(spark, d)
    gone = sync.orphans(seen.withColumn("n_chunks", F.lit(1).cast("long")), known, spark.createDataFrame([("/",)], "root string"))
    return sync.run_summary(sync.classify_changes(seen, known), gone)


@query("is_stale", f"WITH {_STATUS} SELECT count(*) FILTER (status <> 'unchanged') > 0 OR (SELECT count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels)) > 0 AS stale FROM st")
def _(spark, d):
    seen, known = _seen(spark, d), _recorded(spark, d)
    gone = sync.orphans(seen, known, spark.createDataFrame([("/",)], "root string"))
    return spark.createDataFrame([(sync.is_stale(sync.classify_changes(seen, known), gone),)], "stale boolean")


@query("roots_merge", "SELECT DISTINCT root FROM (SELECT '/' || source AS root FROM documents UNION ALL SELECT '/' || source || '/' || lang FROM documents UNION ALL SELECT '/' || source FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents")
    one = docs.select(F.concat(F.lit("/"), "source").alias("root"))
    return sync.merge_roots(one.union(docs.select(F.concat(F.lit("/"), "source", F.lit("/"), "lang"))), one)


@query("transient_evict", """WITH r AS (SELECT 'user' || user_id AS root, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_access FROM events GROUP BY user_id), n AS (SELECT max(last_access) AS now FROM r),
    o AS (SELECT root, last_access, last_access < now - 86400 AS old FROM r, n), k AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY last_access DESC, root) AS n FROM o)
    SELECT root, last_access, CASE WHEN old THEN 'age' ELSE 'count' END AS reason FROM k WHERE old OR n > 40""")
def _(spark, d):
    roots = table(spark, d, "events").groupBy("user_id").agg(F.unix_timestamp(F.max("ts")).alias("last_access")).select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("root"), "last_access")
    now = roots.agg(F.max("last_access")).first()[0] or 0
    return sync.expired_roots(roots, now, 1, 40)


@query("identity_check", "SELECT * FROM (VALUES ('embedding_model', 'a', 'b'), ('chunker_version', '3', '2')) AS v(field, stored, wanted)")
def _(spark, d):
    from sparkseek.schemas import IDENTITY

    return sync.identity_differences(spark.createDataFrame([("a", 64, "p", 3)], IDENTITY), spark.createDataFrame([("b", 0, "p", 2)], IDENTITY))


@query("admit_filter", """SELECT page_id FROM pages WHERE strlen(coalesce(html, '')) <= 1048576 AND position(chr(0) IN coalesce(html, '')) = 0""")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("b"))
    # A page is a column, not a file to be opened, so all of it is sniffed, as in the SQL.
    return p.where(walk.admitted(F.lit("/page.txt"), F.octet_length("b"), F.col("b"), max_mb=1, sniff=None)).select("page_id")


SECRETS = [("/h/.ssh/id",), ("/h/a.pem",), ("/h/x.key/y",), ("/h/.env.local",), ("/h/.aws/credentials",), ("/h/ok.txt",), ("/h/envy",), (".env",), ("/h/.gnupg",), ("/h/keys/a.txt",)]


@query("secrets_filter", f"SELECT path FROM {literal(SECRETS)} AS v(path) WHERE regexp_matches(path, '(^|/)(\\.ssh|\\.gnupg|[^/]*\\.pem|[^/]*\\.key|\\.env[^/]*)(/|$)') OR contains(path, '/.aws/credentials') UNION ALL SELECT url FROM pages WHERE regexp_matches(url, '(^|/)(\\.ssh|\\.gnupg|[^/]*\\.pem|[^/]*\\.key|\\.env[^/]*)(/|$)')")
def _(spark, d):
    p = spark.createDataFrame(SECRETS, "path string").union(table(spark, d, "pages").select("url"))
    return p.where(S.is_secret_path(F.col("path")))


RULES = [(1, "(^|/)src1[^/]*(/|$)", False, False), (2, "/en/", True, False), (3, "/doc7[^/]*$", False, False), (4, "(^|/)src2$", False, True)]


@query("ignore_last_match", f"""WITH {C}, r AS (SELECT * FROM {literal(RULES)} AS v(pos, regex, negate, dir_only)), m AS (SELECT path, arg_max(NOT negate, pos) AS ignored FROM c JOIN r ON regexp_matches(path, regex) AND NOT dir_only GROUP BY path)
    SELECT path, coalesce(ignored, false) AS ignored FROM c LEFT JOIN m USING (path)""")
def _(spark, d):
    rules = spark.createDataFrame(RULES, "pos int, regex string, negate boolean, dir_only boolean")
    return walk.last_match_wins(chunks(spark, d).select("path", F.lit(False).alias("is_dir")), rules).select("path", "ignored")


@query("hard_ignored", "SELECT page_id, regexp_matches(lower(url), '\\.(jpg|png|gif|mp4|mp3|zip|tar|gz|7z|o|so|exe|bin|dylib|class|pyc|wasm|pem|key)$') AS ignored FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", walk.hard_ignored(F.col("url")).alias("ignored"))


# --- router and session ---------------------------------------------------------------------------------------------------

SAID = [(k, x) for k, x in enumerate([
    "open main.go", "open the door please", "read src/a.py", "cat notes", "show me the thing", "ls docs/", "list all of it", "head 20 a.txt", "tail -5 log", "find *.md files", "find the meaning of life",
    "copy that", "copy the third one", "copy the whole thing there", "  open  x  ", "Open x", "where is the parser", "copy #3", "head x a.txt",
])]


def _rule_sql(pattern: str, guard: str, made: str) -> str:
    return f"WHEN regexp_matches(s, '{pattern}') AND ({guard}) THEN {made}"


_ARG = r"regexp_extract(s, '{p}', {g})"
_SHAPED = r"(contains({a}, '/') OR regexp_matches(lower({a}), '\.(txt|md|pdf|go|py|js|ts|rs|sh|c|java|json|yaml|yml|toml)$') OR NOT contains({a}, ' '))"
_NORM = r"regexp_replace(regexp_replace(lower(trim({a})), '^[\"''`.,;!?]+', ''), '[\"''`.,;!?]+$', '')"
_ORD = r"trim(regexp_replace(regexp_replace({n}, '^the ', ''), ' one$', ''))"
_REF = r"""({n} <> '' AND ({n} IN ('it', 'that', 'this', 'the file', 'the match', 'the excerpt', 'the result', 'selected', 'current', 'last', 'the last', 'the last one', 'last one')
  OR {o} IN ('first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth')
  OR coalesce(try_cast(nullif(regexp_extract({o}, '^#?(\d+)(?:st|nd|rd|th)?$', 1), '') AS INT) BETWEEN 1 AND 99, false)
  OR regexp_matches({n}, '^(?:that|the|this)\s+([a-zA-Z0-9_.-]+)(?:\s+file|\s+code|\s+document)?$')))"""


def _ref_sql(a: str) -> str:
    n = _NORM.format(a=a)
    return _REF.replace("{o}", _ORD.format(n=n)).replace("{n}", n)


def _fast_sql(source: str) -> str:
    parts = []
    for p, action, g in ((r"^open\s+(.+)$", "open", 1), (r"^(?:read|show|cat)\s+(.+)$", "read", 1), (r"^(?:ls|list)\s+(.+)$", "list", 1), (r"^head\s+(-?\d+)\s+(.+)$", "read", 2), (r"^tail\s+(-?\d+)\s+(.+)$", "read", 2), (r"^find\s+(.+)$", "locate", 1), (r"^copy\s+(.+)$", "copy", 1)):
        a = _ARG.format(p=p, g=g)
        guard = _SHAPED.format(a=a)
        if action == "locate":
            guard += f" OR regexp_matches({a}, '[*?\\[]')"
        if action == "copy":
            guard += f" OR {_ref_sql(a)}"
        lines = _ARG.format(p=p, g=1) if g == 2 else "NULL::VARCHAR"
        made = f"{{'action': '{action}', 'query': {a if action == 'locate' else 'NULL::VARCHAR'}, 'path': {'NULL::VARCHAR' if action == 'locate' else a}, 'lines': {lines}}}"
        parts.append(_rule_sql(p, guard, made))
    return f"WITH u AS ({source}), s AS (SELECT *, regexp_replace(regexp_replace(input, '^\\s+', ''), '\\s+$', '') AS s FROM u), i AS (SELECT *, CASE {' '.join(parts)} END AS i FROM s)"


@query("intent_fastpath", _fast_sql(f"SELECT * FROM {literal(SAID)} AS v(n, input)") + " SELECT n, i.action AS action, i.query AS query, i.path AS path, i.lines AS lines FROM i")
def _(spark, d):
    return spark.createDataFrame(SAID, "n int, input string").select("n", router.fast_path(F.col("input")).alias("i")).select("n", "i.*")


@query("intent_conversations", _fast_sql("SELECT conv_id, turn, coalesce(text, '') AS input FROM conversations") + " SELECT conv_id, turn, coalesce(i.action, 'excerpt') AS action, CASE WHEN i IS NULL THEN 2 ELSE 1 END AS tier FROM i")
def _(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("input"))
    return router.route(t).select("conv_id", "turn", F.col("intent.action").alias("action"), "tier")


REFS = [(k, x) for k, x in enumerate(["it", "The file.", "last", "the last one", "third", "the 2nd one", "#4", "99", "100", "#0", "that pdf", "the markdown file", "this report", "what about it", "", "\"that\"", "tenth", "the notes file"])]
LISTED = ["/d/notes.md", "/d/report.pdf", "/d/main.go", "/d/b.md"]


@query("explicit_ref", f"SELECT n, {_ref_sql('ref')} AS explicit FROM {literal(REFS)} AS v(n, ref)")
def _(spark, d):
    return spark.createDataFrame(REFS, "n int, ref string").select("n", router.is_explicit_ref(F.col("ref")).alias("explicit"))


@query("resolve_ref", f"""WITH r AS (SELECT *, {_NORM.format(a='ref')} AS norm FROM {literal(REFS)} AS v(n, ref)), o AS (SELECT *, {_ORD.format(n='norm')} AS ord, try_cast(nullif(regexp_extract({_ORD.format(n='norm')}, '^#?(\\d+)(?:st|nd|rd|th)?$', 1), '') AS INT) AS num FROM r)
  SELECT n, CAST(CASE WHEN norm = '' THEN NULL WHEN norm IN ('it', 'that', 'this', 'the file', 'the match', 'the excerpt', 'the result', 'selected', 'current') THEN 1
    WHEN norm IN ('last', 'the last', 'the last one', 'last one') THEN 3
    WHEN ord IN ('first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth') THEN CASE ord WHEN 'first' THEN 0 WHEN 'second' THEN 1 WHEN 'third' THEN 2 WHEN 'fourth' THEN 3 END
    WHEN num >= 1 THEN CASE WHEN num <= 4 THEN num - 1 END
    WHEN norm IN ('that pdf', 'this report') THEN 1 WHEN norm IN ('the markdown file', 'the notes file') THEN 0 END AS INT) AS idx FROM o""")
def _(spark, d):
    items = F.array(*[F.lit(x) for x in LISTED])
    return spark.createDataFrame(REFS, "n int, ref string").select("n", router.resolve_ref(F.col("ref"), items, F.lit(1)).cast("int").alias("idx"))


RANGES = [(k, x) for k, x in enumerate(["41-47", "41", "41-", "-47", "0", "5-2", "a", "", "-0", " 7-9 ", "0-4"])]


@query("parse_line_range", f"""WITH r AS (SELECT n, trim(s) AS s FROM {literal(RANGES)} AS v(n, s)), p AS (SELECT *, CASE WHEN regexp_matches(s, '^\\d+$') THEN s::INT WHEN regexp_matches(s, '^\\d+-\\d*$') THEN regexp_extract(s, '^(\\d+)', 1)::INT WHEN regexp_matches(s, '^-\\d+$') THEN 1 END AS a,
    CASE WHEN regexp_matches(s, '^\\d+$') THEN s::INT WHEN regexp_matches(s, '^\\d+-\\d+$') THEN regexp_extract(s, '-(\\d+)$', 1)::INT WHEN regexp_matches(s, '^\\d+-$') THEN 0 WHEN regexp_matches(s, '^-\\d+$') THEN s[2:]::INT END AS z FROM r)
    SELECT n, CASE WHEN ok THEN a END AS start, CASE WHEN ok THEN z END AS "end" FROM (SELECT *, coalesce(a >= 1 AND (z >= a OR (z = 0 AND regexp_matches(s, '^\\d+-$'))), false) AS ok FROM p)""")
def _(spark, d):
    return spark.createDataFrame(RANGES, "n int, s string").select("n", S.line_range(F.col("s")).alias("r")).select("n", "r.start", "r.end")


# --- metrics and formats --------------------------------------------------------------------------------------------------

CASES = [("open main.go", "open", "main.go", 1), ("read src/a.py", "read", "src/a.py", 1), ("where is it", "locate", None, 2), ("find *.md", "locate", None, 1), ("copy that", "copy", "that", 1), ("ls docs/", "list", "other", 1)]


@query("metrics_accuracy", "SELECT 6::BIGINT AS n, round(500 / 6.0, 6) AS action_accuracy, round(400 / 6.0, 6) AS param_accuracy, round(500 / 6.0, 6) AS tier1_rate, 6::BIGINT AS tier_matches")
def _(spark, d):
    rows = [(i, (a, None, p, None), t) for i, a, p, t in CASES]
    cases = spark.createDataFrame(rows, "input string, expected struct<action:string,query:string,path:string,lines:string>, tier int")
    r = evaluation.intent_metrics(cases)
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("action_accuracy", "param_accuracy", "tier1_rate")], "tier_matches")


@query("metrics_recall", f"""WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(content) DESC, path) AS rank FROM c), e AS (SELECT source, min(doc_id) AS want FROM c GROUP BY source)
    SELECT source AS query_id, coalesce(bool_or(doc_id = want AND rank <= 1), false) AS hit_1, coalesce(bool_or(doc_id = want AND rank <= 3), false) AS hit_3 FROM r JOIN e USING (source) GROUP BY source""")
def _(spark, d):
    c = chunks(spark, d)
    w = Window.partitionBy("source").orderBy(F.desc(F.length("content")), "path")
    results = c.select(F.col("source").alias("query_id"), "path", F.row_number().over(w).alias("rank"))
    cases = c.groupBy(F.col("source").alias("query_id")).agg(F.min_by("path", "doc_id").alias("expect_path"))
    return evaluation.hits_at(cases, results)


@query("latency_percentiles", "SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY event_type")
def _(spark, d):
    return percentiles.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("path_match", f"WITH {C} SELECT id, ends_with(path, 'doc7.txt') AS ok FROM c")
def _(spark, d):
    return chunks(spark, d).select("id", S.path_matches(F.col("path"), F.lit("doc7.txt")).alias("ok"))


@query("human_bytes", "SELECT doc_id, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', n / 1024.0::DOUBLE) ELSE printf('%.1fMB', n / 1048576.0::DOUBLE) END AS shown FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.human_bytes(F.octet_length(F.coalesce("text", F.lit("")))).alias("shown"))


@query("human_int", "SELECT event_id, format('{:,}', event_id * 1234) AS shown FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.human_int(F.col("event_id") * 1234).alias("shown"))


@query("format_duration", "SELECT event_id, CASE WHEN v < 1 THEN CAST(floor(v * 1000) AS BIGINT) || 'ms' ELSE printf('%.1fs', v) END AS shown FROM (SELECT event_id, CAST(event_id % 5000 AS DOUBLE) / 1000 + 0.0001 AS v FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.format_duration((F.col("event_id") % 5000).cast("double") / 1000 + 0.0001).alias("shown"))


@query("list_dir", f"""WITH {C}, e AS (SELECT string_split(path, '/')[-1] AS name, path, false AS is_dir, CAST(length(content) AS BIGINT) AS size FROM c WHERE source = 'src1'
    UNION ALL SELECT DISTINCT lang, '/src1/' || lang, true, CAST(NULL AS BIGINT) FROM c WHERE source = 'src1')
    SELECT name, path, is_dir, size, CAST(CASE WHEN path IN (SELECT path FROM c JOIN labels USING (doc_id)) THEN 1 ELSE 0 END AS INT) AS chunks, NOT (path = '/src1/en' OR starts_with(path, '/src1/en/')) AS outside_scope FROM e""")
def _(spark, d):
    # The documents of a source and their directories; on record are those with labels.
    own = chunks(spark, d)
    here = own.where("source = 'src1'")
    entries = here.select(S.base_name(F.col("path")).alias("name"), "path", F.lit(False).alias("is_dir"), F.length("content").cast("long").alias("size"))
    folders = here.select(F.col("lang").alias("name"), S.dir_name(F.col("path")).alias("path"), F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size")).distinct()
    files = own.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id").select("path", F.array("id").alias("chunks"))
    return sources.listed(entries.unionByName(folders), files, "/src1/en")


@query("bm25_batch_200", f"""WITH {C}, q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_CLASS}')) AS term FROM benchmark) GROUP BY ALL),
  tk AS (SELECT id, path, {TOK} AS tok FROM c), tf AS (SELECT id, path, len(tok) AS dl, unnest(tok) AS term FROM tk), n AS (SELECT id, path, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM n GROUP BY term), st AS (SELECT count(*) AS n, avg(len(tok)) AS avgdl FROM tk),
  bm AS (SELECT item_id, id, path, sum(qtf * ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM n JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm)
  SELECT item_id AS query_id, id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def _(spark, d):
    # Every benchmark item as a query, in one batch.
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("").alias("scope"))
    return _top_k(spark, d, q, 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")
