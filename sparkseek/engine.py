"""The engine: index, sync, locate, excerpt, read, list, status, eval. One store per engine; every search takes a table of queries."""

from __future__ import annotations

import functools
import os
import time
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek import schemas
from sparkseek.functions import scalars as S
from sparkseek.functions.sizes import if_small
from sparkseek.operators import chunking, evaluation, excerpt, fuse, lexical, paths, ranks, router, sync, vector
from sparkseek.operators.embed import CACHED, Embedder, HashingEmbedder, QueryCache, embed_chunks, embed_queries
from sparkseek.operators.store import Store
from sparkseek.sources import files as sources
from sparkseek.sources import walk
from sparkseek.session import materialise, scratch, settled

PREFIX_SCHEME, CHUNKER_VERSION = "search-prefix-v1", 3


def _parts(files: int) -> int:
    """Parts in which files are read: one for each up to 200, and then one for each 100."""
    return max(1, min(files, 200), files // 100)


class IdentityError(RuntimeError):
    """The index was made with another model, dimension, prefix scheme or chunker."""


def _tidy(method):
    """What a method writes on its way is deleted when it ends; its result must not need that."""

    @functools.wraps(method)
    def run(self, *args, **named):
        with scratch(self.spark):
            return method(self, *args, **named)

    return run


class Engine:
    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, config: dict | None = None, pdf_parser: sources.PdfParser | None = None, chat_model=None):
        self.spark, self.store = spark, Store(spark, folder)
        self.embedder = embedder or HashingEmbedder()
        self.config = config or sources.load_config(None)
        self.pdf_parser, self.chat_model = pdf_parser, chat_model
        self.cache = QueryCache(self.embedder)
        self.session = router.Session()
        c = self.config["chunking"]
        self.chunking = chunking.Chunking(c["max_tokens"], c["overlap_tokens"], c["min_tokens"])

    # --- indexing ---

    def _identity(self) -> DataFrame:
        return self.spark.createDataFrame([(self.embedder.name, self.embedder.dim, PREFIX_SCHEME, CHUNKER_VERSION)], schemas.IDENTITY)

    def check_identity(self) -> None:
        if self.store.exists():
            moved = sync.identity_differences(self.store.table("identity"), self._identity()).collect()
            if moved:
                raise IdentityError("; ".join(f"{r.field}: {r.stored} is now {r.wanted}" for r in moved) + "; reindex to go on")

    def index(self, roots: list[str], dry_run: bool = False, exclude: str = "", transient: bool = False) -> dict:
        """Adds what is new or changed below the roots."""
        return self._run(roots, "index", dry_run, exclude, transient)

    def sync(self, roots: list[str] | None = None) -> dict:
        """Adds and updates, removes what is gone, and drops transient roots that have expired."""
        return self._run(roots if roots is not None else self.roots(), "sync")

    def reindex(self, roots: list[str] | None = None) -> dict:
        """Drops what is on record below the roots first, whatever it was made with."""
        return self._run(roots if roots is not None else self.roots(), "reindex")

    def roots(self) -> list[str]:
        return sorted(r.root for r in self.store.table("roots").collect())

    @_tidy
    def _run(self, roots: list[str], mode: str, dry_run: bool = False, exclude: str = "", transient: bool = False) -> dict:
        began = time.time()
        if mode != "reindex":
            self.check_identity()
        roots = [os.path.abspath(os.path.expanduser(r)) for r in roots]
        excludes = walk.Excludes(**self.config["exclude"]).with_flag(exclude)
        found, failed, bad = [], [], []
        for r in roots:  # a root that can't be read isn't reconciled, so its files stay
            try:
                found += list(walk.walk([r], excludes, self.config["index"]["follow_symlinks"]))
            except OSError as e:
                failed.append(r)
                bad.append((r, str(e)))
        seen = self.spark.createDataFrame(sorted(set(found)), "path string, size bigint, mtime_ns bigint")
        ok_roots = self.spark.createDataFrame([(r,) for r in roots if r not in failed], "root string")
        known = self.store.table("files")
        if mode == "reindex":
            known = known.join(sync.under_roots(known, ok_roots).select("path"), "path", "left_anti")
        allowed = tuple(self.config["index"]["extensions"]) or walk.ALLOWED
        # Size and time decide first; only the others are read.
        same = seen.join(known.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"])
        maybe = seen.join(same.select("path"), "path", "left_anti")
        read = sources.read_files(maybe.repartition(_parts(maybe.count())))
        read = materialise(read.where(F.col("error").isNotNull() | walk.admitted(F.col("path"), F.col("size"), F.col("content"), self.config["index"]["max_file_size_mb"], allowed)), "read")
        status = sync.classify_changes(read.where("error is null").drop("content"), known)
        gone = sync.orphans(known, seen, ok_roots) if mode != "index" else known.limit(0)
        expired = self._expired() if mode == "sync" else self.spark.createDataFrame([], "root string, last_access bigint, reason string")
        gone = gone.unionByName(sync.under_roots(known.where("transient"), expired)).dropDuplicates(["path"])
        n_same = same.count()
        summary = sync.run_summary(status, gone.withColumn("n_chunks", F.size("chunks"))).first().asDict()
        summary["scanned"] += n_same
        summary["unchanged"] += n_same
        if dry_run:
            return summary | {"would_index": sorted(r.path for r in status.where("status <> 'unchanged'").select("path").collect()), "elapsed": time.time() - began}
        changed = read.join(status.where("status <> 'unchanged'").select("path", "status"), "path")
        pdf = S.extension(F.col("path")) == ".pdf"
        pages = materialise(sources.pdf_pages(changed.where(pdf), self.pdf_parser), "pages")
        texts = changed.where(~pdf).select("path", sources.parsed_text(F.col("content")).alias("content"))
        made = chunking.chunk_files(texts, self.chunking).unionByName(chunking.chunk_pages(pages.where("error is null"), self.chunking))
        bad_files = read.where("error is not null").select("path", F.col("error").alias("reason")).union(pages.where("error is not null").select("path", F.col("error")))
        done = changed.join(bad_files, "path", "left_anti")
        old_flag = known.select("path", F.col("transient").alias("_t"))
        made = materialise(embed_chunks(made, self.embedder).withColumn("transient", F.lit(transient)), "made")
        ids = made.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("chunks"))
        rows = done.join(ids, "path", "left").join(old_flag, "path", "left").select("path", "mtime_ns", "size", "hash", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"), F.coalesce("_t", F.lit(transient)).alias("transient"))
        # Times that moved without a change of content are noted, so that they aren't read again.
        moved = status.where("status = 'unchanged'").select("path", F.col("mtime_ns").alias("_m"))
        files = materialise(known.join(moved, "path").withColumn("mtime_ns", F.col("_m")).select(*known.columns).unionByName(rows), "files")
        stale = gone.select("path").union(rows.select("path"))
        if mode == "reindex":
            stale = stale.union(self.store.table("files").join(known.select("path"), "path", "left_anti").select("path"))
        stale = materialise(stale.distinct(), "stale")
        chunks = made.join(rows.select("path", F.col("transient").alias("_t")), "path").withColumn("transient", F.col("_t"))
        quarantine = bad_files.union(self.spark.createDataFrame(bad, "path string, reason string")).withColumn("time", F.current_timestamp())
        now = int(time.time())
        kept = self.store.table("roots").join(expired.select("root"), "root", "left_anti")
        new = ok_roots.join(kept, "root", "left_anti").join(expired.select("root"), "root", "left_anti").withColumn("last_access", F.lit(now if transient else None).cast("bigint"))
        self.store.commit({"chunks": stale, "files": stale.union(files.select("path"))}, chunks=chunks, files=files, identity=self._identity(), roots=kept.unionByName(new), quarantine=quarantine)
        summary |= {"indexed": rows.count(), "chunks": made.count(), "quarantined": quarantine.count(), "elapsed": time.time() - began}
        return summary

    def _expired(self) -> DataFrame:
        t = self.config["transient"]
        return sync.expired_roots(self.store.table("roots").where("last_access is not null"), int(time.time()), t["retention_days"], t["max_roots"])

    def touch(self, path: str) -> None:
        roots = self.store.table("roots")
        own = roots.where("last_access is not null")
        self.store.commit(roots=roots.where("last_access is null").unionByName(sync.touch_roots(own, path, int(time.time()))))

    # --- search ---

    def queries(self, texts: list[str] | str, scope: str = "") -> DataFrame:
        texts = [texts] if isinstance(texts, str) else texts
        return self.spark.createDataFrame([(k, t, scope) for k, t in enumerate(texts)], "query_id int, query string, scope string")

    def _lexical(self, queries: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
        """Whole arms: fusion needs every rank. Words are looked up in the stored postings."""
        return {"path": ranks.exact_ranks(paths.path_arm(queries, chunks)), "bm25": ranks.exact_ranks(lexical.bm25_stored(queries, *self.store.postings()))}

    def _embedded(self, queries: DataFrame) -> DataFrame:
        """query_id, embedding, scope; worked out here, so that an embedder that fails does so now. Few queries go through the cache, many to
        the executors."""
        rows = queries.select("query_id", "query", "scope").limit(CACHED + 1).collect()
        if len(rows) <= CACHED:
            return self.spark.createDataFrame([(r.query_id, list(self.cache.get(r.query)), r.scope) for r in rows], "query_id int, embedding array<double>, scope string")
        return materialise(embed_queries(queries.select("query_id", "query", "scope"), self.embedder).drop("query"), "embedded")

    def _vector(self, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        return vector.vector_arm(self._embedded(queries), chunks, max(4 * k, 20))

    def search(self, queries: DataFrame, k: int | None = None, use_vector: bool = False) -> DataFrame:
        """Strong and weak results of a table of queries. Lexical first; queries without strong results, or all if asked, go on to
        the vector arm, and only those are embedded. An embedder that fails leaves the lexical results. Transient roots that hold a query's
        scope count as used."""
        self._use(queries)
        return settled(self.spark, "found", lambda: self._found(queries, k or self.config["search"]["max_results"], use_vector))

    def _found(self, queries: DataFrame, k: int, use_vector: bool) -> DataFrame:
        rrf_k, chunks = self.config["search"]["rrf_k"], self.store.table("chunks")
        arms = self._lexical(queries, chunks)
        first = materialise(fuse.classify(fuse.fuse(arms, rrf_k), k), "first")
        strong = first.where("class = 'strong'").select("query_id").distinct()
        open_ = queries if use_vector else queries.join(strong, "query_id", "left_anti")
        try:
            vec = self._vector(open_, chunks, k)
        except Exception as e:
            warnings.warn(f"lexical results only: {e}", stacklevel=2)
            return first
        again = if_small(open_.select("query_id"))
        second = fuse.classify(fuse.fuse({name: arm.join(again, "query_id", "left_semi") for name, arm in arms.items()} | {"vec": vec}, rrf_k), k)
        return first.join(again, "query_id", "left_anti").unionByName(second)

    def _use(self, queries: DataFrame) -> None:
        """A search below a transient root renews its last access."""
        own = self.store.table("roots").where("last_access is not null").select("root")
        if own.isEmpty():
            return
        used = own.join(F.broadcast(own.join(queries.select("scope").distinct(), S.under_scope(F.col("scope"), F.col("root")) & (F.col("scope") != ""), "left_semi")), "root")
        for r in used.collect():  # roots are few
            self.touch(r.root)

    def locate(self, texts: list[str] | str, scope: str = "", k: int | None = None) -> DataFrame:
        """query_id, class, rank, path, score, arms: files, best first."""
        got = fuse.dedupe_by_path(self.search(self.queries(texts, scope), k))
        return got.select("query_id", "class", "rank", "path", "score", "arms")

    def excerpt(self, texts: list[str] | str, scope: str = "", k: int | None = None) -> DataFrame:
        """Passages of the strong results, expanded from their files and rendered."""
        got = self.search(self.queries(texts, scope), k, use_vector=True).where("class = 'strong'")
        full = got.join(self.store.table("chunks").select("id", "content", "locator"), "id")
        src = sources.read_files(full.select("path").distinct()).select("path", F.when(S.extension(F.col("path")) != ".pdf", F.col("content").cast("string")).alias("source"))
        wide = excerpt.expand(full.join(src, "path", "left"), excerpt.MAX_LINES)
        info = F.concat(F.lit("("), F.array_join("arms", "+"), F.lit(", rank "), F.col("rank").cast("string"), F.lit(")"))
        return excerpt.render(wide, info=info).select("query_id", "rank", "path", "score", "arms", "start_line", "end_line", "locator.kind", "locator.symbol", F.col("excerpt").alias("text"), "rendered")

    def resolve(self, target: str, scope: str = "", use_vector: bool = False) -> tuple[str, str | None] | None:
        """The file (and range text) a target means: a file that exists, else the best strong result."""
        r = self.spark.range(1).select(S.split_target(F.lit(target)).alias("t")).first().t
        for path, lines in ((target, None), (r.path, r.lines)):
            if os.path.isfile(os.path.expanduser(path)):
                return os.path.abspath(os.path.expanduser(path)), lines
        best = self.search(self.queries(target, scope), 1, use_vector).where("class = 'strong' and rank = 1").head(1)
        return (best[0].path, None) if best else None

    def allowed_path(self, path: str, unsafe: bool = False, allow_secrets: bool = False) -> bool:
        """Reads stay below the working directory or an indexed root, and away from secrets."""
        real = os.path.realpath(os.path.expanduser(path))
        if unsafe:
            return True
        secret = self.spark.range(1).select(S.is_secret_path(F.lit(real)).alias("s")).first().s
        if secret and not allow_secrets:
            return False
        return any(real == r or real.startswith(r.rstrip("/") + "/") for r in [os.path.realpath(os.getcwd()), *map(os.path.realpath, self.roots())])

    def read(self, target: str, lines: str = "", scope: str = "", unsafe: bool = False) -> dict | None:
        got = self.resolve(target, scope)
        if got is None or not self.allowed_path(got[0], unsafe):
            return None
        path, own = got
        r = self.spark.range(1).select(S.line_range(F.lit(lines or own or "1-")).alias("r")).first().r
        if r is None:
            return None
        with open(path, encoding="utf-8", errors="replace") as f:
            text = sources.read_range(f.read(), r.start, r.end)
        return None if text is None else {"path": path, "start": max(1, r.start), "end": max(1, r.start) + len(text) - 1, "lines": text}

    def passage(self, target: str, path_only: bool = False, scope: str = "") -> str | None:
        if path_only:
            got = self.resolve(target, scope)
            return got[0] if got else None
        best = self.excerpt(target, scope, 1).where("rank = 1").head(1)
        return best[0].text if best else None

    def list_dir(self, path: str, scope: str = "") -> DataFrame:
        return sources.list_directory(self.spark, path, self.store.table("files"), scope)

    def empty_message(self, query: str, scope: str) -> dict:
        """What to say of a search without strong results: the scope, what there is elsewhere, and the weak matches."""
        k = self.config["search"]["max_results"]
        with scratch(self.spark):
            hits = fuse.strong_hits(self._lexical(self.queries(query), self.store.table("chunks")), k).head(1)
        n = hits[0].hits if hits else 0
        weak = [r.asDict() for r in self.locate(query, scope).where("class = 'weak'").collect()]
        return {"results": [], "weak_matches": weak, "message": f"nothing under {scope or 'any root'} matches; {n} files do elsewhere" if scope else "nothing matches", "retry_global": bool(scope and n)}

    def status(self) -> dict:
        files, chunks = self.store.table("files"), self.store.table("chunks")
        counts = {r.dir: r.chunks for r in sync.dir_counts(files.select("path", F.size("chunks").cast("long").alias("n_chunks"))).collect()} if self.store.exists() else {}
        ident = self.store.table("identity").head(1)
        return {
            "files": files.count(), "chunks": chunks.count(), "identity": ident[0].asDict() if ident else None, "quarantine": [r.asDict() for r in self.store.table("quarantine").collect()],
            "roots": [{"root": r, "chunks": counts.get(r, 0)} for r in self.roots()],
        }

    def payload(self, query: str, scope: str = "") -> dict:
        """What a program gets: results by class, and an outcome code: 0 strong results, 1 weak ones only, 2 nothing."""
        rows = [r.asDict() for r in self.locate(query, scope).orderBy("class", "rank").collect()]
        strong, weak = ([r for r in rows if r["class"] == c] for c in ("strong", "weak"))
        out = {"query": query, "scope": scope, "results": strong, "weak_matches": weak, "code": 0 if strong else 1 if weak else 2}
        return out if strong else out | {x: y for x, y in self.empty_message(query, scope).items() if x in ("message", "retry_global")}

    def stale(self) -> bool:
        """Whether a sync would change anything."""
        got = self._run(self.roots(), "sync", dry_run=True)
        return bool(got["would_index"]) or got["removed"] > 0

    def reconcile(self) -> dict | None:
        """Syncs if that would change anything; to be called on a trigger."""
        return self.sync() if self.stale() else None

    def act(self, said: str, scope: str = "") -> dict:
        """Finds what an utterance asks for and does it: an action, and its result (None: nothing was found, or it is left to the caller)."""
        row = self.ask(self.spark.createDataFrame([(said,)], "input string")).select("intent").first()
        i = row.intent
        if i is None:
            return {"action": None, "result": None}
        target = i.path or i.query or ""
        done = {
            "locate": lambda: self.payload(i.query or target, scope), "read": lambda: self.read(target, i.lines or "", scope), "excerpt": lambda: self.passage(i.query or target, scope=scope),
            "open": lambda: self.resolve(target, scope), "copy": lambda: self.passage(target, scope=scope), "list": lambda: [r.asDict() for r in self.list_dir(i.path or scope or os.getcwd(), scope).collect()],
        }
        return {"action": i.action, "result": done[i.action]() if i.action in done else None}

    # --- intents and evaluation ---

    def ask(self, utterances: DataFrame, column: str = "input") -> DataFrame:
        return router.route(utterances, column, self.chat_model)

    def eval_intent(self, path: str) -> DataFrame:
        return evaluation.intent_metrics(sources.read_cases(self.spark, path, "intent"), self.chat_model)

    def eval_locate(self, path: str, corpus: str) -> DataFrame:
        """Recall of all arms together, of single ones, and within scopes; excerpts of the first three chunks."""
        return settled(self.spark, "evaluation", lambda: self._evaluated(path, corpus))

    def _evaluated(self, path: str, corpus: str) -> DataFrame:
        self.sync([corpus])
        root = os.path.abspath(os.path.expanduser(corpus))
        # Cases are numbered as they come; a dataset of cases is small by nature.
        rows = sources.read_cases(self.spark, path, "locate").collect()
        cases = self.spark.createDataFrame([(k, r.query, r.expect_path, "" if r.scope in (None, "", "global") else os.path.join(root, r.scope), r.expected_text) for k, r in enumerate(rows)], "query_id int, query string, expect_path string, scope string, expected_text string")
        chunks = self.store.table("chunks")

        def arms(q: DataFrame) -> dict[str, DataFrame]:
            return {**self._lexical(q, chunks), "vec": self._vector(q, chunks, 5)}

        everywhere, scoped = arms(cases.withColumn("scope", F.lit(""))), arms(cases)
        every = materialise(fuse.fuse(everywhere), "eval")
        took = []
        for k, r in enumerate(rows):  # each case by itself, as a user would wait for it
            began = time.time()
            self.search(self.queries(r.query), use_vector=True).collect()
            took.append((k, (time.time() - began) * 1000))
        latency = self.spark.createDataFrame(took, "query_id int, latency_ms double")
        full = every.where("rank <= 3").join(chunks.select("id", F.col("content").alias("excerpt")), "id")
        out = evaluation.hits_at(cases, every).join(evaluation.chunk_excerpt_hits(cases, full), "query_id")
        for name, arm in (("scoped", fuse.fuse(scoped)), ("bm25", everywhere["bm25"]), ("vec", everywhere["vec"])):
            h = evaluation.hits_at(cases, arm)
            out = out.join(h.select("query_id", F.col("hit_1").alias(f"{name}_1"), F.col("hit_3").alias(f"{name}_3")), "query_id")
        return evaluation.locate_metrics(out.join(latency, "query_id"))

