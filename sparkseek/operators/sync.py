"""Keeping the chunk tables in step with their sources: change classes, orphans, roll-ups, expiry, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.functions.scalars import ancestors, under_scope

DAY = 86_400
IDENTITY_FIELDS = ("embedding_model", "dim", "prefix_scheme", "chunker_version")


def classify_changes(seen: DataFrame, files: DataFrame) -> DataFrame:
    """seen: path, size, mtime_ns, hash. Adds status: added, updated or unchanged. Where size agrees but the time doesn't, hashes decide."""
    known = files.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("hash").alias("_hash"))
    status = (
        F.when(F.col("_size").isNull(), "added").when(F.col("size") != F.col("_size"), "updated").when(F.col("mtime_ns") == F.col("_mtime"), "unchanged")
        .when(F.col("hash") == F.col("_hash"), "unchanged").otherwise("updated")
    )
    return seen.join(known, "path", "left").withColumn("status", status).drop("_size", "_mtime", "_hash")


def orphans(files: DataFrame, seen: DataFrame, roots: DataFrame) -> DataFrame:
    """Files on record below the given roots that the walk didn't meet. Roots that failed must not be among them."""
    gone = files.join(seen.select("path"), "path", "left_anti")
    return under_roots(gone, roots)


def under_roots(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose path is a root or below one, by an equality join on the path's ancestors."""
    keys = df.select("path").distinct().select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("root"))
    hit = keys.join(roots.select(F.regexp_replace("root", r"(?<=.)/\z", "").alias("root")).distinct(), "root", "left_semi").select("path").distinct()
    return df.join(hit, "path", "left_semi")


def merge_roots(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("root").union(new.select("root")).distinct()


def dir_counts(files: DataFrame) -> DataFrame:
    """dir, chunks: of every directory its subtree's chunks; '' has all. files: path, n_chunks."""
    per = files.select(F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("dir"), "n_chunks")
    return per.groupBy("dir").agg(F.sum("n_chunks").alias("chunks")).where("chunks > 0")


def scope_fraction(counts: DataFrame, scope: str) -> DataFrame:
    """One row: the share of all chunks below a directory; 0 where it isn't known."""
    total, own = F.max(F.when(F.col("dir") == "", F.col("chunks"))), F.max(F.when(F.col("dir") == scope, F.col("chunks")))
    return counts.where(F.col("dir").isin("", scope)).agg(F.coalesce(own / total, F.lit(0.0)).alias("fraction"))


def count_under(chunks: DataFrame, scope: Column) -> DataFrame:
    return chunks.agg(F.count_if(under_scope(F.col("path"), scope)).alias("n_under"), F.count(F.lit(1)).alias("n_all"))


def run_summary(classified: DataFrame, removed: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    gone = removed.agg(F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("removed_chunks"))
    return classified.agg(F.count(F.lit(1)).alias("scanned"), n("unchanged"), n("updated"), n("added")).crossJoin(gone)


def is_stale(classified: DataFrame, removed: DataFrame) -> bool:
    return not classified.where("status <> 'unchanged'").isEmpty() or not removed.isEmpty()


def expired_roots(roots: DataFrame, now: int, retention_days: int, most: int) -> DataFrame:
    """root, last_access, reason: transient roots not used for so long, then the oldest beyond so many."""
    old = F.col("last_access") < now - retention_days * DAY
    kept = Window.partitionBy(old).orderBy(F.desc("last_access"), "root")
    ranked = roots.withColumn("_n", F.row_number().over(kept)).withColumn("reason", F.when(old, "age").when(F.col("_n") > most, "count"))
    return ranked.where("reason is not null").drop("_n")


def touch_roots(roots: DataFrame, path: str, now: int) -> DataFrame:
    """Sets the last access of every root that encloses a path."""
    inside = (F.lit(path) == F.col("root")) | F.lit(path).startswith(F.concat(F.regexp_replace("root", r"/\z", ""), F.lit("/")))
    return roots.withColumn("last_access", F.when(inside, F.lit(now).cast("bigint")).otherwise(F.col("last_access")))


def identity_differences(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """field, stored, wanted of each field that differs; a dim of 0 takes any."""
    s = stored.limit(1).select(F.posexplode(F.array(*[F.col(f).cast("string") for f in IDENTITY_FIELDS])).alias("k", "stored"))
    w = wanted.limit(1).select(F.posexplode(F.array(*[F.col(f).cast("string") for f in IDENTITY_FIELDS])).alias("k", "wanted"))
    name = F.element_at(F.array(*[F.lit(f) for f in IDENTITY_FIELDS]), F.col("k") + 1)
    both = s.join(w, "k").where(~F.col("stored").eqNullSafe(F.col("wanted")) & ~((name == "dim") & F.least(F.coalesce("stored", F.lit("0")), F.coalesce("wanted", F.lit("0"))).isin("0")))
    return both.select(name.alias("field"), "stored", "wanted")
