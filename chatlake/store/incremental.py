"""Incremental maintenance as DataFrame operations (SNK2-9, SNK11).

No MERGE is available on plain Parquet, so an upsert is
``old LEFT ANTI JOIN new  UNION ALL  new``; the physical rewrite of only
the touched buckets lives in ``chatlake.store.tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake import schema as SC

CHANGE_TOLERANCE_MS = 1000   # S12: |mtime - tracked| < 1 s counts as unchanged


def file_status(files: DataFrame, manifest: DataFrame, force: bool = False,
                tolerance_ms: int = CHANGE_TOLERANCE_MS) -> DataFrame:
    """The listed files with ``tracked_ms`` and ``status``: 'new', 'changed', NULL for
    unchanged ones or, with ``force``, 'forced'."""
    m = manifest.select("path", F.col("mtime_ms").alias("tracked_ms"))
    differs = F.abs(F.col("mtime_ms") - F.col("tracked_ms")) >= F.lit(tolerance_ms)
    return files.join(m, "path", "left").withColumn(
        "status", F.when(F.col("tracked_ms").isNull(), F.lit("new")).when(differs, F.lit("changed"))
        .otherwise(F.lit("forced" if force else None).cast("string")))


def changed_files(files: DataFrame, manifest: DataFrame, force: bool = False,
                  tolerance_ms: int = CHANGE_TOLERANCE_MS) -> DataFrame:
    """SNK7: listed files that are new, changed, or all of them with ``force``.

    ``(path, mtime_ms, tracked_ms, status)``; status is 'new' or 'changed'
    (or 'forced' for unchanged files re-read by ``force``).
    """
    return file_status(files.select("path", "mtime_ms"), manifest, force, tolerance_ms).where(F.col("status").isNotNull())


def stale_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """SNK8: tracked paths that are no longer listed."""
    return manifest.join(files.select("path"), "path", "left_anti")


def needs_index(sessions: DataFrame, files: DataFrame, manifest: DataFrame) -> bool:
    """SNK9: no sessions yet, or any new/changed file (exact, not sampled)."""
    if sessions.isEmpty():
        return True
    return not changed_files(files, manifest).isEmpty()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK2/SNK5: rows of ``new`` replace rows of ``old`` with the same key."""
    cols = old.columns
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*cols))


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK3: every row of a group present in ``new`` is replaced by ``new``'s
    rows for that group (a session's whole message list)."""
    cols = old.columns
    keys = new.select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(new.select(*cols))


def remove_keys(df: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None) -> DataFrame:
    """SNK4/SNK6: delete rows by a key list."""
    k = keys.select(F.col(keys_col or key).alias(key)).distinct()
    return df.join(k, key, "left_anti")


def next_manifest(manifest: DataFrame, files: DataFrame, changed: DataFrame,
                  source: str = "claude-code", indexed_at=None) -> DataFrame:
    """SNK5 + SNK8: drop stale paths, record the new mtime of changed ones."""
    kept = manifest.join(files.select("path"), "path", "inner")
    new = changed.select("path", F.lit(source).alias("source"), "mtime_ms")
    cols = ["path", "source", "mtime_ms"]
    out = upsert(kept.select(*cols), new, "path")
    if indexed_at is not None:
        out = out.withColumn("indexed_at", indexed_at)
    return out


def empty(spark, struct) -> DataFrame:
    return spark.createDataFrame([], struct)


def run_stats(files: DataFrame, changed: DataFrame, new_sessions: DataFrame) -> DataFrame:
    """SNK11: files checked / indexed and sessions indexed, in one row."""
    # three one-row aggregates joined on a constant key (one row each side)
    f = files.agg(F.count(F.lit(1)).alias("files_checked")).withColumn("_k", F.lit(1))
    c = changed.agg(F.count(F.lit(1)).alias("files_indexed")).withColumn("_k", F.lit(1))
    s = new_sessions.agg(F.count_distinct("id").alias("sessions_indexed")).withColumn("_k", F.lit(1))
    return f.join(c, "_k").join(s, "_k").drop("_k")


__all__ = ["changed_files", "stale_files", "needs_index", "upsert", "replace_groups",
           "remove_keys", "next_manifest", "run_stats", "SC"]
