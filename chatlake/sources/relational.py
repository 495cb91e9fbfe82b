"""Relational session / message / part store (SRC6, SRC7, SRC9, JN3, JN4).

The operator takes three DataFrames and does not care where they came
from (``spark.read.jdbc`` where a driver jar exists, Parquet exports
otherwise).  The reference issues one query per session for its parts;
here one equi-join covers every session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake import schema as SC
from chatlake.functions import text as TX
from chatlake.operators.filters import unarchived
from chatlake.operators.ranking import sequence_within

SOURCE = "opencode"


def session_title(title="title", slug="slug") -> F.Column:
    """Title, then slug, then '(no title)'; empty strings fall through."""
    return F.coalesce(F.nullif(F.col(title), F.lit("")), F.nullif(F.col(slug), F.lit("")),
                      F.lit(TX.NO_TITLE))


def session_rows(rel_session: DataFrame) -> DataFrame:
    """SRC6: unarchived sessions, children included."""
    return unarchived(rel_session).select(
        "id", "parent_id", "directory", session_title().alias("title"),
        "time_created", "time_updated")


def text_parts(rel_part: DataFrame, rel_message: DataFrame) -> DataFrame:
    """SRC7: non-empty text parts with their message's role and time.

    ``(session_id, role, content, mtime, ptime, part_id)``.
    """
    p = rel_part.select(
        F.col("id").alias("part_id"), "message_id", "session_id",
        F.get_json_object("data", "$.type").alias("ptype"),
        F.get_json_object("data", "$.text").alias("content"),
        F.col("time_created").alias("ptime"))
    m = rel_message.select(F.col("id").alias("message_id"),
                           F.get_json_object("data", "$.role").alias("role"),
                           F.col("time_created").alias("mtime"))
    return (p.where((F.col("ptype") == "text") & F.col("content").isNotNull()
                    & (F.length("content") > 0))
            .join(m, "message_id")
            .select("session_id", "role", "content", "mtime", "ptime", "part_id"))


def _indexed_parts(rel_session: DataFrame, rel_message: DataFrame, rel_part: DataFrame) -> DataFrame:
    ids = session_rows(rel_session).select(F.col("id").alias("session_id"))
    return text_parts(rel_part, rel_message).join(ids, "session_id", "left_semi")


def relational_sessions(rel_session: DataFrame, rel_message: DataFrame, rel_part: DataFrame) -> DataFrame:
    """SRC9: session rows of the relational store.

    Sessions without a text part are skipped (inner join), the user count
    comes from the parts, times from the session row.
    """
    counts = _indexed_parts(rel_session, rel_message, rel_part).groupBy("session_id").agg(
        F.count_if(F.col("role") == "user").cast("int").alias("message_count"))
    return session_rows(rel_session).join(counts.withColumnRenamed("session_id", "id"), "id").select(
        "id", F.lit(SOURCE).alias("source"), "directory", F.lit(None).cast("string").alias("branch"),
        "title", "parent_id", F.col("time_created").alias("started_at"),
        F.col("time_updated").alias("last_at"), "message_count").select(*SC.SESSION_COLS)


def relational_messages(rel_session: DataFrame, rel_message: DataFrame, rel_part: DataFrame) -> DataFrame:
    """SRC9: message rows of the relational store; no model or tokens."""
    parts = _indexed_parts(rel_session, rel_message, rel_part)
    # a minute of message time is a slice; parts without one are cut by part time
    minute = F.struct(F.col("mtime").isNull().alias("no_time"), F.coalesce(
        F.floor(F.col("mtime") / 60000), F.floor(F.col("ptime") / 60000), F.lit(0)).alias("minute"))
    ordered = sequence_within(parts, "session_id", minute, [F.col("mtime").asc_nulls_last(), "ptime", "part_id"])
    return ordered.select(
        "session_id", "role", TX.strip_nul("content").alias("content"),
        F.col("mtime").alias("timestamp_ms"), "position",
        F.lit(None).cast("string").alias("model"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("output_tokens", "cache_read", "cache_write")]).select(*SC.MESSAGE_COLS)


def session_changes(rel_session: DataFrame, marks: DataFrame) -> DataFrame:
    """Change feed: ``(id, status)`` of the sessions that differ from the last run's high-water
    marks ``(id, last_at)``: 'new', 'changed' (updated since), 'archived' or 'vanished'
    (indexed, but archived now or gone)."""
    now = rel_session.select("id", "time_updated", F.col("time_archived").isNotNull().alias("archived"), F.lit(True).alias("here"))
    was = marks.select(F.col("id").alias("mark_id"), "last_at")
    j = now.join(was, F.col("id") == F.col("mark_id"), "full")
    known = F.col("mark_id").isNotNull()
    status = (F.when(F.col("here").isNull(), "vanished").when(F.col("archived") & known, "archived").when(F.col("archived"), None)
              .when(~known, "new").when(F.coalesce(F.col("time_updated") > F.col("last_at"), F.lit(True)), "changed"))
    return j.select(F.coalesce("id", "mark_id").alias("id"), status.alias("status")).where(F.col("status").isNotNull())


def of_sessions(rel_session: DataFrame, rel_message: DataFrame, rel_part: DataFrame, ids: DataFrame) -> tuple:
    """The three tables' rows of some sessions (id); others' parts are not parsed."""
    keys = ids.select("id")
    by = keys.withColumnRenamed("id", "session_id")
    return (rel_session.join(keys, "id", "left_semi"), rel_message.join(by, "session_id", "left_semi"), rel_part.join(by, "session_id", "left_semi"))


def list_roots_with_counts(rel_session: DataFrame, rel_message: DataFrame) -> DataFrame:
    """JN4 + FLT12: root, unarchived sessions with their count of *all*
    messages (the correlated sub-query, decorrelated to aggregate + join)."""
    counts = rel_message.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    roots = unarchived(rel_session, roots_only=True)
    return roots.join(counts.withColumnRenamed("session_id", "id"), "id", "left").select(
        "id", "directory",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("slug")).alias("title"),
        F.col("time_created").alias("started_at"), F.col("time_updated").alias("last_at"),
        F.coalesce("message_count", F.lit(0)).alias("message_count"))


def first_hits(rel_session: DataFrame, rel_message: DataFrame, rel_part: DataFrame,
               keywords: list[str]) -> DataFrame:
    """WIN7: earliest matching text part per root session (``DISTINCT ON``).

    ``row_number() = 1`` keeps one row per session in each task before the
    shuffle (``WindowGroupLimit``).
    """
    from chatlake.operators.sessions import dedupe_first

    roots = unarchived(rel_session, roots_only=True).select(
        F.col("id").alias("session_id"), "directory",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("slug")).alias("title"),
        "time_created", "time_updated")
    p = rel_part.select("session_id", "message_id", F.col("id").alias("part_id"),
                        F.col("time_created").alias("ptime"),
                        F.get_json_object("data", "$.type").alias("ptype"),
                        F.get_json_object("data", "$.text").alias("text"))
    m = rel_message.select(F.col("id").alias("message_id"),
                           F.get_json_object("data", "$.role").alias("hit_role"),
                           F.col("time_created").alias("hit_time"))
    hits = (p.where((F.col("ptype") == "text") & TX.any_keyword("text", keywords))
            .join(m, "message_id")
            .select("session_id", "hit_role", "hit_time", "ptime", "part_id",
                    TX.snippet("text").alias("snippet")))
    first = dedupe_first(hits, "session_id", ["hit_time", "ptime", "part_id"]).drop("part_id")
    return first.join(roots, "session_id").select(
        "session_id", "directory", "title", "time_created", "time_updated",
        "snippet", "hit_role", "hit_time")
