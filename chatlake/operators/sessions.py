"""Session listing, reading and skimming (TOP1, TOP4-7, WIN4/5, WIN7,
SET1/2, FN13).

Skim avoids a full per-session sort: ``row_number() <= k`` is planned as a
``WindowGroupLimit`` that keeps at most ``k`` rows per session in each task
*before* the shuffle, so a session with a third of all messages moves only
``k`` rows per task.  Totals come from a partial/final hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import text as TX
from chatlake.functions import time as TM
from chatlake.operators.filters import filter_sessions, position_range, role_is

SESSION_LIST_COLS = ["id", "source", "directory", "branch", "title", "parent_id",
                     "started_at", "last_at", "message_count"]


def _recency(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.col("last_at").desc_nulls_last(), F.col(id_col))


def session_list(sessions: DataFrame) -> DataFrame:
    """The columns of a session listing, in no order."""
    return sessions.select("id", "source", "directory", "branch", TX.title_or_default("title").alias("title"),
                           "parent_id", "started_at", "last_at", "message_count")


def list_sessions(sessions: DataFrame, source: str | None = None, scope=None,
                  since_ms: int | None = None, limit: int | None = 50,
                  boundary: bool = False, bidirectional: bool = False) -> DataFrame:
    """TOP1 (``limit=None``: TOP7, every session by recency)."""
    out = _recency(session_list(filter_sessions(sessions, source, scope, since_ms, boundary=boundary,
                                                bidirectional=bidirectional)))
    return out.limit(int(limit)) if limit is not None else out


def session_report(sessions: DataFrame, now_ms: int, title_width: int = 40,
                   project_width: int = 18) -> DataFrame:
    """FN13: the printed session line as columns (FN7-FN10)."""
    return sessions.select(
        "id", "last_at",
        F.when(F.col("source") == "opencode", F.lit("oc")).otherwise(F.lit("")).alias("source_tag"),
        TX.truncate_plain(TX.project_name("directory"), project_width).alias("project"),
        F.coalesce(F.col("branch"), F.lit("")).alias("branch"),
        TX.truncate_plain(TX.title_or_default("title"), title_width).alias("title"),
        TM.ago("last_at", now_ms, long=True).alias("age"),
        F.col("message_count"),
        TX.short_id("id").alias("short_id"))


def read_messages(messages: DataFrame, prefix: str | None = None, from_: int | None = None,
                  to: int | None = None, around: int | None = None, radius: int = 3,
                  role: str | None = None) -> DataFrame:
    """TOP4: messages of the sessions matching an id prefix, in order."""
    out = messages
    if prefix is not None:
        out = out.where(F.col("session_id").startswith(prefix))
    out = role_is(position_range(out, from_, to, around, radius), role)
    return out.select("session_id", "role", "content", "timestamp_ms", "position") \
              .orderBy("session_id", "position")


def skim(messages: DataFrame, head: int = 3, tail: int = 3, role: str | None = None,
         prefix: str | None = None) -> DataFrame:
    """WIN4: first ``head`` and last ``tail`` messages of every session.

    One row per kept message with ``section`` ('head'/'tail'), ``total``
    (after the role filter) and ``skipped``.  If ``total <= head + tail``
    everything is in ``head``.  ``tail=0`` gives an empty tail (S27).
    """
    m = role_is(messages, role)
    if prefix is not None:
        m = m.where(F.col("session_id").startswith(prefix))
    h, t = int(head), int(tail)
    # at most h + t rows of a session leave a scan task, text and all; the counts are
    # partitioned by session as those rows are, so joining them moves no text
    at = m.select("session_id", "position", "role", "content", "timestamp_ms")
    totals = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    per = Window.partitionBy("session_id")
    first = (at.withColumn("_rn", F.row_number().over(per.orderBy("position")))
             .where(F.col("_rn") <= F.lit(max(h + t, 1))).join(totals, "session_id")
             .where((F.col("_rn") <= F.lit(h)) | (F.col("total") <= F.lit(h + t)))
             .withColumn("section", F.lit("head")))
    picked = first
    if t > 0:
        last = (at.withColumn("_rn", F.row_number().over(per.orderBy(F.col("position").desc())))
                .where(F.col("_rn") <= F.lit(t)).join(totals, "session_id")
                .where(F.col("total") > F.lit(h + t))
                .withColumn("section", F.lit("tail")))
        picked = first.unionByName(last)
    return picked.select("session_id", "position", "role", "content", "timestamp_ms", "section", "total").withColumn(
        "skipped", F.greatest(F.col("total") - F.lit(h + t), F.lit(0)))


def preview(messages: DataFrame, head: int = 2, tail: int = 5,
            max_lines: int = TX.PREVIEW_LINES) -> DataFrame:
    """WIN5 + FN12: the browse preview (first 2, last 5, first 8 lines each)."""
    s = skim(messages, head, tail)
    return s.select("session_id", "position", "role", "section", "total", "skipped",
                    TX.first_lines("content", max_lines).alias("lines"),
                    TX.more_lines("content", max_lines).alias("more_lines"))


def merge_sources(*session_lists: DataFrame, limit: int | None = 50) -> DataFrame:
    """SET1 + TOP5: union of per-source session lists, newest first."""
    out = session_lists[0].select(*SESSION_LIST_COLS)
    for other in session_lists[1:]:
        out = out.unionByName(other.select(*SESSION_LIST_COLS))
    out = _recency(out)
    return out.limit(int(limit)) if limit is not None else out


def dedupe_first(df: DataFrame, key: str, order_cols: list) -> DataFrame:
    """SET2 / WIN7: keep the first row per ``key`` by ``order_cols``.

    ``row_number() = 1`` is planned with a partial ``WindowGroupLimit``, so
    duplicates are dropped before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_per_group(df: DataFrame, group: str, order_cols: list, k: int) -> DataFrame:
    """TOP6 option: the first ``k`` rows of each group."""
    w = Window.partitionBy(group).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
