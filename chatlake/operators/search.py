"""Keyword and file-mention search (TOP2, TOP3, AGG2, AGG14, FLT10).

Plan shape of ``search_sessions`` (checked with ``explain``):

1. one scan of ``message`` with the keyword predicate; of a matching row only
   ids, role, time and the 300-character snippet go on;
2. an aggregate per session: ``count(*)`` and the smallest
   ``(no time, time, position, ...)`` struct, which carries the snippet of
   the first hit (partial aggregation before the shuffle, so a session
   holding a third of all messages costs one partial row per task);
3. join with the filtered session table;
4. ``TakeOrderedAndProject`` for the top ``limit`` sessions.

The first hit is the earliest by ``timestamp_ms``, then by position; a hit
without a time comes last.  (Positions follow the timestamp *text*, which may
order mixed precisions differently.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as TX
from chatlake.operators.filters import filter_sessions

SESSION_OUT = ["source", "directory", "branch", "title", "parent_id",
               "started_at", "last_at", "message_count"]


def _sessions_out(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.col("id").alias("session_id"), "source", "directory", "branch",
                           TX.title_or_default("title").alias("title"), "parent_id",
                           "started_at", "last_at", "message_count")


def first_hits(messages: DataFrame, keywords: list[str]) -> DataFrame:
    """AGG2 core: total hits and the first hit per session."""
    hit = F.struct(F.col("timestamp_ms").isNull().alias("no_time"), F.col("timestamp_ms").alias("hit_ts"),
                   F.col("position").alias("hit_position"), F.col("role").alias("hit_role"),
                   TX.snippet("content").alias("snippet"))
    return (messages.where(TX.any_keyword("content", keywords))
            .select("session_id", hit.alias("hit"))
            .groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("total_hits"), F.min("hit").alias("hit"))
            .select("session_id", "total_hits", "hit.hit_position", "hit.hit_role", "hit.hit_ts", "hit.snippet"))


def search_sessions(messages: DataFrame, sessions: DataFrame, keywords: list[str],
                    source: str | None = None, scope=None, since_ms: int | None = None,
                    limit: int | None = 20, rank: str = "hits",
                    boundary: bool = False, bidirectional: bool = False) -> DataFrame:
    """TOP2: sessions with any keyword, ranked by hits then recency.

    ``rank='recency'`` orders by ``last_at`` only (the direct-path option,
    S22).  Ties are broken by session id.  ``limit=None`` returns every
    matching session.
    """
    s = _sessions_out(filter_sessions(sessions, source, scope, since_ms, boundary=boundary, bidirectional=bidirectional))
    ranked = first_hits(messages, keywords).join(s, "session_id")
    if rank == "recency":
        order = [F.col("last_at").desc_nulls_last(), F.col("session_id")]
    else:
        order = [F.col("total_hits").desc(), F.col("last_at").desc_nulls_last(), F.col("session_id")]
    top = ranked.select("session_id", *SESSION_OUT, "total_hits", "hit_position", "hit_role", "hit_ts",
                        "snippet").orderBy(*order)
    return top.limit(int(limit)) if limit is not None else top


def sessions_mentioning(messages: DataFrame, sessions: DataFrame, needle: str,
                        source: str | None = None, scope=None,
                        since_ms: int | None = None) -> DataFrame:
    """AGG14: every session with a message mentioning ``needle``.

    A semi-join instead of ``SELECT DISTINCT`` over wide session rows.
    """
    hits = messages.where(TX.any_keyword("content", [needle])).select("session_id")
    s = filter_sessions(sessions, source, scope, since_ms)
    return s.join(hits.withColumnRenamed("session_id", "id"), "id", "left_semi")


def sessions_by_file(messages: DataFrame, sessions: DataFrame, path: str,
                     source: str | None = None, scope=None, since_ms: int | None = None,
                     limit: int | None = 20) -> DataFrame:
    """TOP3: sessions mentioning a file path, newest first."""
    out = sessions_mentioning(messages, sessions, path, source, scope, since_ms).select(
        "id", "source", "directory", "branch", TX.title_or_default("title").alias("title"),
        "parent_id", "started_at", "last_at", "message_count")
    out = out.orderBy(F.col("last_at").desc_nulls_last(), F.col("id"))
    return out.limit(int(limit)) if limit is not None else out


def search_context(messages: DataFrame, keywords: list[str], radius: int = 3) -> DataFrame:
    """FLT10 set-wise: every message within ``radius`` positions of a hit.

    Each hit is expanded to the ``2*radius+1`` positions it covers and
    equi-joined on ``(session_id, position)``: linear in the hits, no band
    join and no pairs inside a session.  ``distance`` is the gap to the
    nearest hit (0 for a hit).
    """
    r = int(radius)
    hits = messages.where(TX.any_keyword("content", keywords)).select("session_id", "position")
    covered = (hits.select("session_id", F.col("position").alias("hit_pos"),
                           F.explode(F.sequence(F.greatest(F.col("position") - r, F.lit(0)),
                                                F.col("position") + r)).alias("position"))
               .groupBy("session_id", "position")
               .agg(F.min(F.abs(F.col("position") - F.col("hit_pos"))).alias("distance")))
    return messages.select("session_id", "position", "role", "timestamp_ms", "content").join(
        covered, ["session_id", "position"])
