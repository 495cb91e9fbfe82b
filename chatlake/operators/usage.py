"""Model usage and daily activity (AGG3, AGG5-10, TOP8/9).

Both reports pre-aggregate ``message`` per ``(session_id, key)`` before
touching ``session``: the partial aggregate runs before any shuffle, the
join then sees one row per session and key instead of one per message,
and a session holding a third of all messages is no hotter than any other.
Distinct sessions per day is exact: after the pre-aggregation each
``(session_id, day)`` pair is one row, so it is a plain count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import time as TM
from chatlake.operators.filters import filter_sessions

TOKEN_COLS = ["output_tokens", "cache_read", "cache_write"]


def _sum_tokens(col: str) -> F.Column:
    # decimal(38,0) cannot overflow where a BIGINT sum would raise
    return F.coalesce(F.sum(F.col(col).cast("decimal(38,0)")), F.lit(0)).cast("bigint")


def _scoped(pre: DataFrame, sessions: DataFrame | None, source=None, scope=None,
            since_ms=None) -> DataFrame:
    if sessions is None:
        return pre
    s = filter_sessions(sessions, source, scope, since_ms).select(F.col("id").alias("session_id"))
    return pre.join(s, "session_id", "left_semi")


def model_usage(messages: DataFrame, sessions: DataFrame | None = None, scope=None,
                source=None, since_ms=None) -> DataFrame:
    """AGG5: assistant turns and token sums per model, busiest first.

    With ``sessions`` given, only messages of existing (and in-scope)
    sessions count, as in the reference's join.
    """
    asst = messages.where(F.col("model").isNotNull() & (F.col("role") == "assistant"))
    pre = asst.groupBy("session_id", "model").agg(
        F.count(F.lit(1)).alias("turns"),
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in TOKEN_COLS])
    pre = _scoped(pre, sessions, source, scope, since_ms)
    return merge_model_usage(pre)


def merge_model_usage(partials: DataFrame) -> DataFrame:
    """AGG9: sum partial model rows (per project, per file, per run)."""
    return (partials.groupBy("model")
            .agg(F.sum("turns").cast("bigint").alias("turns"), *[_sum_tokens(c).alias(c) for c in TOKEN_COLS])
            .orderBy(F.col("turns").desc(), F.col("model")))


def raw_model_usage(raw: DataFrame) -> DataFrame:
    """AGG6: usage over every assistant line, tool-only turns included."""
    asst = raw.where((F.col("msg_type") == "assistant") & F.col("model").isNotNull())
    return (asst.groupBy("model")
            .agg(F.count(F.lit(1)).alias("turns"), *[_sum_tokens(c).alias(c) for c in TOKEN_COLS])
            .orderBy(F.col("turns").desc(), F.col("model")))


def session_days(messages: DataFrame, tz: str = "UTC", ts_col: str = "timestamp_ms") -> DataFrame:
    """Per ``(session_id, day)`` counts: the exact, mergeable roll-up grain."""
    return (messages.select("session_id", "role", TM.day_of_ms(ts_col, tz).alias("day"))
            .groupBy("session_id", "day")
            .agg(F.count_if(F.col("role") == "user").alias("user_msgs"),
                 F.count_if(F.col("role") == "assistant").alias("asst_turns")))


def merge_daily(pairs: DataFrame) -> DataFrame:
    """AGG10: merge ``(session_id, day)`` partials; distinct stays exact."""
    return (pairs.groupBy("day")
            .agg(F.count_distinct("session_id").alias("sessions"),
                 F.sum("user_msgs").cast("bigint").alias("user_msgs"),
                 F.sum("asst_turns").cast("bigint").alias("asst_turns"))
            .orderBy("day"))


def merge_days(days: DataFrame) -> DataFrame:
    """Daily activity from stored rows by source, directory and day: a session is in
    one directory, so its distinct counts add up."""
    return (days.groupBy("day").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("sessions", "user_msgs", "asst_turns")])
            .orderBy("day"))


def daily_activity(messages: DataFrame, sessions: DataFrame | None = None, scope=None,
                   source=None, since_ms=None, tz: str = "UTC") -> DataFrame:
    """AGG7: distinct sessions, user messages, assistant turns per day."""
    pre = _scoped(session_days(messages, tz), sessions, source, scope, since_ms)
    return (pre.groupBy("day")
            .agg(F.count(F.lit(1)).alias("sessions"),
                 F.sum("user_msgs").cast("bigint").alias("user_msgs"),
                 F.sum("asst_turns").cast("bigint").alias("asst_turns"))
            .orderBy("day"))


def project_model_usage(asst: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per-project partials of AGG9: assistant turns and tokens per (directory, model)."""
    return (asst.join(sessions.select(F.col("id").alias("session_id"), "directory"), "session_id")
            .groupBy("directory", "model")
            .agg(F.count(F.lit(1)).alias("turns"), *[F.sum(c).alias(c) for c in TOKEN_COLS]))


def project_session_days(messages: DataFrame, sessions: DataFrame, tz: str = "UTC") -> DataFrame:
    """Per-project partials of AGG10, at the grain (directory, session, day)."""
    return session_days(messages, tz).join(
        sessions.select(F.col("id").alias("session_id"), "directory"), "session_id").select(
        "directory", "session_id", "day", "user_msgs", "asst_turns")


def raw_daily_activity(raw: DataFrame) -> DataFrame:
    """Daily activity straight from parsed lines: every user and assistant line
    counts, with or without usable text, by the day of its timestamp text.
    Counted per (session, day) first, so a hot day or session is no hot key."""
    lines = raw.where(F.col("msg_type").isin("user", "assistant"))
    pairs = lines.groupBy("session_id", TM.day_of_iso("ts").alias("day")).agg(
        F.count_if(F.col("msg_type") == "user").alias("user_msgs"),
        F.count_if(F.col("msg_type") == "assistant").alias("asst_turns"))
    return (pairs.groupBy("day")
            .agg(F.count("session_id").alias("sessions"), F.sum("user_msgs").cast("bigint").alias("user_msgs"),
                 F.sum("asst_turns").cast("bigint").alias("asst_turns"))
            .orderBy("day"))


# ---- mergeable sketches of distinct sessions (AGG7, AGG8, AGG10) --------------

SKETCH_LG = 12        # 4,096 registers: a relative standard error of 1.6 percent
SKETCH_ERROR = 0.05   # three standard errors


def day_sketches(pairs: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """``(directory, day, sketch)`` of ``(directory, session_id, day)`` rows: a sketch of
    the session ids, of fixed size however many there are."""
    return pairs.groupBy("directory", "day").agg(F.hll_sketch_agg("session_id", lg).alias("sketch"))


def merged_sketches(sketches: DataFrame, *keys) -> DataFrame:
    """AGG10 for sketches: directories, days or weeks merged; a session in two of them
    counts once, which adding distinct counts would not do (S30)."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def week_of(day) -> F.Column:
    """The Monday of a day (text), as text."""
    return F.date_sub(F.next_day(F.col(day).cast("date"), "Mon"), 7).cast("string")


def distinct_by_period(pairs: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """Per day, week and all time: exact distinct sessions, the sketch's estimate (merged
    day to week to all) and the sum of the directories' distinct counts."""
    pairs = pairs.select("directory", "session_id", "day").distinct()
    days = day_sketches(pairs, lg)
    day = merged_sketches(days, "day")
    week = merged_sketches(day.withColumn("week", week_of("day")), "week")
    whole = merged_sketches(week.withColumn("all", F.lit("all")), "all")
    out = None
    for level, key, sketch in (("day", F.col("day"), day), ("week", week_of("day"), week), ("all", F.lit("all"), whole)):
        per_dir = pairs.groupBy(key.alias("period"), "directory").agg(F.count_distinct("session_id").alias("n"))
        added = per_dir.groupBy("period").agg(F.sum("n").alias("added"))
        exact = pairs.groupBy(key.alias("period")).agg(F.count_distinct("session_id").alias("sessions"))
        est = sketch.select(F.col(level).alias("period"), F.hll_sketch_estimate("sketch").alias("estimate"))
        rows = exact.join(added, "period").join(est, "period").select(F.lit(level).alias("level"), "period", "sessions", "estimate", "added")
        out = rows if out is None else out.unionByName(rows)
    return out


def within_error(estimate, exact) -> F.Column:
    """A sketch's estimate is as near as ``SKETCH_LG`` promises (a count of few is off by one at most)."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), SKETCH_ERROR * F.col(exact))


def last_days(daily: DataFrame, n: int = 14) -> DataFrame:
    """TOP9: the latest ``n`` days, oldest first."""
    return daily.orderBy(F.col("day").desc()).limit(n).orderBy("day")
