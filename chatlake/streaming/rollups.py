"""STR2 and STR3: continuous daily activity and session summaries.

Rows behind the watermark are not lost silently: ``late_rows`` reads from a query's
progress how many (day, session) rows its tasks dropped.

STR2 (exact): messages are grouped per ``(1-day window, session_id)`` with a
watermark; in append mode each pair is emitted once, when the watermark
closes its day.  The emitted pairs are the mergeable roll-up grain, so the
daily report over them (``merge_daily``) is exact: distinct sessions per day
is a count of pairs.  State is bounded by the watermark.  The watermark is a
real semantic choice (late rows past it are not counted), so the default is
generous.

STR2 (approximate, update mode): one row per day with
``approx_count_distinct`` sessions, for dashboards that want every update.

STR3: per-session summary in update mode, upserted by ``foreachBatch``.
Its state holds one row per session (no watermark: sessions stay open);
use the RocksDB state store provider for large session counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as TX
from chatlake.store.tables import TableSet

DAY = "1 day"


def _event_time(df: DataFrame, ms_col: str = "timestamp_ms") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(F.col(ms_col)))


def _window_day(col: str = "window") -> F.Column:
    # window starts are aligned to the UTC epoch; format without the session zone
    return F.date_from_unix_date(
        F.floor(F.unix_seconds(F.col(f"{col}.start")) / 86400).cast("int")).cast("string")


def session_day_stream(messages: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Exact roll-up grain ``(day, session_id, user_msgs, asst_turns)``; append mode."""
    m = _event_time(messages).withWatermark("event_time", watermark)
    agg = m.groupBy(F.window("event_time", DAY), "session_id").agg(
        F.count_if(F.col("role") == "user").alias("user_msgs"),
        F.count_if(F.col("role") == "assistant").alias("asst_turns"))
    return agg.select(_window_day().alias("day"), "session_id", "user_msgs", "asst_turns")


def daily_activity_approx_stream(messages: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Per-day activity with approximate distinct sessions; update mode."""
    m = _event_time(messages).withWatermark("event_time", watermark)
    agg = m.groupBy(F.window("event_time", DAY)).agg(
        F.approx_count_distinct("session_id").alias("sessions"),
        F.count_if(F.col("role") == "user").alias("user_msgs"),
        F.count_if(F.col("role") == "assistant").alias("asst_turns"))
    return agg.select(_window_day().alias("day"), "sessions", "user_msgs", "asst_turns")


def late_rows(query) -> int:
    """Rows that a query's stateful operators dropped as later than the watermark, from
    its progress reports.  Rows are counted after each task's partial aggregation: one
    per (day, session) of a task in the exact form, one per day in the approximate."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def session_summary_stream(parsed_usable: DataFrame) -> DataFrame:
    """STR3: running session summary (update mode).

    Input: usable parsed lines with ``timestamp_ms`` (see
    ``transcripts.clean``).  Same rules as the batch ``sessionize``, but lines
    of equal timestamp are ordered by a hash of the line: a stream has no line
    numbers, so title and branch can differ from the batch's there.
    """
    key = "struct(ts IS NULL, ts, line_no)"
    pre = parsed_usable.withColumn(
        "_title", F.when(F.col("role") == "user", TX.normalize_title("content")))
    return pre.groupBy("session_id").agg(
        F.expr(f"min_by(branch, {key}) FILTER (WHERE branch IS NOT NULL AND branch <> '')").alias("branch"),
        F.min("timestamp_ms").alias("started_at"),
        F.max("timestamp_ms").alias("last_at"),
        F.count_if(F.col("role") == "user").cast("int").alias("message_count"),
        F.expr(f"min_by(_title, {key}) FILTER (WHERE role = 'user')").alias("_title"),
        F.max("directory").alias("directory"))


def upsert_summaries(store: TableSet, source: str = "claude-code"):
    """``foreachBatch`` callback for STR3: upsert changed summaries."""
    from chatlake import schema as SC
    from chatlake.session import checkpointed

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.col("session_id").alias("id"), F.lit(source).alias("source"), "directory", "branch",
            F.coalesce("_title", F.lit(TX.NO_TITLE)).alias("title"),
            F.lit(None).cast("string").alias("parent_id"),
            "started_at", "last_at", "message_count").select(*SC.SESSION_COLS)
        rows = checkpointed(rows)
        if not rows.isEmpty():
            store.upsert_sessions(rows)
    return run
