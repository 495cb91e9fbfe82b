"""Sessionize parsed transcript lines (SRC8, SRC10, AGG1, AGG4, S4, S9).

Order inside a session is ``(ts text, nulls last, path, block, line_no)`` (S4), a
total order that does not depend on what else a scan reads.  First values use
``min_by`` with a struct key that is never NULL, so a NULL timestamp sorts last
instead of being skipped.  The title is normalised *before* the aggregate, so at
most 200 characters travel through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake import schema as SC
from chatlake.functions import text as TX
from chatlake.operators.ranking import sequence_within
from chatlake.sources import transcripts as TR

ORDER_KEY = "struct(ts IS NULL AS no_ts, ts, path, block, line_no)"
PLACE = "struct(ts IS NULL AS no_ts, ts)"


def prefix_owner_empty(spark):
    return spark.createDataFrame([], "prefix string, directory string, projects long, sessions long")


def older_files(msgs: DataFrame) -> DataFrame:
    """``(session_id, path)`` of files that hold a session but are not its
    latest file by ``(mtime_ms, path)``; no rows where sessions have one file."""
    pairs = msgs.groupBy("session_id", "path").agg(F.max("mtime_ms").alias("mtime_ms"))
    several = pairs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("path", F.struct("mtime_ms", "path")).alias("latest"),
        F.collect_set("path").alias("paths")).where(F.col("n") > 1)
    return several.select("session_id", F.explode(F.array_except("paths", F.array("latest"))).alias("path"))


def _summary(msgs: DataFrame, keys: list[str]) -> DataFrame:
    title = F.col("title") if "title" in msgs.columns else F.when(F.col("role") == "user", TX.normalize_title("content"))
    branch, user = "FILTER (WHERE branch IS NOT NULL AND branch <> '')", "FILTER (WHERE role = 'user')"
    return msgs.withColumn("_title", title).groupBy(*keys).agg(
        F.expr(f"min_by(branch, {ORDER_KEY}) {branch}").alias("branch"),
        F.min("timestamp_ms").alias("started_at"),
        F.max("timestamp_ms").alias("last_at"),
        F.count_if(F.col("role") == "user").cast("int").alias("message_count"),
        F.expr(f"min_by(_title, {ORDER_KEY}) {user}").alias("_title"),
        F.max_by("directory", F.struct("mtime_ms", "path")).alias("directory"),
        F.min(F.expr(PLACE)).alias("first"),
        F.struct(F.count(F.lit(1)).alias("n"), F.max(F.expr(PLACE)).alias("last"), F.expr(f"min({PLACE}) {user}").alias("title"),
                 F.expr(f"min({PLACE}) {branch}").alias("branch"), F.max(F.struct("mtime_ms", "path")).alias("file")).alias("state"))


def _session_cols(source: str) -> list:
    return [F.col("session_id").alias("id"), F.lit(source).alias("source"), "directory", "branch",
            F.coalesce("_title", F.lit(TX.NO_TITLE)).alias("title"), F.lit(None).cast("string").alias("parent_id"),
            "started_at", "last_at", "message_count"]


def sessionize(msgs: DataFrame, source: str = "claude-code", state: bool = False) -> DataFrame:
    """AGG1: one session row per ``session_id`` (``schema.SESSION``); ``state`` adds
    ``first``, the place of the first message, and ``schema.SESSION_STATE``."""
    return _summary(msgs, ["session_id"]).select(*_session_cols(source), *(["first", "state"] if state else []))


def sessionize_latest(msgs: DataFrame, source: str = "claude-code") -> DataFrame:
    """AGG1 of each session's latest file (S9): a summary per session and file
    first, then the latest one's, so the lines are read once."""
    per_file = _summary(msgs, ["session_id", "path"])
    row = F.struct(*[c for c in per_file.columns if c not in ("session_id", "path")])
    latest = per_file.groupBy("session_id").agg(F.max_by(row, F.col("state.file")).alias("row"))
    return latest.select("session_id", "row.*").select(*_session_cols(source))


def assign_positions(msgs: DataFrame) -> DataFrame:
    """SRC10: 0-based position in ``(ts, path, block, line_no)`` order per session, slice
    by slice: the minute of the timestamp text, or a file's split without one."""
    has = F.col("ts").isNotNull()
    minute = F.struct((~has).alias("no_ts"), F.when(has, F.substring("ts", 1, 16)).otherwise("").alias("minute"),
                      F.when(has, "").otherwise(F.col("path")).alias("path"), F.when(has, 0).otherwise(F.col("block")).alias("block"))
    return sequence_within(msgs, "session_id", minute, [F.col("ts").asc_nulls_last(), "path", "block", "line_no"])


def usable_messages(lines: DataFrame, merge_files: bool = False) -> DataFrame:
    """Parsed, filtered and cleaned messages, of each session's latest file only
    unless ``merge_files``."""
    msgs = TR.clean(TR.usable(TR.parse_lines(lines))).withColumn("directory", TR.directory_of_path("path"))
    if "mtime_ms" not in msgs.columns:
        msgs = msgs.withColumn("mtime_ms", F.lit(0).cast("bigint"))
    if merge_files:
        return msgs
    return msgs.join(older_files(msgs), ["session_id", "path"], "left_anti")


def index_sessions(lines: DataFrame, merge_files: bool = False, source: str = "claude-code") -> DataFrame:
    """Lines -> session table rows."""
    return (sessionize if merge_files else sessionize_latest)(usable_messages(lines, merge_files=True), source)


def index_messages(lines: DataFrame, merge_files: bool = False) -> DataFrame:
    """Lines -> message table rows."""
    return assign_positions(usable_messages(lines, merge_files)).select(*SC.MESSAGE_COLS)


def prefix_owner(parsed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """AGG12: the project(s) holding sessions that start with each prefix.

    Lines are first reduced to distinct ``(session_id, directory)`` pairs;
    each id's prefixes of the requested lengths are then equi-joined with
    the prefix table, so all prefixes are resolved in one pass.
    """
    pairs = (parsed.where(F.col("session_id").isNotNull())
             .select("session_id", TR.directory_of_path("path").alias("directory"))
             .distinct())
    wanted = prefixes.select("prefix").distinct()
    # only the prefix lengths asked for; there are at most as many distinct
    # lengths as characters in the longest prefix, so the list is small
    lengths = sorted(r[0] for r in wanted.select(F.length("prefix").alias("n")).distinct()
                     .where(F.col("n") > 0).collect())
    if not lengths:
        return prefix_owner_empty(parsed.sparkSession)
    expanded = pairs.select("session_id", "directory", F.explode(F.array(
        *[F.substring("session_id", 1, n) for n in lengths])).alias("prefix"))
    return (expanded.join(wanted, "prefix")
            .groupBy("prefix")
            .agg(F.min("directory").alias("directory"),
                 F.count_distinct("directory").alias("projects"),
                 F.count_distinct("session_id").alias("sessions")))
