"""Session / message / raw-line / file-listing views derived from the
driver's tables.

The driver tables carry no directories, models or token counts, so those
are derived by fixed arithmetic (FIXTURES.md section 3).  Every view is a
lazy DataFrame over the whole input table, so its work grows with it.
The same definitions exist as SQL in ``chatlake.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.text import NO_TITLE, normalize_title

# Fixed values of the derivation (FIXTURES.md section 3).
EPOCH_BASE_MS = 1704067200000      # 2024-01-01T00:00:00Z
MS_PER_CONVERSATION = 7200000      # conversations start two hours apart
MS_PER_TURN = 60000                # turns one minute apart
TOOL_TOKENS = 7
ID_WIDTH = 20                      # holds every BIGINT, so no id is cut
MANIFEST_CUTOFF = "2024-01-15 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv_key(conv_id: Column) -> Column:
    return F.concat(F.lit("conv-"), F.lpad(conv_id.cast("string"), ID_WIDTH, "0"))


def message_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``message_v``: one row per user/assistant turn."""
    conv = read_table(spark, sf_dir, "conversations")
    cid, role = F.col("conv_id"), F.col("role")
    is_asst = role == F.lit("assistant")
    out_tok = F.when(is_asst, F.length("text").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return (conv.where(role.isin("user", "assistant"))
            .select(conv_key(cid).alias("session_id"),
                    role.alias("role"),
                    F.col("text").alias("content"),
                    (F.lit(EPOCH_BASE_MS) + cid * MS_PER_CONVERSATION
                     + F.col("turn") * MS_PER_TURN).alias("timestamp_ms"),
                    F.col("turn").cast("int").alias("position"),
                    F.when(is_asst, F.concat(F.lit("model-"), (cid % 3).cast("string"))).alias("model"),
                    out_tok.alias("output_tokens"),
                    (out_tok * 3).alias("cache_read"),
                    (out_tok % 7).alias("cache_write"),
                    cid.alias("conv_id")))


def session_view(messages: DataFrame) -> DataFrame:
    """``session_v``: one row per conversation, from ``message_view``."""
    cid = F.col("conv_id")
    agg = messages.groupBy("session_id", "conv_id").agg(
        F.min("timestamp_ms").alias("started_at"),
        F.max("timestamp_ms").alias("last_at"),
        F.count(F.when(F.col("role") == "user", 1)).cast("int").alias("message_count"),
        # normalise first: at most 200 characters travel through the aggregate
        F.min_by(F.when(F.col("role") == "user", normalize_title("content")),
                 F.when(F.col("role") == "user", F.col("position"))).alias("first_user"))
    return agg.select(
        F.col("session_id").alias("id"),
        F.when(cid % 4 == 0, F.lit("opencode")).otherwise(F.lit("claude-code")).alias("source"),
        F.concat(F.lit("/work/team"), (cid % 5).cast("string"),
                 F.lit("/proj"), (cid % 20).cast("string")).alias("directory"),
        F.when(cid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("branch-"), (cid % 3).cast("string"))).alias("branch"),
        F.coalesce(F.col("first_user"), F.lit(NO_TITLE)).alias("title"),
        F.when(cid % 60 >= 20, conv_key(cid - 20)).alias("parent_id"),
        "started_at", "last_at", "message_count", "conv_id")


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = message_view(spark, sf_dir)
    return m, session_view(m)


# ---- raw transcript lines --------------------------------------------------


def _iso_utc(ms: Column) -> Column:
    """Epoch ms -> 'yyyy-MM-ddTHH:mm:ssZ' without the session time zone."""
    day = F.date_from_unix_date(F.floor(ms / 86400000).cast("int")).cast("string")
    sec = F.floor(F.pmod(ms, F.lit(86400000)) / 1000).cast("int")
    return F.format_string("%sT%02d:%02d:%02dZ", day, F.floor(sec / 3600).cast("int"),
                           F.floor(F.pmod(sec, F.lit(3600)) / 60).cast("int"), F.pmod(sec, F.lit(60)))


def slug_of(directory: Column) -> Column:
    return F.regexp_replace(directory, "/", "-")


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_v``: JSON transcript lines ``(path, value)`` built from the
    conversations, plus ``system`` lines the parser must drop.

    One file per session under a project slug directory, as on disk.
    """
    conv = read_table(spark, sf_dir, "conversations")
    cid, role = F.col("conv_id"), F.col("role")
    is_asst = role == F.lit("assistant")
    ts = F.lit(EPOCH_BASE_MS) + cid * MS_PER_CONVERSATION + F.col("turn") * MS_PER_TURN
    out_tok = F.length("text").cast("bigint")
    directory = F.concat(F.lit("/work/team"), (cid % 5).cast("string"),
                         F.lit("/proj"), (cid % 20).cast("string"))
    branch = F.when(cid % 3 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("branch-"), (cid % 3).cast("string")))
    usage = F.when(is_asst, F.struct(out_tok.alias("output_tokens"),
                                     (out_tok * 3).alias("cache_read_input_tokens"),
                                     (out_tok % 7).alias("cache_creation_input_tokens")))
    message = F.struct(role.alias("role"), F.col("text").alias("content"),
                       F.when(is_asst, F.concat(F.lit("model-"), (cid % 3).cast("string"))).alias("model"),
                       usage.alias("usage"))
    # every third session writes some times with a fraction
    written = F.when((cid % 3 == 1) & (F.col("turn") % 2 == 1), F.regexp_replace(_iso_utc(ts), "Z$", ".000Z")).otherwise(_iso_utc(ts))
    line = F.struct(role.alias("type"), conv_key(cid).alias("sessionId"), written.alias("timestamp"),
                    branch.alias("gitBranch"), message.alias("message"),
                    F.concat(F.lit("u"), cid.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("uuid"))
    # one session in five has assistant turns that only use a tool: a further line
    # with array content and its own usage, which counts as a turn but has no text
    tool = F.struct(role.alias("type"), conv_key(cid).alias("sessionId"), _iso_utc(ts).alias("timestamp"),
                    branch.alias("gitBranch"), F.struct(
                        role.alias("role"), F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("grep").alias("name"))).alias("content"),
                        F.concat(F.lit("model-"), (cid % 3).cast("string")).alias("model"),
                        F.struct(F.lit(TOOL_TOKENS).alias("output_tokens")).alias("usage")).alias("message"))
    conv = conv.select("*", F.explode(F.when(
        is_asst & (cid % 5 == 2), F.array(F.to_json(line), F.to_json(tool))).otherwise(F.array(F.to_json(line)))).alias("value"))
    return conv.select(
        F.concat(F.lit("/projects/"), slug_of(directory), F.lit("/"), conv_key(cid), F.lit(".jsonl")).alias("path"),
        (F.lit(EPOCH_BASE_MS) + cid * MS_PER_CONVERSATION).alias("mtime_ms"),
        F.col("turn").alias("line_no"),
        "value")


# ---- file listing and manifest ----------------------------------------------


def _ntz_ms(ts: Column) -> Column:
    """timestamp_ntz -> epoch ms, independent of the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, ts)


def files_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files_v``: the current file listing ``(path, mtime_ms)``."""
    ev = read_table(spark, sf_dir, "events")
    uid = F.col("user_id")
    return (ev.where(uid % 10 != 0)
            .groupBy(uid)
            .agg(F.max(_ntz_ms(F.col("ts"))).alias("mtime_ms"))
            .select(F.concat(F.lit("/logs/u"), uid.cast("string")).alias("path"), "mtime_ms"))


def manifest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``manifest_v``: what the last run recorded ``(path, source, mtime_ms)``."""
    ev = read_table(spark, sf_dir, "events")
    uid = F.col("user_id")
    keep = (uid % 7 != 0) & ((uid % 2 == 0) | (F.col("ts") < F.lit(MANIFEST_CUTOFF).cast("timestamp_ntz")))
    return (ev.where(keep)
            .groupBy(uid)
            .agg(F.max(_ntz_ms(F.col("ts"))).alias("mtime_ms"))
            .select(F.concat(F.lit("/logs/u"), uid.cast("string")).alias("path"),
                    F.lit("claude-code").alias("source"), "mtime_ms"))


# ---- relational store stand-in ----------------------------------------------


def rel_session_view(sessions: DataFrame) -> DataFrame:
    """Relational ``session`` rows: some archived, some with empty titles or
    no slug, children pointing at parents."""
    cid = F.col("conv_id")
    return sessions.select(
        "id", "parent_id", "directory",
        F.when(cid % 7 == 0, F.lit("")).when(cid % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("title")).alias("title"),
        F.when(cid % 14 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("slug-"), cid.cast("string"))).alias("slug"),
        F.col("started_at").alias("time_created"),
        F.col("last_at").alias("time_updated"),
        F.when(cid % 11 == 5, F.col("last_at")).alias("time_archived"),
        "conv_id")


def rel_message_view(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.concat("session_id", F.lit(":"), F.lpad(F.col("position").cast("string"), ID_WIDTH, "0")).alias("id"),
        "session_id",
        F.to_json(F.struct(F.col("role").alias("role"))).alias("data"),
        F.col("timestamp_ms").alias("time_created"))


def rel_part_view(messages: DataFrame) -> DataFrame:
    """One part per line of a message; every fifth line is a non-text part,
    empty lines are text parts with empty text (both must be skipped)."""
    exploded = messages.select(
        "session_id", "position", "timestamp_ms",
        F.posexplode(F.split("content", "\n")).alias("idx", "line"))
    mid = F.concat("session_id", F.lit(":"), F.lpad(F.col("position").cast("string"), ID_WIDTH, "0"))
    ptype = F.when(F.col("idx") % 5 == 4, F.lit("reasoning")).otherwise(F.lit("text"))
    return exploded.select(
        F.concat(mid, F.lit(":"), F.col("idx").cast("string")).alias("id"),
        mid.alias("message_id"),
        "session_id",
        F.to_json(F.struct(ptype.alias("type"), F.col("line").alias("text"))).alias("data"),
        (F.col("timestamp_ms") + F.col("idx")).alias("time_created"))


def relational_views(spark: SparkSession, sf_dir: str,
                     own_sessions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(session, message, part)`` of the relational store, over all
    conversations.  ``own_sessions`` keeps those whose derived source is
    'opencode', for queries that merge it with the other source."""
    m, s = views(spark, sf_dir)
    if own_sessions:
        m, s = (x.where(F.col("conv_id") % 4 == 0) for x in (m, s))
    return rel_session_view(s), rel_message_view(m), rel_part_view(m)
