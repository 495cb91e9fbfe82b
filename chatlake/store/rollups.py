"""Stored roll-ups, maintained by difference (AGG5, AGG7, AGG9, AGG10).

Grain tables hold a row per (session, model) and per (session, UTC day), so
distinct sessions stay exact.  A commit writes the touched sessions' grain anew;
the totals by source, directory and model or day change by what these sessions
have now less what they had.  A session that is replaced, moves to another
directory or is deleted is thereby taken back without reading any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import time as TM
from chatlake.schema import TOKENS

USAGE_SUMS, DAY_SUMS = ["turns", *TOKENS], ["sessions", "user_msgs", "asst_turns"]


def _sums(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    whole = {c: "decimal(38,0)" if c in TOKENS else "long" for c in sums}
    return df.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in whole.items()])


def usage_grain(messages: DataFrame) -> DataFrame:
    asst = messages.where(F.col("model").isNotNull() & (F.col("role") == "assistant"))
    return asst.groupBy("session_id", "model").agg(
        F.count(F.lit(1)).alias("turns"), *[F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(c) for c in TOKENS])


def merged_usage(rows: DataFrame) -> DataFrame:
    return _sums(rows, ["session_id", "model"], USAGE_SUMS)


def day_grain(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "role", TM.day_of_ms("timestamp_ms", "UTC").alias("day")).groupBy("session_id", "day").agg(
        F.count_if(F.col("role") == "user").alias("user_msgs"), F.count_if(F.col("role") == "assistant").alias("asst_turns"))


def merged_days(rows: DataFrame) -> DataFrame:
    return _sums(rows, ["session_id", "day"], DAY_SUMS[1:])


def _placed(grain: DataFrame, sessions: DataFrame) -> DataFrame:
    return grain.join(sessions.select(F.col("id").alias("session_id"), "source", "directory"), "session_id")


def usage_totals(grain: DataFrame, sessions: DataFrame) -> DataFrame:
    return _sums(_placed(grain, sessions), ["source", "directory", "model"], USAGE_SUMS)


def day_totals(grain: DataFrame, sessions: DataFrame) -> DataFrame:
    return _sums(_placed(grain, sessions).withColumn("sessions", F.lit(1)), ["source", "directory", "day"], DAY_SUMS)


def difference(has: DataFrame, had: DataFrame) -> DataFrame:
    """Totals now less totals before, where they differ."""
    sums = [c for c in has.columns if c in USAGE_SUMS or c in DAY_SUMS]
    keys = [c for c in has.columns if c not in sums]
    less = had.select(*keys, *[(-F.col(c)).alias(c) for c in sums])
    delta = _sums(has.unionByName(less), keys, sums)
    return delta.where(" or ".join(f"{c} <> 0" for c in sums))


def applied_usage(rows: DataFrame) -> DataFrame:
    return _sums(rows, ["source", "directory", "model"], USAGE_SUMS).where("turns <> 0")


def applied_days(rows: DataFrame) -> DataFrame:
    return _sums(rows, ["source", "directory", "day"], DAY_SUMS).where("sessions <> 0")
