"""Row filters over the session and message tables (FLT1-15).

List-valued scopes become OR-ed ``startswith`` predicates that Catalyst
pushes into the Parquet scan.  A scope given as a DataFrame (any size) is
matched with an equi-join on the directory's prefixes, so no nested-loop
join and no broadcast of unknown size is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as TX


def _scope_prefixes(df: DataFrame, col: str) -> DataFrame:
    """Every prefix of ``col`` as ``_prefix`` (one row each).

    Directories are short paths, so the expansion is a small constant factor.
    """
    n = F.length(F.col(col))
    return df.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                                lambda i: F.substring(F.col(col), 1, i))).alias("_prefix"))


def in_scope(df: DataFrame, scope, col: str = "directory", boundary: bool = False) -> DataFrame:
    """FLT2: keep rows whose ``col`` starts with any scope prefix.

    ``scope`` is a list of prefixes, or a DataFrame with a ``prefix`` column.
    """
    if scope is None:
        return df
    if isinstance(scope, DataFrame):
        pref = scope.select(F.col("prefix").alias("_prefix")).distinct()
        dirs = df.select(F.col(col)).distinct()
        if boundary:
            # the path itself or one of its ancestor directories
            pref = pref.select(F.regexp_replace("_prefix", "/+$", "").alias("_prefix"))
            parts = F.split(F.col(col), "/")
            cand = dirs.select(col, F.explode(F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
                lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_prefix"))
        else:
            cand = _scope_prefixes(dirs, col)
        matched = cand.join(pref, "_prefix", "left_semi").select(col).distinct()
        return df.join(matched, col, "left_semi")
    if not scope:
        return df
    return df.where(TX.starts_with_any(col, list(scope), boundary=boundary))


def in_scope_bidirectional(df: DataFrame, scope, col: str = "directory") -> DataFrame:
    """FLT3: directory under a prefix or a prefix under the directory.

    A scope DataFrame (column ``prefix``) is matched by equi-joins both ways:
    prefixes of the distinct directories with the scope, and prefixes of the
    distinct scope rows with the directories.
    """
    if isinstance(scope, DataFrame):
        pref = scope.select("prefix").where(F.col("prefix").isNotNull()).distinct()
        dirs = df.select(F.col(col).alias("_dir")).distinct()
        under = _scope_prefixes(dirs, "_dir").join(pref.withColumnRenamed("prefix", "_prefix"), "_prefix", "left_semi").select("_dir")
        above = dirs.join(_scope_prefixes(pref, "prefix").select(F.col("_prefix").alias("_dir")), "_dir", "left_semi")
        return df.join(under.unionByName(above).distinct(), F.col(col) == F.col("_dir"), "left_semi")
    if not scope:
        return df
    return df.where(TX.bidirectional_scope(col, scope))


def filter_sessions(sessions: DataFrame, source: str | None = None, scope=None,
                    since_ms: int | None = None, boundary: bool = False,
                    bidirectional: bool = False) -> DataFrame:
    """FLT1 + FLT2/3 + FLT4 on the session table."""
    out = sessions
    if source:
        out = out.where(F.col("source") == F.lit(source))
    if since_ms is not None:
        out = out.where(F.col("last_at") >= F.lit(int(since_ms)))
    if bidirectional and scope is not None:
        out = in_scope_bidirectional(out, scope if isinstance(scope, DataFrame) else list(scope))
    else:
        out = in_scope(out, scope, boundary=boundary)
    return out


def session_prefixes(df: DataFrame, prefixes: DataFrame, col: str = "session_id") -> DataFrame:
    """FLT8 set-wise: rows whose id starts with any of the ``prefix`` values, by an
    equi-join on the id's prefixes of the asked lengths (a short list)."""
    wanted = prefixes.select(F.col("prefix").alias("_prefix")).where(F.length("prefix") > 0).distinct()
    lengths = sorted(r[0] for r in wanted.select(F.length("_prefix")).distinct().collect())
    if not lengths:
        return df.limit(0)
    ids = df.select(F.col(col).alias("_id")).distinct()
    ids = ids.select("_id", F.explode(F.array(*[F.substring("_id", 1, n) for n in lengths])).alias("_prefix"))
    return df.join(ids.join(wanted, "_prefix", "left_semi").select("_id").distinct(), F.col(col) == F.col("_id"), "left_semi")


def position_range(df: DataFrame, from_: int | None = None, to: int | None = None,
                   around: int | None = None, radius: int = 3) -> DataFrame:
    """FLT9/FLT10: ``[from, to)``; ``around``/``radius`` override both."""
    if around is not None:
        from_, to = max(0, around - radius), around + radius + 1
    out = df
    if from_ is not None:
        out = out.where(F.col("position") >= F.lit(from_))
    if to is not None:
        out = out.where(F.col("position") < F.lit(to))
    return out


def role_is(df: DataFrame, role: str | None) -> DataFrame:
    """FLT11: only 'user' / 'assistant' filter; anything else is ignored."""
    if role in ("user", "assistant"):
        return df.where(F.col("role") == F.lit(role))
    return df


def unarchived(df: DataFrame, roots_only: bool = False) -> DataFrame:
    """FLT12."""
    out = df.where(F.col("time_archived").isNull())
    if roots_only:
        out = out.where(F.col("parent_id").isNull())
    return out


def with_user_messages(df: DataFrame, col: str = "message_count") -> DataFrame:
    """FLT13 (post-aggregation)."""
    return df.where(F.col(col) > 0)


def text_filter(sessions: DataFrame, query: str) -> DataFrame:
    """FLT14: title, directory or project name contains ``query`` (case-insensitive)."""
    q = query.lower()
    return sessions.where(TX.contains_ci(F.coalesce("title", F.lit("")), q)
                          | TX.contains_ci("directory", q)
                          | TX.contains_ci(TX.project_name("directory"), q))
