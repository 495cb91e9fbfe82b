"""Line-delimited JSON transcripts (SRC1-5, SRC11, SRC12).

``scan_lines`` reads the ``*.jsonl`` files of every project directory under a
root (or the changed ones among them) with the text source: one row per line,
plus the file path and modification time from the ``_metadata`` column.  ``parse_lines`` turns
each line into typed columns with one ``from_json`` against a fixed schema
(no inference, no per-path re-parsing).  Bad JSON, blank and over-long
lines give NULL fields instead of failing the job; ``line_rejects`` counts
them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schema as SC
from chatlake.functions import json as JS
from chatlake.functions import text as TX
from chatlake.functions import time as TM

MAX_LINE_CHARS = 10_000_000      # longest line the reference accepts
USABLE_TYPES = ("user", "assistant")


def _plain(path: Column) -> Column:
    """A file URI as a plain path: percent-decoded, one slash after the scheme."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def _literal(path: str) -> str:
    """``path`` with the characters that Spark reads as a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _root_uri(spark: SparkSession, root: str) -> str:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(hadoop).toString().rstrip("/")
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", uri)


def _one_level(path: Column, root: str) -> Column:
    """True for ``<root>/<project>/<file>`` and nothing deeper (SRC4)."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]+/[^/]+$", 1) == F.lit(root)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


LINES = "path string, mtime_ms long, block long, line_no long, bytes long, value string"
FILES = "path string, uri string, mtime_ms long, size long, slug string, directory string"


def scan_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", only: list[str] | None = None,
               folders: list[str] | None = None) -> DataFrame:
    """SRC1: ``(path, mtime_ms, block, line_no, bytes, value)`` of ``<root>/<project>/<glob>``.

    ``only`` restricts the scan to files by their ``uri`` (see ``list_files``);
    the predicate is on a file's metadata, so other files are not opened.
    ``folders``: the project folders to list, where they are known.
    ``(path, block, line_no)`` is the order of the lines in a file, whatever else
    the scan reads: the offset at which a split begins, then a number that rises
    within it.  ``bytes`` is the line's length with its line feed.  A file that has
    vanished or can't be read gives fewer bytes than it has.  No root, no lines.
    """
    paths = [_literal(x) for x in ([root] if folders is None else folders) if _exists(spark, x)]
    if not paths:
        return spark.createDataFrame([], LINES)
    df = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("lineSep", "\n")
          .option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).text(paths))
    uri = F.col("_metadata.file_path")
    if only is not None:
        df = df.where(uri.isin(only))
    df = df.select(
        uri.alias("uri"),
        F.unix_millis(F.col("_metadata.file_modification_time")).alias("mtime_ms"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
        F.rtrim(F.ltrim("value", F.lit("\ufeff")), F.lit("\r")).alias("value"))
    return df.select(_plain(F.col("uri")).alias("path"), "mtime_ms", "block", "line_no", "bytes", "value").where(
        _one_level(F.col("path"), _root_uri(spark, root)))


def list_files(spark: SparkSession, root: str, glob: str = "*.jsonl", slug_map: dict[str, str] | None = None) -> DataFrame:
    """SRC4: ``(path, uri, mtime_ms, size, slug, directory)`` without reading content.

    ``binaryFile`` with only metadata columns selected prunes ``content``
    from the read schema.  A root that is not there yet holds no files.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], FILES)
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).load(_literal(root)))
    uri = F.col("_metadata.file_path")
    return df.select(_plain(uri).alias("path"), uri.alias("uri"),
                     F.unix_millis("modificationTime").alias("mtime_ms"),
                     F.col("length").alias("size")).where(
        _one_level(F.col("path"), _root_uri(spark, root))).select(
        "*", slug_of_path("path").alias("slug"), directory_of_path("path", slug_map).alias("directory"))


def slug_of_path(path_col) -> F.Column:
    """The project directory name holding the file."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.element_at(F.split(p, "/"), -2)


def slug_to_directory(slug_col, slug_map: dict[str, str] | None = None) -> F.Column:
    """SRC5 (S15): every '-' becomes '/', unless ``slug_map`` names the directory."""
    s = F.col(slug_col) if isinstance(slug_col, str) else slug_col
    out = F.regexp_replace(s, "-", "/")
    if slug_map:
        known = F.create_map(*[F.lit(x) for kv in slug_map.items() for x in kv])
        out = F.coalesce(F.try_element_at(known, s), out)
    return out


def directory_of_path(path_col, slug_map: dict[str, str] | None = None) -> F.Column:
    return slug_to_directory(slug_of_path(path_col), slug_map)


def parse_lines(lines: DataFrame, max_line_chars: int = MAX_LINE_CHARS) -> DataFrame:
    """SRC2: typed columns of each line (see ``schema.RAW_ROW``)."""
    ok = F.length("value") <= F.lit(max_line_chars)
    j = F.when(ok, F.from_json(F.col("value"), SC.TRANSCRIPT_LINE, {"mode": "PERMISSIVE"}))
    # Parse exactly once per line.  As a plain projection, later filters on
    # the fields would be pushed below it with ``from_json`` inlined into
    # every field reference (one parse per field).  A filter on a generator's
    # output cannot move below the generator, so the parse stays single.
    parsed = lines.select("*", F.explode(F.array(j)).alias("_j"))
    cols = [c for c in ("path", "mtime_ms", "block", "line_no", "bytes") if c in lines.columns]
    if "block" not in cols:
        cols.append(F.lit(0).cast("bigint").alias("block"))
    return parsed.select(
        *cols,
        F.col("_j.type").alias("msg_type"),
        F.col("_j.sessionId").alias("session_id"),
        F.col("_j.timestamp").alias("ts"),
        F.col("_j.gitBranch").alias("branch"),
        F.col("_j.message.role").alias("role"),
        F.col("_j.message.content").alias("content"),
        F.col("_j.message.model").alias("model"),
        JS.to_bigint(F.col("_j.message.usage.output_tokens")).alias("output_tokens"),
        JS.to_bigint(F.col("_j.message.usage.cache_read_input_tokens")).alias("cache_read"),
        JS.to_bigint(F.col("_j.message.usage.cache_creation_input_tokens")).alias("cache_write"),
        F.when(~ok, F.lit("too_long"))
         .when(F.trim("value") == "", F.lit("blank"))
         .when(F.col("_j").isNull()
               | (F.col("_j.type").isNull() & F.col("_j.sessionId").isNull() & F.col("_j.message").isNull()),
               F.lit("malformed"))
         .alias("reject"))


def usable(parsed: DataFrame) -> DataFrame:
    """SRC3 (S1, S2, S3): user/assistant lines with usable text and a session."""
    return parsed.where(F.col("msg_type").isin(*USABLE_TYPES)
                        & TX.usable_content("content")
                        & F.col("session_id").isNotNull())


def clean(msgs: DataFrame) -> DataFrame:
    """SRC11 + SRC12: epoch ms, NUL-free text, token defaults 0."""
    return msgs.select(
        "*",
        TM.iso_to_ms("ts").alias("timestamp_ms"),
    ).withColumn("content", TX.strip_nul("content")) \
     .withColumn("output_tokens", F.coalesce("output_tokens", F.lit(0).cast("bigint"))) \
     .withColumn("cache_read", F.coalesce("cache_read", F.lit(0).cast("bigint"))) \
     .withColumn("cache_write", F.coalesce("cache_write", F.lit(0).cast("bigint")))


def line_rejects(parsed: DataFrame) -> DataFrame:
    """Reject accounting: lines per reason (blank, malformed, too long)."""
    return parsed.where(F.col("reject").isNotNull()).groupBy("reject").agg(
        F.count(F.lit(1)).alias("lines"))
