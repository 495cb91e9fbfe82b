"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.session import checkpoint_dir, scratch_path

# Words: maximal runs of ASCII digits, lower-case ASCII letters and non-ASCII
# characters (the text is lower-cased for A-Z first).
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Words of the whole text; NULL has none."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD_PATTERN), F.lit(0))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder: cuts the lineage
    as ``checkpoint`` does, but columnar and compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` that do not clash, in any letter case, with ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def extended(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns that clash with ``fields``, and the schema that
    has ``fields`` after its columns (for ``mapInArrow`` pass-through)."""
    kept = df.select(*[F.col(f"`{c}`") for c in without(df, [f.name for f in fields])])
    return kept, T.StructType([*kept.schema.fields, *fields])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def doc_key() -> list[Column]:
    """Key of a document that survives a recomputation: id and text.  Rows
    that repeat both are the same document and get the same decision."""
    return [F.col("doc_id").alias("k_id"), F.xxhash64(F.col("text")).alias("k_text"),
            F.length("text").alias("k_len")]


def key_join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join documents ``a`` with rows ``b`` keyed by ``doc_key`` columns."""
    cond = (a["doc_id"].eqNullSafe(b["k_id"]) & F.xxhash64(a["text"]).eqNullSafe(b["k_text"])
            & F.length(a["text"]).eqNullSafe(b["k_len"]))
    return a.join(b, cond, how)
