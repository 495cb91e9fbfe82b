"""JSON output of any result (SNK12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row in a ``json`` column."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a result as line-delimited JSON files (distributed, no collect)."""
    df.write.mode(mode).json(path)
