"""JSON column expressions (FN1, S33)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_str(col, path: str) -> Column:
    """JSON path -> text; objects/arrays come back as JSON text, bad JSON -> NULL."""
    return F.get_json_object(_c(col), path)


def to_bigint(text_col) -> Column:
    """Token text -> BIGINT: '1.5' -> 2 (half up), arrays/junk -> NULL.

    ``try_cast`` keeps ANSI mode from raising on junk.
    """
    dec = _c(text_col).try_cast("decimal(38,4)")
    return F.round(dec, 0).try_cast("bigint")


def json_bigint(col, path: str) -> Column:
    return to_bigint(json_str(col, path))
