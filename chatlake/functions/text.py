"""Text column expressions (FN2-4, FN8-10, FN12, FN14, S1, S19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
NO_TITLE = "(no title)"
TITLE_MAX = 200
SNIPPET_MAX = 300
SHORT_ID_LEN = 8
PREVIEW_LINES = 8
ELLIPSIS = "..."

# Unicode-aware whitespace, like the \s of the transcripts' JavaScript.
_WS_RUN = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def usable_content(content="content") -> Column:
    """Text that is not NULL, longer than 2, and not JSON-looking."""
    c = _c(content)
    first = F.substring(c, 1, 1)
    return c.isNotNull() & (F.length(c) > 2) & (first != F.lit("[")) & (first != F.lit("{"))


def strip_nul(col) -> Column:
    """NUL bytes are removed on write."""
    return F.regexp_replace(_c(col), "\u0000", "")


def normalize_title(col, max_len: int = TITLE_MAX) -> Column:
    """FN3: whitespace runs -> one space, trimmed, first ``max_len`` chars."""
    return F.substring(F.trim(F.regexp_replace(_c(col), _WS_RUN, " ")), 1, max_len)


def title_or_default(col="title") -> Column:
    """FN14."""
    return F.coalesce(_c(col), F.lit(NO_TITLE))


def snippet(col="content", n: int = SNIPPET_MAX) -> Column:
    """FN4: first ``n`` characters (not centred on the hit)."""
    return F.substring(F.coalesce(_c(col), F.lit("")), 1, n)


def one_line(col="snippet", n: int = 120) -> Column:
    """FN4: the snippet in one line: white space runs become one blank, cut to ``n``."""
    return truncate_plain(F.regexp_replace(_c(col), _WS_RUN, " "), n)


def truncate_plain(col, n: int) -> Column:
    """FN8: keep if it fits, else ``n - 3`` chars and '...'."""
    c = _c(col)
    if n <= 0:
        return F.lit("")
    return F.when(F.length(c) <= n, c).otherwise(
        F.concat(F.substring(c, 1, max(n - 3, 0)), F.lit(ELLIPSIS)))


def project_name(col="directory") -> Column:
    """FN9: last path component."""
    return F.element_at(F.split(_c(col), "/"), -1)


def short_id(col="id", n: int = SHORT_ID_LEN) -> Column:
    """FN10."""
    return F.substring(_c(col), 1, n)


def first_lines(col="content", n: int = PREVIEW_LINES) -> Column:
    """FN12: first ``n`` lines, joined back with newlines."""
    return F.array_join(F.slice(F.split(_c(col), "\n"), 1, n), "\n")


def more_lines(col="content", n: int = PREVIEW_LINES) -> Column:
    """FN12: how many lines were cut."""
    return F.greatest(F.size(F.split(_c(col), "\n")) - F.lit(n), F.lit(0))


# ---- LIKE patterns (FLT6-8, S18, S19) -----------------------------------


def like_contains(keyword: str) -> str:
    """Pattern for a substring match.

    ``%`` and ``_`` in the keyword keep their wildcard meaning (as in the
    reference); a backslash is matched literally (Spark's LIKE escape is a
    backslash, so it is doubled).
    """
    return "%" + keyword.replace("\\", "\\\\") + "%"


def any_keyword(col, keywords: list[str]) -> Column:
    """FLT6: case-insensitive match of any keyword (OR)."""
    if not keywords:
        raise ValueError("at least one keyword is needed")
    c = _c(col)
    return reduce(lambda a, b: a | b, [c.ilike(like_contains(k)) for k in keywords])


def starts_with_any(col, prefixes: list[str], boundary: bool = False) -> Column:
    """FLT2: directory under any scope prefix.

    Plain ``startswith`` (pushed into the Parquet scan as StringStartsWith);
    ``boundary=True`` only accepts the prefix itself or a path below it.
    """
    c = _c(col)
    conds = []
    for p in prefixes:
        if boundary:
            base = p.rstrip("/")
            conds.append((c == F.lit(base)) | c.startswith(base + "/"))
        else:
            conds.append(c.startswith(p))
    return reduce(lambda a, b: a | b, conds)


def bidirectional_scope(col, prefixes: list[str]) -> Column:
    """FLT3: directory under a prefix, or a prefix under the directory."""
    c = _c(col)
    conds = [c.startswith(p) | F.lit(p).startswith(c) for p in prefixes]
    return reduce(lambda a, b: a | b, conds)


def contains_ci(col, needle: str) -> Column:
    """FLT14: plain (no wildcard) case-insensitive containment."""
    return F.contains(F.lower(_c(col)), F.lit(needle.lower()))


def scaled_tokens(col, unit: int, suffix: str) -> Column:
    """FN11: tokens in millions/billions with one decimal ('1.2M').

    Rounded half up in exact integer arithmetic (no binary-float edge cases).
    """
    c = _c(col).cast("decimal(38,0)")
    tenths = F.floor((c * 10 + F.lit(unit // 2)) / F.lit(unit)).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."),
                    F.pmod(tenths, F.lit(10)).cast("string"), F.lit(suffix))
