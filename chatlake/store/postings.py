"""Trigram postings for keyword search (FLT6, FLT7, TOP2, TOP3).

A row per trigram of the lower-cased content and session.  A keyword of three
characters or more without wildcards can stand only in sessions that have all its
trigrams; these are the candidates that a search reads.  ``ILIKE`` folds both sides
with the same ``lower``, so no match is lost; it still decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 4   # parts of a bucket, at least


def trigrams_of(keyword: str) -> list[str] | None:
    """Distinct trigrams of a keyword; None where postings can't tell."""
    k = keyword.lower()
    if len(k) < 3 or "%" in k or "_" in k:
        return None
    return sorted({k[i:i + 3] for i in range(len(k) - 2)})


def postings(messages: DataFrame) -> DataFrame:
    """(trigram, session_id), distinct within a message; linear in the text: a look-ahead
    takes the three characters at every place."""
    grams = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("(?s)(?=(...))"), F.lit(1)))
    return messages.select("session_id", F.explode(grams).alias("trigram")).select("trigram", "session_id")


def dealt(rows: DataFrame, tasks: int, parts: int) -> DataFrame:
    """Distinct rows, a bucket's in ``parts`` by a hash of the trigram: one exchange, which
    the grouping after it uses, and a long session's rows are in all parts."""
    cols = rows.columns
    spread = rows.withColumn("_part", F.pmod(F.hash("trigram"), F.lit(parts))).repartition(tasks, "bucket", "_part")
    return spread.dropDuplicates(["bucket", "_part", *(c for c in cols if c != "bucket")]).select(*cols)


def candidates(posting: DataFrame, keywords: list[list[str]]) -> DataFrame:
    """Sessions (session_id) that have all trigrams of one of the keywords."""
    every = sorted({g for k in keywords for g in k})
    rows = posting.where(F.col("trigram").isin(every)).distinct()
    per = rows.groupBy("session_id").agg(*[F.count_if(F.col("trigram").isin(k)).alias(f"k{i}") for i, k in enumerate(keywords)])
    return per.where(reduce(lambda a, b: a | b, [F.col(f"k{i}") == len(k) for i, k in enumerate(keywords)])).select("session_id")
