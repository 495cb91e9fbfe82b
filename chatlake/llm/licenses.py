"""License scan by diagonal voting.

Every text is cut into words (``common.words``).  All rolling ``k``-word hashes
are joined with the template positions that have the same hash (and, in the
join condition, the same words).  A match at word p of the document and word
t of the template votes for the diagonal p - t, where the template would
start.  Votes are aggregated per (document, template, diagonal) as a bit mask
of template positions; diagonals at most ``shift`` apart are merged, as an
inserted or lost word moves the rest of the passage to the next diagonal; and
a span is verified: a *base* phrase must have all its votes on one diagonal,
which means that its words stand consecutively, other templates at least
``coverage`` of theirs inside a span of at most twice their length.

The template table is a parameter of fixed size (``MAX_WORDS`` words each), so
it is broadcast; only matches are shuffled, and votes are aggregated first.

Rows: one result per input row, repeated rows included.  NULL and empty texts
have no words and no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import words

K = 2
SHIFT = 2
COVERAGE = 0.75
MAX_WORDS = 64  # votes are bits of a long

BASE = [  # fixed by the contract
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
NOTICES = [
    ("agpl", "under the terms of the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by "
            "the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software released into the public domain"),
]


def template_grams(spark: SparkSession, base=None, notices=None, k: int = K) -> DataFrame:
    """(tpl, label, base, n, t, gram, h): every k-gram of every template."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    rows = [(i, label, i < len(base), text) for i, (label, text) in enumerate([*base, *notices])]
    if any(not k <= len(text.split()) <= MAX_WORDS for _, _, _, text in rows):
        raise ValueError(f"templates have {k} to {MAX_WORDS} words")
    t = spark.createDataFrame(rows, "tpl int, label string, base boolean, text string")
    t = t.withColumn("tw", words(F.col("text"))).withColumn("n", F.size("tw") - (k - 1))
    t = t.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return (t.withColumn("gram", F.slice("tw", F.col("t") + 1, k))
            .select("tpl", "label", "base", "n", "t", "gram", F.xxhash64("gram").alias("h")))


def spans(docs: DataFrame, grams: DataFrame, k: int = K, shift: int = SHIFT, coverage: float = COVERAGE) -> DataFrame:
    """rid, doc_id, n_words, label, base, start, stop, cover: the verified spans, and
    one row with NULL label for each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    at = rows.select("rid", "doc_id", "n_words", "w", F.posexplode_outer("w").alias("pos", "word"))
    at = at.select("rid", "doc_id", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"),
                   F.slice("w", F.coalesce("pos", F.lit(0)) + 1, k).alias("g")).withColumn("gh", F.xxhash64("g"))
    votes = at.join(F.broadcast(grams), (F.col("gh") == F.col("h")) & (F.col("g") == F.col("gram")), "left")
    votes = votes.where((F.col("pos") == 0) | F.col("tpl").isNotNull())
    # the first position stands for the document: it carries a row without template
    votes = votes.select("rid", "doc_id", "n_words", "pos", F.explode(F.when(
        (F.col("pos") == 0) & F.col("tpl").isNotNull(), F.array(F.struct("tpl", "label", "base", "n", "t"), F.lit(None)))
        .otherwise(F.array(F.struct("tpl", "label", "base", "n", "t")))).alias("m"))
    votes = votes.select("rid", "doc_id", "n_words", "pos", "m.*")
    diag = votes.groupBy("rid", "tpl", (F.col("pos") - F.col("t")).alias("d")).agg(
        *[F.any_value(c).alias(c) for c in ("doc_id", "n_words", "label", "base", "n")],
        F.bit_or(F.expr("shiftleft(1L, t)")).alias("mask"), F.min("pos").alias("start"), F.max("pos").alias("last"))
    line = Window.partitionBy("rid", "tpl").orderBy("d")
    fresh = F.col("tpl").isNull() | F.col("base") | (
        F.col("d") - F.coalesce(F.lag("d").over(line), F.lit(-(1 << 40))) > shift)
    merged = diag.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("long")).withColumn(
        "run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy("rid", "tpl", "run").agg(
        *[F.any_value(c).alias(c) for c in ("doc_id", "n_words", "label", "base", "n")],
        F.expr("bit_or(mask)").alias("mask"), F.min("start").alias("start"), (F.max("last") + k - 1).alias("stop"))
    found = found.withColumn("cover", F.expr("bit_count(mask)") / F.col("n"))
    width = F.col("stop") - F.col("start") + 1
    good = F.when(F.col("base"), F.col("cover") == 1).otherwise(
        (F.col("cover") >= coverage) & (width <= 2 * (F.col("n") + k - 1)))
    return found.where(F.col("tpl").isNull() | good).select(
        "rid", "doc_id", "n_words", "label", "base", "start", "stop", "cover")


def scan(docs: DataFrame, grams: DataFrame, **how) -> DataFrame:
    """One row per document: counts, first and last base place, labels, score
    (the best coverage of any span, 0 without one) and the spans."""
    found = spans(docs, grams, **how)
    base = F.col("base")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return found.groupBy("rid").agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("start", "stop", "label")))).alias("spans"),
    ).drop("rid")
