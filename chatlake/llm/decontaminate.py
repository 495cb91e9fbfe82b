"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every item is cut into windows of ``size`` consecutive words (an item of
fewer words is one window).  The windows form a hash set; each token window
of a document is looked up by hash and a hit is verified word by word.  Only
DataFrame functions run here.

Rows: every input row gets its own result row.  NULL and empty texts have no
words.  An item without words has no window.  Items sharing a window all
count; a repeated ``item_id`` counts once; a NULL ``item_id`` counts as ''.
Empty tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import doc_key, key_join, words

WINDOW = 13
BROADCAST_WINDOWS = 1_000_000  # windows that may be broadcast (about 200 MB at 13 words)


def benchmark_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, gram, n, h): the distinct windows of every item."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                     words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = w.select("item", "w", F.explode(F.sequence(
        F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))).alias("p"))
    return (at.select("item", F.slice("w", F.col("p"), size).alias("gram")).distinct()
            .select("item", "gram", F.size("gram").alias("n"), F.xxhash64("gram").alias("h")))


def _hits(rows: DataFrame, windows: DataFrame, keep: list[str]) -> DataFrame:
    """Token windows of ``rows`` (columns ``keep`` and ``w``) that occur in
    ``windows``; every row also keeps its first position without a hit."""
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `size` values
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    at = rows.select(*keep, "w", F.posexplode_outer("w").alias("pos", "word"))
    at = at.withColumn("pos", F.coalesce("pos", F.lit(0)))
    if len(lengths) == 1:
        at = at.withColumn("len", F.lit(lengths[0]))
    else:
        at = at.withColumn("len", F.explode(F.array(*map(F.lit, lengths or [1]))))
    gram = F.slice("w", F.col("pos") + 1, F.col("len"))
    at = at.select(*keep, "pos", "len", gram.alias("g")).withColumn("gh", F.xxhash64("g"))
    found = at.join(F.broadcast(windows) if few else windows,
                    (F.col("gh") == F.col("h")) & (F.col("g") == F.col("gram")), "left")
    # a window cut short by the text's end may be that of a shorter item: its own length counts
    return found.where((F.col("pos") == 0) | F.col("item").isNotNull()).withColumn("len", F.col("n")).drop("g", "gh", "gram", "h", "n")


def _covered(hits) -> F.Column:
    """Words covered by an array of (pos, len) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.sort_array(hits), zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["pos"] + x["len"] - F.greatest(x["pos"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], x["pos"] + x["len"]).alias("end")),
        lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, ratio: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and
    the document's key columns, one row per document.  A document is contaminated
    if ``n_hit > 0`` and ``ratio * n_hit >= n_words``."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *doc_key(),
                       words(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    hits = _hits(rows, benchmark_windows(items, size), ["rid", "k_id", "k_text", "k_len", "n_words"])
    span = F.when(F.col("item").isNotNull(), F.struct("pos", "len"))
    per = hits.groupBy("rid").agg(
        *[F.any_value(c).alias(c) for c in ("k_id", "k_text", "k_len", "n_words")],
        F.collect_set(span).alias("spans"), F.collect_set("item").alias("items"))
    return per.select(
        F.col("k_id").alias("doc_id"), "n_words", _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        "spans", "k_id", "k_text", "k_len",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, ratio: int = 20) -> DataFrame:
    """Documents without the contaminated ones."""
    bad = (contamination(docs, items, size, ratio).where("contaminated")
           .select("k_id", "k_text", "k_len").distinct())
    return key_join(docs, bad, "left_anti")
