"""URL filters: host word segmentation and multinomial naive Bayes.

A URL's host (lower-cased) and path are judged by rules first: a rule
``host/path`` fits its host and all subdomains if the URL's path starts with
the rule's; the longest fitting rule wins.  A URL without a rule is judged by
the method:

1. Host labels and path parts are cut into pieces at everything but letters
   and digits.  A piece of letters is split into words by a unigram Viterbi:
   word counts come from the text of all pages, words of any length, and the
   split with the largest probability wins.  Substrings of up to ``STEM``
   letters of a distinct piece are joined with the words; a longer word is
   found by its first ``STEM`` letters and then compared whole.  An unknown
   substring of n letters has the probability of one count over 10 ** n times
   the total, so known words are preferred to unknown ones and one long
   unknown word to many short ones.  Only distinct pieces are split; pieces
   and substrings are rows, so nothing is broadcast.
2. Multinomial naive Bayes with add-one smoothing scores the words of host and
   path (the two are told apart), with equal class priors.  It learns from all
   URLs that a rule judges.  ``block`` needs a score above 0.

A NULL URL or one without ``://`` has an empty host and path and no words.  A
URL without words, or where nothing was learned, is allowed.  Pages without
text (NULL or empty) count no words; URLs and texts are read whole, however
long.  Rows are kept one for one; equal URLs are judged once.  An empty table
gives an empty result.  Only page_id, url and html are read, so further columns
of any name can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import checkpoint, lower_ascii, saved

RULES = [  # fixed by the contract: verdict, host, path
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
STEM = 24  # letters of a word that the join compares; longer words are compared whole after it
UNKNOWN = 10.0


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule as struct(rule, verdict), or NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def pieces(host: Column, path: Column) -> Column:
    """Array of (part, piece): runs of letters or of digits, by part."""
    runs = lambda c, part: F.transform(
        F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\p{N}+"), F.lit(0)),
        lambda x: F.struct(F.lit(part).alias("part"), x.alias("piece")))
    return F.concat(runs(host, "h"), runs(path, "p"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): letters-only words of column ``html`` outside tags, all rows."""
    plain = F.regexp_replace(F.regexp_replace(
        F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>|&\w+;", " ")
    w = texts.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(piece: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The split of ``piece`` with the largest probability.  ``known`` maps
    (start, length) of substrings that are words to log probabilities; an
    unknown word of n letters has ``unknown - n * ln 10``.  Ties go to fewer words."""
    per = math.log(UNKNOWN)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(len(piece) + 1)]
    for (s, n), p in known.items():
        if s + n <= len(piece):
            ends[s + n].append((s, p))
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # log probability, minus words, last word's start
    lead = (0.0, 0, 0)  # the best start of an unknown word, whatever its end
    for end in range(1, len(piece) + 1):
        s = lead[2]
        best.append(max([(best[s][0] + unknown - per * (end - s), best[s][1] - 1, s),
                         *((best[s][0] + p, best[s][1] - 1, s) for s, p in ends[end])]))
        lead = max(lead, (best[end][0] + per * end, best[end][1], end))
    out, end = [], len(piece)
    while end:
        s = best[end][2]
        out.append(piece[s:end])
        end = s
    return out[::-1]


def segment(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words): distinct pieces of ``found`` (column piece) split into words."""
    one = found.select("piece").distinct()
    total = counts.agg(F.sum("n").alias("total"))  # one row
    # a long piece travels with its substrings as a digest only
    one = one.withColumn("pid", F.when(F.length("piece") <= STEM, F.col("piece")).otherwise(
        F.concat(F.lit("#"), F.md5("piece"))))
    at = one.where(F.col("piece").rlike(r"^\p{L}")).withColumn("s", F.explode(F.sequence(F.lit(1), F.length("piece"))))
    at = at.select("pid", "s", F.substring("piece", F.col("s"), F.lit(STEM)).alias("from"))
    subs = at.select("pid", "s", F.explode(F.sequence(F.lit(1), F.length("from"))).alias("len"), "from")
    subs = subs.select("pid", "s", "len", F.expr("substring(from, 1, len)").alias("word"))
    short = subs.join(counts.where(F.length("word") <= STEM), "word").select("pid", "s", "len", "n")
    long = counts.where(F.length("word") > STEM).select("n", F.col("word").alias("whole"), F.substring("word", 1, STEM).alias("word"))
    long = (at.where(F.length("from") == STEM).withColumnRenamed("from", "word").join(long, "word").join(one, "pid")
            .where(F.expr("substring(piece, s, length(whole)) = whole")).select("pid", "s", F.length("whole").alias("len"), "n"))
    hits = short.unionByName(long).groupBy("pid").agg(F.collect_list(F.struct("s", "len", "n")).alias("known"))
    rows = one.join(hits, "pid", "left").join(F.broadcast(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for piece, known, total in zip(*(b.column(c).to_pylist() for c in ("piece", "known", "total"))):
                log = math.log(max(total or 0, 1))
                table = {(k["s"] - 1, k["len"]): math.log(k["n"]) - log for k in known or []}
                out.append([piece] if piece[:1].isnumeric() else viterbi(piece, table, -log))
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(out, pa.list_(pa.string()))], names=["piece", "words"])

    return rows.select("piece", "known", "total").mapInArrow(run, "piece string, words array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score (log odds of block; NULL where a
    rule decides) and words of host and path, one row per row of ``pages``."""
    rules = RULES if rules is None else rules
    url = F.col("url")
    seen = pages.groupBy("url").agg(F.count("*").alias("copies"))
    seen = seen.select("url", "copies", host_of(url).alias("host"), path_of(url).alias("path"))
    seen = checkpoint(seen.withColumn("r", rule_of(rules, F.col("host"), F.col("path")))
                      .withColumn("id", F.xxhash64("host", "path")))
    paths = seen.groupBy("id", "host", "path").agg(F.any_value("r").alias("r"), F.sum("copies").alias("copies"))
    parts = paths.select("id", "r", "copies", F.explode(pieces(F.col("host"), F.col("path"))).alias("x"))
    parts = parts.select("id", "r", "copies", "x.part", "x.piece")
    # written: the texts are read once for the total, the short and the long words
    split = segment(parts, saved(word_counts(pages), "url-counts"))
    tokens = checkpoint(parts.join(split, "piece").select(
        "id", "r", "copies", "part", F.explode("words").alias("word")))
    # naive Bayes over the tokens of rule-judged URLs
    taught = tokens.where("r is not null").groupBy("part", "word").agg(
        F.sum(F.when(F.col("r.verdict") == "block", F.col("copies")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("r.verdict") == "allow", F.col("copies")).otherwise(0)).alias("good"))
    totals = taught.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count("*").alias("kinds"))
    # written first: the join below then shuffles two plain tables, and a hot word can be split
    odds = saved(taught.join(F.broadcast(totals)).select(
        "part", "word", (F.log((F.col("bad") + 1) / (F.col("all_bad") + F.col("kinds")))
                         - F.log((F.col("good") + 1) / (F.col("all_good") + F.col("kinds")))).alias("odds")), "url-odds")
    uses = tokens.where("r is null").groupBy("id", "part", "word").agg(F.count("*").alias("m"))
    scored = uses.join(odds, ["part", "word"]).groupBy("id").agg(
        F.sum((F.col("m") * F.col("odds")).cast("decimal(30,12)")).cast("double").alias("score"))
    text = tokens.groupBy("id").agg(F.sort_array(F.collect_set(F.concat_ws(":", "part", "word"))).alias("words"))
    known = seen.join(scored, "id", "left").join(text, "id", "left").select(
        F.col("url").alias("u"), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.coalesce("score", F.lit(0.0)) > 0, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("r").isNull(), F.coalesce("score", F.lit(0.0))).alias("score"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    return pages.select("page_id", "url").join(known, F.col("url").eqNullSafe(F.col("u"))).drop("u")
