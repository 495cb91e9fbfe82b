"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import (decontaminate, kdtree, language, lexical, licenses, line_dedup, mixing, neighbours, periods, pii,
                          simhash, toxicity, urls)
from chatlake.llm.common import table

MIX_WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}  # every other source: 1
PII_KEY = "pipeline-demo-key"  # a deployment passes its own secret


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text's hash tells documents without id apart
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return mixing.mix(docs, MIX_WEIGHTS).drop("text_hash")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.template_grams(spark))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_clusters(table(spark, sf_dir, "documents"))
    return found.select(F.col("k_id").alias("doc_id"), F.col("line").alias("line_no"), F.concat_ws("-", F.hex("root.h1"), F.hex("root.h2")).alias("component"),
                        F.col("first.k_id").alias("kept_doc_id"), F.col("first.line").alias("kept_line_no"), "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language.prototypes(docs.where(~language.held_out()))
    found = language.predict(docs.select("doc_id", language.held_out().alias("held_out"), "text"), learned)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.label_grade())
    return toxicity.score(docs, model).select("doc_id", "severity", "toxic")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", "n_pii", "pii_kinds")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.clusters(table(spark, sf_dir, "documents"))
    return out.select(F.col("k_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _repeating(docs: DataFrame) -> DataFrame:
    """The documents of this query's contract: by a hash of the id, in every
    tenth the words from one on repeat with a period.  No id: unchanged."""
    w, n, at, size = F.col("w"), F.col("n"), F.col("at"), F.col("size")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    docs = docs.select("doc_id", "text", g.alias("g"), F.explode(F.array(F.when(h % 10 == 0, F.regexp_extract_all(
        "text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).alias("w"))     # cut into words once, below the generator
    docs = docs.withColumn("n", F.size("w")).withColumn("at", F.when(n > 0, F.col("g") % n).cast("int"))
    docs = docs.withColumn("size", (1 + F.floor((n - at) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice(w, at + 1, size), F.ceil((n - at) / size).cast("int")))
    text = F.array_join(F.concat(F.slice(w, F.lit(1), at), F.slice(again, F.lit(1), n - at)), " ")
    return docs.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_repeating(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", periods.densest_run(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_topk, op2_mix, op3_licenses, op4_lines, op5_language, op6_toxicity, op7_decontaminate, op8_urls, op9_pii,
             op10_simhash, op11_lexical, op12_neighbours, op13_periods]
    return {f.__name__: f for f in found}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

# The fold over the slots of a period is a recursion: each step takes, of the
# released blocks not yet taken, the one due first.
OP2_SQL = """
WITH RECURSIVE src AS (
  SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 2 WHEN 'src2' THEN 2 ELSE 1 END AS a
  FROM documents GROUP BY source),
tot AS (SELECT CAST(sum(a) AS BIGINT) AS p FROM src),
blk AS (SELECT source, a, p, i, (i * p) // a AS free, ((i + 1) * p + a - 1) // a AS due
        FROM (SELECT source, a, p, unnest(range(0, a)) AS i FROM src, tot)),
num AS (SELECT *, row_number() OVER (ORDER BY due, source, i) AS id FROM blk),
fold AS (
  SELECT CAST(-1 AS BIGINT) AS slot_no, CAST(0 AS BIGINT) AS id, CAST([] AS BIGINT[]) AS done
  UNION ALL
  SELECT slot_no + 1, pick, list_append(done, pick)
  FROM (SELECT slot_no, done, (SELECT min(num.id) FROM num WHERE free <= slot_no + 1 AND NOT list_contains(done, num.id)) AS pick
        FROM fold) WHERE pick IS NOT NULL),
slots AS (SELECT source, a, p, i, slot_no FROM fold JOIN num USING (id)),
docs AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS k FROM documents),
placed AS (SELECT doc_id, docs.source, k // 8 AS block, k % 8 AS pos, ((k // 8) // a) * p + slot_no AS slot
           FROM docs JOIN slots ON docs.source = slots.source AND (k // 8) % a = i),
ends AS (SELECT min(last) AS horizon FROM (SELECT source, max(slot) AS last FROM placed GROUP BY source))
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(pos AS BIGINT) AS pos, CAST(slot AS BIGINT) AS slot,
       slot <= horizon AS on_target
FROM placed, ends
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, array_to_string(w[p:p + 12], ' ') AS gram, least(len(w), 13) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
tok AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) JOIN (SELECT DISTINCT n FROM g) ON p + n - 1 <= len(w)),
hit AS (SELECT tok.doc_id, tok.p, tok.n, g.item FROM tok JOIN g USING (gram, n)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, r, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
asked AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, text, term),
held AS (
  SELECT r, doc_id, term, count(*) AS tf, 25 + (75 * n * docs) // terms AS m
  FROM (SELECT r, doc_id, n, unnest(w) AS term FROM docs), size
  WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term, docs, terms),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, size GROUP BY term, docs),
found AS (
  SELECT item_id, text, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term) GROUP BY item_id, text, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM found WHERE score > 0)
WHERE rank <= 10
"""

# Runs by gaps and islands: where eight words equal those q further, one row; a
# stretch of such rows, and seven words more, is where words equal those q further.
# crc32 by table: eight halvings for each of 256 bytes, then one look-up a digit.
OP13_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))) AS t),
d0 AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
  FROM documents, tab),
d1 AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM d1),
d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w
  FROM d2),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + 8], ' ') AS gram
  FROM (SELECT doc_id, n, w, unnest(range(0, n - 7)) AS i FROM d WHERE n >= 24)),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
  WHERE 3 * (y.i - x.i) <= x.n),
isles AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same)
  GROUP BY doc_id, q, isle),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM isles WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS nth FROM runs)
  WHERE nth = 1),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS collapsed
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM runs)) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, array_to_string(w, ' '))) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": OP1_SQL,
        "op2_mix": OP2_SQL,
        "op7_decontaminate": OP7_SQL,
        "op11_lexical": OP11_SQL,
        "op13_periods": OP13_SQL,
    }
