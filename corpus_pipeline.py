"""A corpus pipeline of five stages.

Each stage works on all that its predecessor kept; its result is written as
Parquet to the shared folder and read again as the next stage's documents.

1. toxicity    documents of an expected severity of 0.4 or more go
2. lines       of every group of near-equal lines the first one stays
3. simhash     of every group of near-equal documents one stays
4. benchmark   documents contaminated by benchmark passages go
5. mix         every document gets its place in the mix of the sources
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from chatlake.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from chatlake.llm.common import table
from chatlake.llm.queries import MIX_WEIGHTS
from chatlake.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX_WEIGHTS).orderBy("slot", "pos")


STAGES = [
    ("toxicity", drop_toxic),
    ("lines", drop_lines),
    ("simhash", drop_copies),
    ("benchmark", drop_contaminated),
    ("mix", mix_sources),
]

# Toxicity, MinHash and SimHash can't be expressed in SQL; the tests hold the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = os.path.join(checkpoint_dir(spark), f"pipeline-{os.urandom(6).hex()}")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
