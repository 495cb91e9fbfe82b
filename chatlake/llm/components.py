"""Distributed union-find: connected components by alternating stars.

Large star and small star (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every node links its larger neighbours, then
its smaller ones, to its smallest neighbour, until nothing changes.  The
edge list never grows, each round is cut through the checkpoint folder, and
no node's neighbours are gathered in one task: minima are pre-aggregated and
the join back on a hot node can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import checkpoint

MAX_ROUNDS = 200


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): smallest b of every a.  Grouped by a struct, so that the join back
    shuffles both sides by itself and a hot node's rows can be split there."""
    return edges.groupBy(F.struct("a").alias("g")).agg(F.min("b").alias("m")).select(F.col("g.a").alias("u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return (both.where("b > a").join(low, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down)
    moved = down.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable
    type); ``root`` is the component's smallest node, for the root itself too.
    Self-loops and NULL ends are ignored; no edges give no rows."""
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    state = _state(edges)
    if state[0]:
        for _ in range(MAX_ROUNDS):
            edges = checkpoint(_small_star(_large_star(edges)))
            last, state = state, _state(edges)
            if state == last:
                break
        else:
            raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
