"""Ranked lexical search and approximate neighbours: SQL, brute force, edges."""

import math

import numpy as np
import pytest
from brute import lexical as brute_lexical
from brute import nearest
from cases import LONG, ROWS, SF001, edge, empty  # noqa: F401
from oracle_util import duck
from pyspark.sql import functions as F

from chatlake.llm import lexical, neighbours

ITEMS = [(1, "all rights RESERVED all"), (2, "w3x w5x plain line"), (3, None), (4, "!!! ..."), (None, "général 5678"), (1, "cc by 4.0"), (2, "w3x w5x plain line")]


def tuples(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- op11 -------------------------------------------------------------------------


def test_lexical_edges(spark, edge, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("own")).withColumn("block", F.lit(1))
    want = sorted(brute_lexical([(d, t) for d, t, *_ in ROWS], ITEMS), key=repr)
    for block in (256, 1):
        got = lexical.search(edge, items, block_items=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and tuples(got.collect()) == want
    assert lexical.search(empty, items).count() == 0 and lexical.search(edge, items.limit(0)).count() == 0


def test_lexical_in_several_passes(spark, monkeypatch):
    docs = duck(SF001).execute("SELECT doc_id, text FROM documents").fetchall()
    items = duck(SF001).execute("SELECT item_id, text FROM benchmark").fetchall()
    monkeypatch.setattr(lexical, "PASS_BYTES", 1500)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"),
                         k=3, block_items=4)
    assert len(lexical._passes([(i, 600) for i in range(7)])) == 4
    assert tuples(got.collect()) == sorted(brute_lexical(docs, [(str(i), t) for i, t in items], 3), key=repr)


def test_equal_scores_go_to_smaller_ids(spark):
    docs = spark.createDataFrame([(i, "apple pear" if i < 900 else "apple plum") for i in range(3000, 0, -1)] + [(0, "nothing"), (5000, "pear")], "doc_id long, text string")
    got = lexical.search(docs.repartition(7), spark.createDataFrame([("a", "pear")], "item_id string, text string"), k=5).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [5000, 1, 2, 3, 4]


def expand(node, leaves, inner):
    return [node] if node < leaves else [x for p in inner[node - leaves] for x in expand(p, leaves, inner)]


def test_shared_sums_add_up():
    rng = np.random.default_rng(3)
    for trial in range(40):
        leaves = int(rng.integers(1, 60))
        common = rng.choice(leaves, leaves // 2, replace=False)
        sets = [sorted({*rng.choice(leaves, rng.integers(0, 8)).tolist(), *(common.tolist() if rng.random() < 0.6 else [])})
                for _ in range(rng.integers(1, 30))]
        inner, parts = lexical.share(sets, leaves)
        assert [sorted(x for n in p for x in expand(n, leaves, inner)) for p in parts] == sets
        alone = sum(max(len(s) - 1, 0) for s in sets)
        assert len(inner) + sum(max(len(p) - 1, 0) for p in parts) <= alone
        if sum(len(s) > leaves // 2 for s in sets) > 2 and leaves > 20:
            assert len(inner) + sum(max(len(p) - 1, 0) for p in parts) < 0.8 * alone


def test_length_factor_beyond_64_bits():
    n = np.array([1, 10**6], np.int64)
    assert lexical.length_factor(n, 10**13, 10**19 // 2).tolist() == [25 + 75 * 10**13 // (10**19 // 2), 25 + 75 * 10**19 // (10**19 // 2)]


# ---- op12 -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def embeddings():
    rows = duck("/root/testdata/sf0.1").execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    return [v for v, _ in rows], np.array([x for _, x in rows], np.float64)


def test_recall_on_sf01(spark, embeddings):
    import __spark_entry__ as E
    ids, x = embeddings
    got = E.queries()["op12_neighbours"](spark, "/root/testdata/sf0.1").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    place, found, total = {v: i for i, v in enumerate(ids)}, 0, 0
    for q in [v for v in ids if v % 50 == 0]:
        s = unit @ unit[place[q]]
        s[place[q]] = -2
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in mine]
        assert all(abs(r.score - s[place[r.vec_id]]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        found += len({ids[i] for i in np.argsort(-s)[:5]} & {r.vec_id for r in mine})
        total += 5
    assert found >= 0.95 * total


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, -3.0]), (3, [1.0, 1.0]), (50, [-1.0, 0.5]), (100, [1e-300, 1e-300]), (7, [1e300, -1e300])]
    odd = [(None, [1.0, 1.0]), (8, None), (9, [0.0, -0.0]), (10, [1.0, None]), (11, [nan, 1.0]), (12, [inf, 1.0]), (13, []), (14, [1.0, 2.0, 3.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("node", "code", "q", "rank", "dim")})
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    tame = [(v, [c / max(map(abs, x)) for c in x]) for v, x in good]
    want = nearest(tame, [r for r in tame if r[0] % 50 == 0])
    for q, rows in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [v for v, _ in rows] and all(math.isclose(r.score, s, abs_tol=1e-12) for r, (_, s) in zip(mine, rows))
    assert len(got) == sum(map(len, want.values()))
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.search(alone, F.col("vec_id") % 50 == 0).count() == 0


def test_equal_and_tight_vectors(spark):
    """A third of the rows have one vector, a third lie close to another one."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16))
    x[:500] = x[0]
    x[500:1000] = x[500] + 0.02 * rng.standard_normal((500, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        mine = [v for _, v in sorted(got[q])]
        if q < 500:
            assert mine == [i for i in range(6) if i != q][:5]
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(mine) & set(np.lexsort((np.arange(1500), -np.round(s, 12)))[:5].tolist()))
    assert hits >= 0.97 * 150


def test_a_query_that_is_no_node(spark, embeddings):
    ids, x = embeddings
    rows = [(i, v) for i, v in zip(ids, x.tolist())]
    found, _ = neighbours.nodes(spark.createDataFrame(rows[200:], "vec_id long, embedding array<double>"))
    strange, _ = neighbours.nodes(spark.createDataFrame(rows[:200], "vec_id long, embedding array<double>"))
    bits = neighbours.nodes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0]
    asked = bits.join(strange.select("node"), "node", "left_semi").select(F.col("node").alias("q"), "code", "cells")
    graph = neighbours.build(found)
    assert graph.groupBy("u").count().where("count < 48").count() == 0
    pool = neighbours.walk(found, graph, asked).where("nth <= 5")
    names = {r.node: r.x for r in bits.collect()}
    unit = x[200:] / np.linalg.norm(x[200:], axis=1, keepdims=True)
    hit, by = 0, {}
    for r in pool.collect():
        by.setdefault(r.q, []).append(r.w)
    for q, ws in by.items():
        best = set(np.argsort(-(unit @ np.array(names[q])))[:5].tolist())
        hit += len(best & {i for w in ws for i in np.flatnonzero((x[200:] == np.array(names[w])).all(1)).tolist()})
    assert len(by) == 200 and hit >= 0.9 * 1000
