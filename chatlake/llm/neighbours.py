"""Approximate nearest neighbours by cosine: an NN-descent graph, greedily searched.

``build`` makes the graph:

1. Rows of equal vectors are one node, so a vector that a third of all rows have is
   no hot group; a node keeps the ids of its rows as members.
2. First lists: random hyperplanes cut the nodes into cells, ``TREES`` times over; a
   cell beyond ``2 * LEAF`` nodes is cut further by a hash.  Every node takes its
   best neighbours within its cells.
3. NN-descent, in rounds of Spark joins: a node's list and a sample of the nodes
   that list it (``BACK`` of them, drawn anew every round) meet at that node; of
   every pair of which one is new there, each side that would improve by the
   other gets it as a candidate; candidates and lists are merged into the ``LIST``
   best.  A neighbour's neighbour is thus tried as a neighbour.  It ends when a round
   changes fewer than ``STILL`` of all entries, or after ``ROUNDS``.

``search`` walks the graph for all queries at once, one Spark round a step: every
query has a pool of its ``POOL`` best nodes; the ``EXPAND`` best that are not yet
expanded give their neighbours (both directions, those listing a node sampled as
above), which are scored and merged into the pool.  A query starts from its own
node, which the graph holds, or, if it is no node, from members of its cells.  It
ends when no pool has an unexpanded node among its ``EXPAND`` best, or after ``STEPS``.

Vectors travel as 16-bit whole numbers; only the pool's order depends on them.  The ``RESCORED`` best nodes of a pool are scored again from the original
vectors in double precision, and ranked by that, ties by smaller vec_id.  Every
row is indexed and can be found.  Samples of a node's listers bound a group; a
lister that is not drawn still has the node in its own list.

Rows with a NULL vec_id or a vector that is NULL, zero, empty or holds a NULL or
non-finite component take no part.  Vectors of different length are never compared.
Rows equal in id and vector are one; rows that share an id alone are rows of
their own, as queries too.  Fewer candidates than k: all that are found.
Empty tables give no row.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import saved

LIST = 48          # neighbours of a node
BACK = 32          # listers of a node that meet at it in a round
TREES, LEAF = 8, 512
CELL_BEST = 14     # neighbours that a node takes from one cell
NODE_BEST = 8      # candidates that a node takes from one meeting
ROUNDS, STILL = 8, 0.05
POOL, EXPAND, STEPS, RESCORED = 96, 24, 3, 48
SEED = 20240917


# ---- vectors -------------------------------------------------------------------


def _usable(x: Column) -> Column:
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _codes(vectors: list) -> list[bytes]:
    """Vectors as 16-bit whole numbers, 32767 being the largest component."""
    out = []
    for v in vectors:
        x = np.asarray(v, np.float64)
        out.append(np.rint(32767 * (x / np.abs(x).max())).astype(np.int16).tobytes())
    return out


def _unit(column: pa.Array) -> np.ndarray:
    """Unit vectors of a binary column of ``_codes``, all of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), -1).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nodes(vectors: DataFrame, trees: int = TREES, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(node, x, dim, code, cells), a row per distinct vector, and (member_node,
    vec_id, nth), a row per distinct (vec_id, vector); nth counts a node's ids."""
    x = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))     # -0.0 is 0.0
    rows = (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(_usable(F.col("x"))).distinct())
    rows = saved(rows.withColumn("node", F.xxhash64(F.size("x"), "x")), "ann-rows")
    distinct = rows.groupBy("node").agg(F.min("x").alias("x"), F.count("*").alias("n"))
    bits = max(0, int(np.ceil(np.log2(max(1, rows.select("node").distinct().count()) / leaf))))

    def encode(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            codes = _codes(b.column(1).to_pylist())
            dims = np.array([len(c) // 2 for c in codes], np.int32)
            cells = np.zeros((len(codes), trees), np.int64)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, trees * bits)).astype(np.float32)
                at = np.flatnonzero(dims == d)
                sign = (_unit(pa.array([codes[i] for i in at])) @ planes[d] > 0).reshape(len(at), trees, bits)
                cells[at] = sign @ (1 << np.arange(bits, dtype=np.int64)) if bits else 0
            flat = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, trees).astype(np.int32), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(codes, pa.binary()), flat],
                                             names=["node", "x", "n", "dim", "code", "cells"])

    found = saved(distinct.mapInArrow(encode, "node long, x array<double>, n long, dim int, code binary, cells array<long>"), "ann-nodes")
    return found, rows.select(F.col("node").alias("member_node"), "vec_id")


# ---- groups of vectors that meet --------------------------------------------------


def _meet(rows: DataFrame, keys: list[str], best: int) -> DataFrame:
    """u, w, sim: in every group of ``keys``, the ``best`` w of every u by similarity
    above u's ``low``, of pairs in which one at least is ``fresh``.  Groups are of
    bounded size; they stream, sorted, through a task."""

    def pairs(node, code, low, fresh, out):
        v = _unit(code)
        sim = v @ v.T
        np.fill_diagonal(sim, -2)
        if not fresh.all():
            old = ~fresh
            sim[np.ix_(old, old)] = -2
        k = min(best, len(node) - 1)
        if k < 1:
            return
        at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sim, at, 1)
        i, j = np.nonzero((s > low[:, None]) & (s > -2))
        out.append((node[i], node[at[i, j]], s[i, j]))

    def work(batches):
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks()
            key = [t.column(k).to_numpy() for k in keys]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1 if t.num_rows else np.zeros(0, int)
            last = int(cut[-1]) if len(cut) else 0
            yield from groups(t.slice(0, last), cut[:-1] if len(cut) else cut)
            kept = t.slice(last).to_batches()
            kept = kept[0] if kept else None
        if kept is not None:
            yield from groups(pa.Table.from_batches([kept]), np.zeros(0, int))

    def groups(t, cuts):
        if not t.num_rows:
            return
        t, out = t.combine_chunks(), []
        node, low, fresh = (t.column(c).to_numpy() for c in ("node", "low", "fresh"))
        code = t.column("code").combine_chunks()
        code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), t.num_rows]):
            pairs(node[s:e], code.slice(s, e - s), low[s:e], fresh[s:e], out)
        if out:
            u, w, sim = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(sim.astype(np.float32))], names=["u", "w", "sim"])

    return (rows.select(*keys, "node", "code", "low", "fresh").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(work, "u long, w long, sim float"))


def _closest(edges: DataFrame, k: int) -> DataFrame:
    """The k best w of every u; an edge given twice is no longer fresh if one is not."""
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "w")
    return (edges.repartition("u").groupBy("u", "w").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
            .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("u", "w", "sim", "fresh", "nth"))


def _sampled(edges: DataFrame, k: int, salt: int) -> DataFrame:
    """Listers (w as u, u as w) of every node, at most k of them drawn by a hash."""
    order = Window.partitionBy("u").orderBy(F.xxhash64(F.lit(salt), "w"), "w")
    return (edges.select(F.col("w").alias("u"), F.col("u").alias("w"), "fresh")
            .withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at"))


def _first_lists(found: DataFrame, k: int, leaf: int) -> DataFrame:
    placed = found.select("node", "code", "dim", F.posexplode("cells").alias("tree", "cell"))
    sizes = (placed.groupBy("dim", "tree", "cell").agg(F.count("*").alias("size")).where(F.col("size") > 2 * leaf)
             .select(F.col("dim").alias("d"), F.col("tree").alias("t"), F.col("cell").alias("c"), F.ceil(F.col("size") / leaf).cast("int").alias("chunks")))
    cond = (F.col("dim") == F.col("d")) & (F.col("tree") == F.col("t")) & (F.col("cell") == F.col("c"))
    chunk = F.coalesce(F.pmod(F.xxhash64("tree", "node"), F.col("chunks")), F.lit(0)).cast("int")
    rows = placed.join(sizes, cond, "left").select("dim", "tree", "cell", chunk.alias("chunk"), "node", "code",
                                                   F.lit(-2.0).cast("float").alias("low"), F.lit(True).alias("fresh"))
    return _closest(_meet(rows, ["dim", "tree", "cell", "chunk"], CELL_BEST).withColumn("fresh", F.lit(True)), k)


def build(found: DataFrame, k: int = LIST, back: int = BACK, leaf: int = LEAF, rounds: int = ROUNDS) -> DataFrame:
    """(u, w, sim, fresh, nth): the neighbour graph of ``nodes``."""
    graph = saved(_first_lists(found, k, leaf), "ann-graph")
    entries = max(1, found.count() * k)
    for r in range(rounds):
        ends = F.max(F.struct("nth", "sim"))
        low = graph.groupBy("u").agg(ends.alias("last")).select(
            F.col("u").alias("of"), F.when(F.col("last.nth") == k, F.col("last.sim")).otherwise(-2.0).cast("float").alias("low"))
        near = graph.select("u", "w", "fresh").unionAll(_sampled(graph, back, r))
        near = near.groupBy("u", "w").agg(F.max("fresh").alias("fresh"))
        state = found.select("node", "code").join(low, F.col("node") == F.col("of"), "left").select(
            "node", "code", F.coalesce("low", F.lit(-2.0)).cast("float").alias("low"))
        rows = near.join(state, F.col("w") == F.col("node")).select("u", "node", "code", "low", "fresh")
        more = _meet(rows, ["u"], NODE_BEST).withColumn("fresh", F.lit(True))
        # what has met once does not meet again
        graph = saved(_closest(graph.select("u", "w", "sim", F.lit(False).alias("fresh")).unionByName(more), k), "ann-graph")
        if graph.where("fresh").count() < STILL * entries:
            break
    return graph


# ---- search ------------------------------------------------------------------------


def _scored(pairs: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, w, sim) of pairs (q, w) of one length, from the 16-bit vectors."""
    def work(batches):
        for b in batches:
            if b.num_rows:
                dims = np.array([len(x) for x in b.column(2).to_pylist()])
                sim = np.empty(b.num_rows, np.float32)
                for d in np.unique(dims).tolist():
                    at = pa.array(np.flatnonzero(dims == d))
                    sim[dims == d] = np.einsum("ij,ij->i", _unit(b.column(2).take(at)), _unit(b.column(3).take(at)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], names=["q", "w", "sim"])

    both = pairs.join(found.select(F.col("node").alias("w"), "code"), "w").join(
        queries.select("q", F.col("code").alias("asked")), "q").where(F.octet_length("code") == F.octet_length("asked"))
    return both.select("q", "w", "code", "asked").mapInArrow(work, "q long, w long, sim float")


def _pool(rows: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("sim").desc(), "w")
    return (rows.repartition("q").groupBy("q", "w").agg(F.max("sim").alias("sim"), F.max("expanded").alias("expanded"))
            .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size))


def walk(found: DataFrame, graph: DataFrame, queries: DataFrame, pool: int = POOL, expand: int = EXPAND,
         steps: int = STEPS, back: int = BACK) -> DataFrame:
    """(q, w, sim): every query's pool.  ``queries``: (q, code, cells), q being the
    query's node."""
    around = saved(graph.select("u", "w").unionAll(_sampled(graph, back, -1).select("u", "w")).distinct(), "ann-around")
    known = queries.join(found.select("node"), F.col("q") == F.col("node"), "left_semi").select("q", F.col("q").alias("w"))
    # no node of the index: some nodes of its cells
    cell = F.xxhash64("tree", "cell", "dim")
    placed = lambda df, name: df.select(F.col(name), F.octet_length("code").alias("dim"), F.posexplode("cells").alias("tree", "cell"))
    entry = Window.partitionBy("tree", "cell", "dim").orderBy(F.xxhash64("node"), "node")
    doors = placed(found, "node").withColumn("at", F.row_number().over(entry)).where(F.col("at") <= expand).select("node", cell.alias("door"))
    strange = placed(queries.join(known.select("q"), "q", "left_anti"), "q").select("q", cell.alias("door")).join(doors, "door")
    start = known.unionAll(strange.select("q", F.col("node").alias("w"))).distinct()
    state = saved(_pool(_scored(start, found, queries).withColumn("expanded", F.lit(False)), pool), "ann-pool")
    for _ in range(steps):
        open_ = state.where(~F.col("expanded") & (F.col("nth") <= expand))
        if open_.isEmpty():
            break
        reached = open_.select("q", F.col("w").alias("u")).join(around, "u").select("q", "w").distinct()
        reached = reached.join(state.select("q", "w"), ["q", "w"], "left_anti")
        done = state.select("q", "w", "sim", (F.col("expanded") | (F.col("nth") <= expand)).alias("expanded"))
        more = _scored(reached, found, queries).withColumn("expanded", F.lit(False))
        state = saved(_pool(done.unionByName(more), pool), "ann-pool")
    return state.select("q", "w", "sim", "nth")


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays of double, summed in their order; huge and tiny vectors
    are scaled first."""
    def product(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    def tame(x):
        n, top = product(x, x), F.array_max(F.transform(x, F.abs))
        return F.when(n.between(1e-200, 1e200), x).otherwise(F.transform(x, lambda v: v / top))

    x, y = tame(F.col(a)), tame(F.col(b))
    return product(x, y) / (F.sqrt(product(x, x)) * F.sqrt(product(y, y)))


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row of ``vectors``
    (vec_id, embedding) that the Column ``is_query`` selects by vec_id."""
    found, members = nodes(vectors)
    graph = build(found)
    asked = members.where(is_query).select(F.col("member_node").alias("q"), F.col("vec_id").alias("query_id"))
    queries = found.join(asked.select(F.col("q").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("q"), "code", "cells")
    pool = walk(found, graph, queries, pool=max(POOL, 4 * k)).where(F.col("nth") <= max(RESCORED, 4 * k))
    # the k + 1 smallest ids of a node are all that a result can show of it
    order = Window.partitionBy("member_node").orderBy("vec_id")
    shown = members.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at")
    exact = (pool.select("q", "w").join(found.select(F.col("node").alias("w"), F.col("x").alias("there")), "w")
             .join(found.select(F.col("node").alias("q"), F.col("x").alias("here")), "q")
             .select("q", "w", cosine("here", "there").alias("score")))
    ranked = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    # ranks within a node's candidates first: k + 1 of them serve every query row of the node
    best = (exact.join(shown, F.col("w") == F.col("member_node")).withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= k + 1).select("q", "vec_id", "score"))
    final = Window.partitionBy("q", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return (asked.join(best, "q").where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
