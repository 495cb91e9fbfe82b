"""Exact top-k by inner product: a KD-tree per shard.

Rows are dealt to cells of space by the top levels of one KD split, fitted on at
most ``SAMPLE`` rows (the first by a hash; the split only decides where a row
lies, results don't depend on it).  A cell of more than ``shard_rows`` rows is cut
into shards by a hash, so equal or clustered vectors spread evenly.  Each shard
builds a KD-tree: median splits by rank on the widest dimension, tight bounding
boxes.  A query walks the tree best first: the box bound is the largest inner
product any point of the box could have, nodes are taken by falling bound, and
the walk ends when no bound reaches the k-th best score so far.

The k-th score is propagated: every query first searches its own shard, and
that k-th score is the starting bound everywhere else.  A cell whose tight box
can't reach it is left out before anything is shuffled; the others return only
rows that reach it.  Queries meet a cell's shards in blocks, so a group is one
shard and one block of queries, both of bounded size, and a row is copied once
for each block of queries that its cell has.

Components become floor(scale * x) as integers.  Scores are exact: floats are
used only while every sum fits 53 bits, else integers of any size; a score
beyond a long is reported as the nearest long, and ranks as that.  Ties go to
the smaller vec_id.

Rows with a NULL vec_id, NULL vector, or NULL or non-finite component take no
part.  Rows that repeat id and vector count once; several vectors of one id are
as many rows: each is a candidate, and each a query of its own (``query_vector``
tells them apart) whose candidates are the rows of other ids.  Only vectors of
the query's length are candidates.  Fewer than k candidates give fewer rows;
empty tables give none.  Only vec_id and embedding are read (and what ``is_query``
names), so further columns of any name can't clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import checkpoint, saved

SCALE = 1024
SHARD_ROWS = 8192
QUERY_BLOCK = 1024
SAMPLE = 16_384  # rows on which the cells are fitted
CELL_SAMPLE = 16  # sample rows of a cell, at least: so at most 1,024 cells
LEAF = 64
LONG = 2**63 - 1


def quantize(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component; floats that hold whole numbers
    while they are exact, else Python integers."""
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    big = float(np.abs(x).max(initial=0.0)) * scale
    if big * big * max(x.shape[1], 1) < 2**52:
        return np.floor(x * scale)
    # beyond 2**53 a float is a whole number
    return np.array([[int(c) * scale if abs(c) >= 2**53 else int(np.floor(c * scale)) for c in v] for v in x.tolist()],
                    dtype=object).reshape(x.shape)


class Tree:
    """Nodes in arrays: children, bounding boxes, smallest id, row range."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        self.order = np.arange(len(ids))
        self.child, self.span, boxes, low_id = [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            s, e, parent = todo.pop()
            rows = self.order[s:e]
            pts = self.points[rows]
            lo, hi = pts.min(0), pts.max(0)
            me = len(self.child)
            if parent >= 0:
                self.child[parent].append(me)
            self.child.append([])
            self.span.append((s, e))
            boxes.append((lo, hi))
            low_id.append(rows.min())
            if e - s > leaf and pts.shape[1] and (hi != lo).any():
                d = int(np.argmax(hi - lo))
                mid = (e - s) // 2
                by = np.argsort(pts[:, d], kind="stable")
                self.order[s:e] = rows[by]
                todo += [(s, s + mid, me), (s + mid, e, me)]
        self.lo = np.array([b[0] for b in boxes])
        self.hi = np.array([b[1] for b in boxes])
        self.low_id = np.array(low_id)  # index into ids, which are sorted

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of every query with any point of every box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.hi.T + down @ self.lo.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor=None):
        """The k best (score, index), best first; rows below ``floor`` are
        left out.  ``own`` is the query's own vec_id."""
        best: list = []  # min-heap of (score, -index)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            bound = -bound
            if len(best) == k and (bound < best[0][0] or (bound == best[0][0] and self.low_id[node] > -best[0][1])):
                if bound < best[0][0]:
                    break
                continue
            if floor is not None and bound < floor:
                break
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(heap, (-bounds[c], c))
                continue
            rows = self.order[slice(*self.span[node])]
            score = self.points[rows] @ query
            ok = self.ids[rows] != own
            least = best[0][0] if len(best) == k else floor
            if least is not None:
                ok &= (score >= least).astype(bool)
            for s, r in zip(score[ok].tolist(), rows[ok].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -r))
                elif (s, -r) > best[0]:
                    heapq.heapreplace(best, (s, -r))
        return [(s, -r) for s, r in sorted(best, reverse=True)]


def _search_frame(tree: Tree, vectors: np.ndarray, ids, hashes, floors, k: int) -> pd.DataFrame:
    rows = []
    bounds = tree.bounds(vectors)
    for q, own, v, b, f in zip(vectors, ids, hashes, bounds, floors):
        for score, i in tree.search(q, own, b, k, f):
            rows.append((own, v, int(tree.ids[i]), max(-LONG - 1, min(LONG, int(score)))))
    return pd.DataFrame(rows, columns=["query_id", "query_vector", "vec_id", "score"]).astype("int64")


NOTHING = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query_vector", "vec_id", "score")})
RESULT = "query_id long, query_vector long, vec_id long, score long"


def fit_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """The top levels of a KD split of ``sample`` into at most ``cells`` cells of
    ``CELL_SAMPLE`` rows or more: nodes (dimension, threshold, left, right); a
    negative child -1 - c is cell c.  Without a split there are no nodes."""
    nodes: list = []
    made = 0
    todo = [(np.arange(len(sample)), cells, -1, 0)]
    while todo:
        rows, want, parent, side = todo.pop(0)
        pts = sample[rows]
        split = want > 1 and len(rows) >= 2 * CELL_SAMPLE and pts.shape[1] > 0
        if split:
            d = int(np.argmax(pts.max(0) - pts.min(0)))
            at = float(np.median(pts[:, d]))
            left = pts[:, d] < at
            split = bool(left.any())
        if split:
            me = len(nodes)
            nodes.append([d, at, 0, 0])
            todo += [(rows[left], want // 2, me, 2), (rows[~left], want - want // 2, me, 3)]
        else:
            me, made = -1 - made, made + 1
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def cell_of(points: np.ndarray, nodes: list) -> np.ndarray:
    """The cell of every point."""
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1, np.int64)
    for me, (d, t, left, right) in enumerate(nodes):  # a node comes before its children
        here = np.flatnonzero(at == me)
        at[here] = np.where(points[here, d] < t, left, right)
    return -1 - at


def _assign_cells(rows: DataFrame, trees: dict[int, list]) -> DataFrame:
    """``rows`` with their cell.  A length that the sample lacks is one cell."""
    @F.pandas_udf("long")
    def cell(x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        dims = x.map(len).to_numpy()
        for dim in np.unique(dims):
            nodes = trees.get(int(dim))
            if nodes:
                here = np.flatnonzero(dims == dim)
                out[here] = cell_of(np.array(x.iloc[here].tolist(), np.float64), nodes)
        return pd.Series(out)

    return rows.withColumn("cell", cell("x"))


def _boxes(rows: DataFrame, dims: list[int]) -> DataFrame:
    """(dim, cell, lo, hi): the tight box of every cell of the given lengths; each
    task folds its rows to one box a cell, and a cell's boxes are folded again."""
    schema = "dim int, cell long, lo array<double>, hi array<double>"

    def fold(boxes: dict, dim, cell, lo, hi):
        old = boxes.get((dim, cell))
        boxes[dim, cell] = (lo, hi) if old is None else (np.minimum(old[0], lo), np.maximum(old[1], hi))

    def frame(boxes: dict) -> pd.DataFrame:
        return pd.DataFrame([(d, c, lo, hi) for (d, c), (lo, hi) in boxes.items()], columns=["dim", "cell", "lo", "hi"])

    def part(batches):
        boxes: dict = {}
        for b in batches:
            for (dim, cell), g in b.groupby(["dim", "cell"]):
                pts = np.array(g["x"].tolist(), np.float64).reshape(len(g), dim)
                fold(boxes, dim, cell, pts.min(0), pts.max(0))
        yield frame(boxes)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes: dict = {}
        for dim, cell, lo, hi in pdf[["dim", "cell", "lo", "hi"]].itertuples(index=False):
            fold(boxes, dim, cell, lo, hi)
        return frame(boxes)

    return (rows.where(F.col("dim").isin(dims)).select("dim", "cell", "x").mapInPandas(part, schema)
            .groupBy("dim", "cell").applyInPandas(whole, schema))


def reaches(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Whether a box could hold a point whose inner product with the query reaches
    its floor, with room for rounding.  Vectors are quantized, as floats."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = up @ hi.T + down @ lo.T
    room = up @ np.abs(hi).T - down @ np.abs(lo).T
    # not (bound < floor): a bound that overflowed to NaN keeps the cell
    return ~(bound + 1e-9 * room + 1 < floors[:, None] * np.where(floors > 0, 1 - 1e-9, 1 + 1e-9)[:, None])


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = SCALE, shard_rows: int = SHARD_ROWS,
          block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, query_vector for every row of ``vectors`` (vec_id,
    embedding) that the Column ``is_query`` selects, against all rows."""
    x = F.col("embedding")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(F.coalesce(good, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), (x if single else x.cast("array<double>")).alias("x"),
                    F.coalesce(is_query, F.lit(False)).alias("q"))
            .groupBy("vec_id", "x").agg(F.max("q").alias("q")))
    rows = saved(rows.withColumn("v", F.xxhash64("x")).withColumn("dim", F.size("x")), "topk-rows")
    shards = max(1, -(-rows.count() // shard_rows))
    trees: dict[int, list] = {}
    if shards > 1:  # a bounded sample
        drawn = rows.select("dim", "x").orderBy(F.xxhash64(F.lit(3), "vec_id", "v"), "vec_id", "v").limit(SAMPLE).collect()
        for dim in sorted({r.dim for r in drawn if r.dim}):
            sample = np.array([r.x for r in drawn if r.dim == dim], np.float64)
            trees[dim] = fit_cells(sample, shards)
    rows = saved(_assign_cells(rows, trees), "topk-cells") if shards > 1 else rows.withColumn("cell", F.lit(0).cast("long"))
    parts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("parts"))
    rows = rows.join(parts, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.flatnonzero(pdf["q"].to_numpy())
        if not len(q):
            return NOTHING
        pts = quantize(pdf["x"].tolist(), scale)
        ids, hashes = pdf["vec_id"].to_numpy(), pdf["v"].to_numpy()
        return _search_frame(Tree(pts, ids), pts[q], ids[q].tolist(), hashes[q].tolist(), [None] * len(q), k)

    first = checkpoint(rows.groupBy("dim", "cell", "shard").applyInPandas(home, RESULT))
    if shards > 1:
        floor = first.groupBy("query_id", "query_vector").agg(F.min("score").alias("low"), F.count("*").alias("n")).select(
            "query_id", "query_vector", F.when(F.col("n") >= k, F.col("low")).alias("floor"))
        queries = rows.where("q").select("vec_id", "v", "x", "dim", F.col("cell").alias("home_cell"), F.col("shard").alias("home")).join(
            floor, (F.col("vec_id") == F.col("query_id")) & (F.col("v") == F.col("query_vector")), "left")
        boxes = {}  # of at most SAMPLE / CELL_SAMPLE cells, and one more for each length in the sample
        for r in _boxes(rows, sorted(trees)).collect():
            boxes.setdefault(r.dim, []).append((r.cell, r.lo, r.hi))

        @F.pandas_udf("array<long>")
        def cells(x: pd.Series, dim: pd.Series, floor: pd.Series) -> pd.Series:
            out = [[0]] * len(x)
            for d in set(dim) & set(boxes):
                here = np.flatnonzero(dim.to_numpy() == d)
                at = np.array([c for c, _, _ in boxes[d]])
                lo, hi = (np.floor(np.array([b[i] for b in boxes[d]], np.float64) * scale) for i in (1, 2))
                qs = np.floor(np.array(x.iloc[here].tolist(), np.float64).reshape(len(here), d) * scale)
                low = floor.iloc[here].astype("float64").fillna(-np.inf).to_numpy()
                low[np.abs(low) >= 2.0**62] = -np.inf  # a score beyond a long bounds nothing
                with np.errstate(all="ignore"):
                    ok = reaches(qs, lo, hi, low)
                for i, o in zip(here, ok):
                    out[i] = at[o].tolist()
            return pd.Series(out)

        near = queries.withColumn("cell", F.explode(cells("x", "dim", "floor")))
        near = checkpoint(near.select("vec_id", "v", "dim", "cell", "home_cell", "home", "floor"))
        blocks = near.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        near = near.join(blocks, ["dim", "cell"]).join(parts, ["dim", "cell"]).withColumn(
            "block", F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.col("blocks")))
        near = near.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        near = near.where((F.col("cell") != F.col("home_cell")) | (F.col("shard") != F.col("home")))
        near = near.select("vec_id", "v", "dim", "cell", "shard", "block", F.col("floor").cast("string").alias("floor")).join(
            rows.where("q").select("vec_id", "v", "x"), ["vec_id", "v"])
        spread = rows.join(blocks, ["dim", "cell"]).select("vec_id", "x", "dim", "cell", "shard", F.explode(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

        def rest(points: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
            if not len(points) or not len(qs):
                return NOTHING
            both = quantize([*points["x"], *qs["x"]], scale)  # one number type for both sides
            tree = Tree(both[:len(points)], points["vec_id"].to_numpy())
            floors = [None if f is None or int(f) <= -LONG else int(f) for f in qs["floor"]]
            return _search_frame(tree, both[len(points):], qs["vec_id"].tolist(), qs["v"].tolist(), floors, k)

        group = ["dim", "cell", "shard", "block"]
        far = spread.groupBy(*group).cogroup(near.groupBy(*group)).applyInPandas(rest, RESULT)
        first = first.unionByName(far)
    order = Window.partitionBy("query_id", "query_vector").orderBy(F.col("score").desc(), "vec_id")
    return (first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "query_vector"))
