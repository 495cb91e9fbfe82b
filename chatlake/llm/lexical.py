"""Ranked lexical search of many items at once, by evaluation of common
subexpressions.

An item's score of a document is a sum over the item's terms, so items that
share terms share parts of that sum.

1. Items are cut into blocks of bounded size.  For each block a task mines the
   sets of terms that items share (``share``): terms of the same items become one
   node, then, round after round, the pairs of nodes that most items have in
   common.  A node is the sum of two others, so the nodes form a directed acyclic
   graph that the block's items share; an item is the sum of the few nodes left
   to it.  The plan of a pass (some blocks, at most ``PASS_BYTES`` of item texts)
   is small and goes to the tasks.
2. One pass over the whole texts gives each document's number of terms and the
   counts of the terms that items have, written as a table; document frequencies,
   the number of documents and their terms are counted from it.
3. A pass over that table takes some documents at a time.  A block's terms give the
   leaves, one row of numbers for these documents each; every inner node is
   added up once from its two; the items' scores are sums of node rows.  A
   task keeps each item's k best documents, by score and then smaller doc_id.
4. The tasks' best are ranked, first by item and salt, then by item.

A term is a maximal stretch of ASCII letters and digits and of non-ASCII
characters, A-Z lower-cased.  The score is that of ``weight`` and
``contribution``, in whole numbers, the same however the sum is cut.

Items are distinct rows of (item, text): repeated rows count once, different texts
of one item id are ranked separately under that id.  Every document row is ranked,
repeated rows too; a NULL doc_id comes last among equal scores.  NULL, empty and
term-less texts have no term: such documents count nowhere, such items have no
result.  Documents without any of an item's terms score 0 and are left out.
An empty table gives no row.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import saved

K = 10
BLOCK_ITEMS = 256           # items that share a graph
BLOCK_BYTES = 4 << 20       # bytes of item texts of a block
PASS_BYTES = 64 << 20       # bytes of item texts whose plans go to the tasks at once
CHUNK_NODES = 4096          # nodes compared pair by pair when sets are mined
CELLS = 1 << 21             # numbers in a table of nodes x documents
SALTS = 64
_OTHER = bytes(b for b in range(128) if chr(b) not in string.ascii_letters + string.digits)
TERMS = bytes.maketrans(_OTHER + string.ascii_uppercase.encode(), b" " * len(_OTHER) + string.ascii_lowercase.encode())


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(TERMS).split() if text else []


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_factor(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """25 + 75 * n * N div L, also where the product leaves 64 bits."""
    if 75 * documents * int(n.max(initial=0)) < 2**63:
        return 25 + 75 * n * documents // all_terms
    return np.array([25 + 75 * x * documents // all_terms for x in n.tolist()], np.int64)


def contribution(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


# ---- the graph of shared sums ------------------------------------------------


def share(sets: list[list[int]], leaves: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Inner nodes, as pairs of the nodes that they add up (numbered from
    ``leaves`` on), and the nodes whose sum is each of the sets of leaves."""
    inner: list[tuple[int, int]] = []
    if not leaves:
        return inner, [[] for _ in sets]
    has = np.zeros((len(sets), leaves), bool)
    for i, s in enumerate(sets):
        has[i, s] = True
    node = np.arange(leaves)                       # node of each column

    def add(a: int, b: int) -> int:
        inner.append((a, b))
        return leaves + len(inner) - 1

    # leaves of the same two or more items: one node
    columns, of = np.unique(has, axis=1, return_inverse=True)
    of, merged = of.reshape(-1), {}
    for c in np.flatnonzero((columns.sum(0) > 1) & (np.bincount(of, minlength=columns.shape[1]) > 1)):
        same = np.flatnonzero(of == c)
        top = int(node[same[0]])
        for x in same[1:]:
            top = add(top, int(x))
        merged[int(same[0])] = top
        has[:, same[1:]] = False
    for at, top in merged.items():
        node[at] = top
    parts: list[list[int]] = [[] for _ in sets]

    def settle(keep: np.ndarray) -> None:
        """Columns that no two items share any more are parts of their items."""
        nonlocal has, node
        settled = node[~keep].tolist()
        for i, c in zip(*np.nonzero(has[:, ~keep])):
            parts[i].append(settled[c])
        has, node = has[:, keep], node[keep]

    while has.shape[1]:
        settle(has.sum(0) > 1)
        order = np.lexsort(has[::-1])              # alike columns stand together
        has, node = has[:, order], node[order]
        pairs, width = [], has.shape[1]
        for s in range(0, width, CHUNK_NODES):
            x = has[:, s:s + CHUNK_NODES].astype(np.float32)
            both = x.T @ x
            np.fill_diagonal(both, 0)
            if both.size:
                best = both.argmax(1)
                pairs += [(-both[a, b], s + min(a, b), s + max(a, b)) for a, b in enumerate(best.tolist()) if both[a, b] > 1]
        taken, more, numbers = np.zeros(width, bool), [], []
        for _, a, b in sorted(set(pairs)):
            if not taken[a] and not taken[b]:
                taken[[a, b]] = True
                common = has[:, a] & has[:, b]
                has[:, a] &= ~common
                has[:, b] &= ~common
                more.append(common)
                numbers.append(add(int(node[a]), int(node[b])))
        if not more:
            break
        has, node = np.c_[has, np.array(more).T], np.r_[node, numbers]
    settle(np.zeros(has.shape[1], bool))
    return inner, parts


def _plan_table(block: int, ids: pa.Array, texts: list) -> dict:
    counts = [Counter(terms(t)) for t in texts]
    leaf = {x: i for i, x in enumerate(sorted({p for c in counts for p in c.items()}))}   # (term, times)
    inner, parts = share([[leaf[p] for p in c.items()] for c in counts], len(leaf))
    return {"block": [block], "items": [ids.to_pylist()], "terms": [[t.decode() for t, _ in leaf]], "times": [[n for _, n in leaf]],
            "left": [[a for a, _ in inner]], "right": [[b for _, b in inner]], "parts": [parts]}


def plans(items: DataFrame, item: str, text: str, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per block of items: its items, leaves, inner nodes and the items' parts,
    and the bytes of its texts."""
    rows = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-int(size["bytes"]) // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(blocks)).cast("int"))
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("items", T.ArrayType(rows.schema["item"].dataType)),
                           T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("times", whole),
                           T.StructField("left", whole), T.StructField("right", whole), T.StructField("parts", T.ArrayType(whole)),
                           T.StructField("bytes", T.LongType())])

    def mine(key, table):
        texts = table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: texts[i])     # the same numbers when computed again
        ids = table.column("item").combine_chunks().take(pa.array(order))
        out = _plan_table(key[0].as_py(), ids, [texts[i] for i in order]) | {"bytes": [sum(map(len, texts))]}
        inner_type = pa.list_(pa.int32())
        types = [pa.int32(), pa.list_(ids.type), pa.list_(pa.string()), inner_type, inner_type, inner_type, pa.list_(inner_type), pa.int64()]
        return pa.table({n: pa.array(out[n], t) for n, t in zip(schema.names, types)})

    return rows.groupBy("block").applyInArrow(mine, schema)


class Block:
    """A block's plan as arrays for evaluation; ``vocabulary``: number of each term."""

    def __init__(self, row, vocabulary: dict[bytes, int], weights: np.ndarray):
        self.block = row["block"]
        names = sorted(set(row["terms"]))
        place = {t: i for i, t in enumerate(names)}
        self.row_of = np.full(len(vocabulary), -1)               # row of each term of the vocabulary
        self.row_of[[vocabulary[t.encode()] for t in names]] = np.arange(len(names))
        self.weights, self.rows = weights, len(names)
        self.leaf = np.array([place[t] for t in row["terms"]], np.int64)
        self.times = np.array(row["times"], np.int64)
        depth = [0] * len(self.leaf)
        for a, b in zip(row["left"], row["right"]):
            depth.append(1 + max(depth[a], depth[b]))
        inner = np.array(depth[len(self.leaf):], np.int64)
        left, right = np.array(row["left"], np.int64), np.array(row["right"], np.int64)
        self.steps = [(len(self.leaf) + np.flatnonzero(inner == d), left[inner == d], right[inner == d])
                      for d in range(1, int(inner.max(initial=0)) + 1)]
        self.nodes = len(depth)
        self.item = np.array([i for i, p in enumerate(row["parts"]) if p], np.int64)
        some = [p for p in row["parts"] if p]
        self.parts = np.array([x for p in some for x in p], np.int64)
        self.starts = np.cumsum([0, *map(len, some)])[:-1].astype(np.int64)

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Items x documents; ``value`` without the term's weight."""
        base = np.zeros((self.rows, docs), np.int64)
        row = self.row_of[term]
        mine = row >= 0
        base[row[mine], doc[mine]] = value[mine] * self.weights[term[mine]]
        acc = np.empty((self.nodes, docs), np.int64)
        acc[:len(self.leaf)] = base[self.leaf] * self.times[:, None]
        for to, a, b in self.steps:
            acc[to] = acc[a] + acc[b]
        return np.add.reduceat(acc[self.parts], self.starts, axis=0)


class Best:
    """The k best documents of every item of a block seen so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)     # only scores above 0
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]
        self.new, self.size = [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        i, d = np.nonzero(scores >= self.floor[:, None])
        if len(i):
            self.new.append((i, scores[i, d], missing[d], ids[d]))
            self.size += len(i)
            if self.size > 8 * self.k * len(self.floor):
                self.cut()

    def cut(self) -> None:
        item, score, missing, ids = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((ids, missing, -score, item))
        group = item[order]
        keep = order[np.arange(len(order)) - np.searchsorted(group, group) < self.k]
        self.kept, self.new, self.size = [x[keep] for x in (item, score, missing, ids)], [], 0
        full = np.flatnonzero(np.bincount(self.kept[0], minlength=len(self.floor)) >= self.k)
        self.floor[full] = self.kept[1][np.searchsorted(self.kept[0], full, side="right") - 1]   # the k-th score


# ---- documents ----------------------------------------------------------------


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the counts of the vocabulary's terms of every document with
    a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        number = known.value.get
        for b in batches:
            ids = b.column(0)
            n, at, count, sizes = [], [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = terms(text)
                tf = Counter(map(number, words))
                tf.pop(None, None)
                n.append(len(words))
                sizes.append(len(tf))
                at += tf.keys()
                count += tf.values()
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(count, pa.int64()))], names=["doc_id", "n", "term", "tf"])
            yield out.filter(pa.array(np.array(n, np.int64) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n long, term array<int>, tf array<long>")


def _best(postings: DataFrame, rows: list, vocabulary: dict, weights: np.ndarray, documents: int, all_terms: int, k: int) -> DataFrame:
    """block, at (item of the block), doc_id, score: the k best of every task."""
    plan = postings.sparkSession.sparkContext.broadcast((rows, vocabulary, weights))

    def work(batches):
        blocks = [b for b in (Block(r, plan.value[1], plan.value[2]) for r in plan.value[0]) if len(b.item)]
        best = [Best(len(b.item), k) for b in blocks]
        for batch in batches:
            ids = batch.column(0)
            missing = np.asarray(ids.is_null()).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            m = length_factor(batch.column(1).to_numpy(), documents, all_terms)
            lists, tfs = batch.column(2), batch.column(3)
            sizes = lists.value_lengths().to_numpy()
            term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), sizes)
            value = contribution(np.int64(1), tf, m[doc])
            for b, top in zip(blocks, best):
                step = max(16, CELLS // max(b.nodes, 1))
                for s in range(0, len(ids), step):
                    e = min(s + step, len(ids))
                    x, y = np.searchsorted(doc, [s, e])
                    top.add(b.scores(doc[x:y] - s, term[x:y], value[x:y], e - s), ids[s:e], missing[s:e])
        for b, top in zip(blocks, best):
            top.cut()
            item, score, missing, ids = top.kept
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(item), b.block), pa.int32()), pa.array(b.item[item], pa.int32()),
                 pa.array(ids, mask=missing.astype(bool)), pa.array(score)], names=["block", "at", "doc_id", "score"])

    return postings.mapInArrow(work, "block int, at int, doc_id long, score long")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(blocks: list) -> list[list[int]]:
    """Blocks (number, bytes) in groups of at most PASS_BYTES, one block at least."""
    out, size = [], 0
    for b, n in blocks:
        if not out or size + n > PASS_BYTES:
            out.append([])
            size = 0
        out[-1].append(b)
        size += n
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, item: str = "item_id", text: str = "text",
           block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item (under its own name), rank, doc_id, score: the k best documents
    (doc_id, text; doc_id a whole number) of every item with a term."""
    spark = docs.sparkSession
    planned = saved(plans(items, item, text, block_items), "lexical-plans")
    sizes = [(r["block"], r["bytes"]) for r in planned.select("block", "bytes").orderBy("block").collect()]  # a row a block
    found = spark.createDataFrame([], "block int, at int, doc_id long, score long")
    for group in _passes(sizes):
        rows = planned.where(F.col("block").isin(group)).collect()       # at most PASS_BYTES of texts
        vocabulary = {t: i for i, t in enumerate(sorted({t.encode() for r in rows for t in r["terms"]}))}
        postings = saved(_postings(docs, vocabulary), "lexical-postings")
        total = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if not total["documents"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("term").alias("t")).groupBy("t").count().collect():   # a row a term of the pass
            df[r["t"]] = r["count"]
        weights = np.array([weight(total["documents"], int(f)) for f in df], np.int64)
        found = found.unionAll(_best(postings, rows, vocabulary, weights, total["documents"], int(total["terms"]), k))
    salted = _ranked(found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))), ["block", "at", "salt"], k)
    names = planned.select("block", F.posexplode("items").alias("at", "item"))
    return _ranked(salted.drop("rank", "salt"), ["block", "at"], k).join(names, ["block", "at"]).select(
        F.col("item").alias(item), "rank", "doc_id", "score")

