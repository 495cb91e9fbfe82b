"""SimHash near-dedup with bit-sliced comparison.

Fingerprint: the text is lower-cased for A-Z and split on ASCII white space;
bit i of the fingerprint is set if it is set in over half of the XXH64 hashes
(seed 42) of the ``shingle``-word shingles.  Fewer words form one shingle;
no word gives fingerprint zero (NULL text has no word).

Links: distinct fingerprints at ``radius`` or fewer differing bits.  The 64
bits are cut into B parts; two such fingerprints agree on at least
``B - radius`` of them, so every choice of B - radius parts is a table and
rows meet in the table's bucket.  B and the number of key bits follow from
the number of distinct fingerprints, so that a bucket holds about
``BUCKET`` of them at any size; the links found are the same for any choice.
A bucket beyond ``CHUNK`` is cut into chunks and each pair of chunks is a
group of its own, so no group grows with a hot bucket.

In a group the fingerprints of one side are stored as 64 vertical bit planes
(64 fingerprints a machine word).  For a block of queries, planes are
compared one after the other, carry-save counters of two bits and an overflow
flag are updated by bitwise operations for 64 distances at once, and queries
whose lanes have all passed the radius are abandoned.  A group returns only a
spanning forest of its links, never all pairs; the components are joined by
the distributed union-find.

Repeated rows and equal fingerprints are grouped first.  A NULL doc_id never
names a component that has another id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import checkpoint, key_join
from chatlake.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET = 1024   # distinct fingerprints a bucket should hold
CHUNK = 2048    # fingerprints a group compares on one side at most
PART = 1 << 15  # shingles counted at once
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text as an unsigned integer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    flat = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[:len(w) - shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), PART):
        raw = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[i:i + PART], stops[i:i + PART])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(k_id, k_text, k_len, fp), one row per document; fp is signed."""
    schema = T.StructType([T.StructField("k_id", docs.schema["doc_id"].dataType),
                           T.StructField("k_text", T.LongType()), T.StructField("k_len", T.IntegerType()),
                           T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("k_id"), b.column("k_text"), b.column("k_len"), pa.array(fp.view(np.int64))], names=schema.names)

    src = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text"),
                      F.length("text").alias("k_len"), "text")
    return src.mapInArrow(run, schema)


def tables(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[list[list[tuple[int, int]]], int]:
    """Bit ranges (shift, width) of every table, and key bits used of each,
    for ``n`` distinct fingerprints."""
    want = max(0, (max(n, 1) // bucket).bit_length())
    for parts in range(radius + 1, 2 * radius + 3):
        cuts = [round(i * 64 / parts) for i in range(parts + 1)]
        ranges = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        chosen = [list(c) for c in combinations(ranges, parts - radius)]
        bits = min(sum(w for _, w in c) for c in chosen)
        if bits >= want:
            break
    return (chosen if want else chosen[:1]), min(bits, want)


def _key(ranges: list[tuple[int, int]], bits: int):
    """The first ``bits`` bits of the chosen parts as one integer."""
    key, left = F.lit(0).cast("long"), bits
    for shift, width in ranges:
        use = min(width, left)
        if use:
            key = F.shiftleft(key, use).bitwiseOR(
                F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << use) - 1)))
            left -= use
    return key


def _planes(fp: np.ndarray) -> np.ndarray:
    """64 vertical bit planes, 64 fingerprints to a word; missing lanes are 0."""
    pad = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    pad[:len(fp)] = fp
    bits = np.unpackbits(pad.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # lane x bit
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def close_lanes(query: np.ndarray, fp: np.ndarray, radius: int = RADIUS, block: int = 256):
    """Yields (query indices, lane indices) within ``radius``, block by block.

    The counters hold 0..3 in two bits (``radius`` must be 3 or less)."""
    planes, lanes = _planes(fp), len(fp)
    words = planes.shape[1]
    tail = np.zeros(words * 64, np.uint8)
    tail[lanes:] = 1
    tail = np.packbits(tail, bitorder="little").view("<u8")
    for at in range(0, len(query), block):
        alive = np.arange(at, min(at + block, len(query)))
        one = np.zeros((len(alive), words), np.uint64)
        two, over = one.copy(), np.repeat(tail[None, :], len(alive), 0)
        for p in range(64):
            q = (query[alive] >> np.uint64(63 - p)) & np.uint64(1)
            d = planes[p][None, :] ^ (q * ONES)[:, None]
            carry = one & d
            one ^= d
            over |= two & carry
            two ^= carry
            if p % 8 == 7:
                live = (over != ONES).any(1)
                if not live.all():
                    if not live.any():
                        break
                    alive, one, two, over = alive[live], one[live], two[live], over[live]
        else:
            if radius < 3:  # counts beyond the radius that two bits still hold
                over = over | (two if radius < 2 else two & one) | (one if radius < 1 else np.uint64(0))
            bits = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(bits)
            yield alive[i], j


def _forest(side: np.ndarray, fp: np.ndarray, ci: int, cj: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between chunk ci and chunk cj."""
    fp = fp.view(np.uint64)
    first = np.flatnonzero(side == ci)
    second = first if ci == cj else np.flatnonzero(side == cj)
    label = np.arange(len(fp))
    if not len(first) or not len(second):
        return label[:0], label[:0]
    for i, j in close_lanes(fp[first], fp[second], radius):
        a, b = first[i], second[j]
        keep = a != b
        a, b = a[keep], b[keep]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
        for s, e in zip(starts, [*starts[1:], len(a)]):
            seen = np.unique(label[np.r_[a[s], b[s:e]]])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return moved, label[moved]


def links(prints: DataFrame, n: int, radius: int = RADIUS, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose
    components are those of all pairs within ``radius``."""
    chosen, bits = tables(n, radius, bucket)
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), _key(c, bits).alias("key")) for t, c in enumerate(chosen)])).alias("k"))
    keyed = keyed.select("fp", "k.t", "k.key")
    chunks = keyed.groupBy("t", "key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"), F.count("*").alias("m"))
    chunks = chunks.where("m > 1").drop("m")
    rows = keyed.join(chunks, ["t", "key"])
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("t", "key", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"), "c", "fp")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy()
        a, b = _forest(pdf["c"].to_numpy(), fp, int(key[2]), int(key[3]), radius)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    return rows.groupBy("t", "key", "ci", "cj").applyInPandas(run, "a long, b long")


def clusters(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(k_id, k_text, k_len, fp, component_id, root), one row per document;
    component_id is the smallest doc_id reachable over links, root the
    component's smallest fingerprint.  Components whose ids are NULL or repeat
    may share a component_id, never a root."""
    rows = checkpoint(fingerprints(docs, shingle))
    prints = checkpoint(rows.groupBy("fp").agg(F.min("k_id").alias("low")))
    comp = components(links(prints.select("fp"), prints.count(), radius))
    joined = prints.join(comp, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    low = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(low, "root").select(F.col("fp").alias("of"), "component_id", "root")
    return rows.join(named, F.col("fp") == F.col("of")).drop("of")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, of
    rows that share it the first by (hash of text, length); rows that repeat
    it whole collapse to one."""
    found = clusters(docs, shingle, radius).groupBy("root").agg(
        F.min(F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "k_text", "k_len")).alias("s"))
    kept = found.select("s.k_id", "s.k_text", "s.k_len")
    return key_join(docs, kept, "left_semi").dropDuplicates(["doc_id", "text"])
