"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... < G have P(grade > j) = sigmoid(w.x - t_j): one
weight vector shared by ordered thresholds t_0 < t_1 < ....  The features x
are the distinct words of the whole text, their stems (first letters) and stems
that occur several times, each hashed into ``2 ** BITS`` columns, present or
not.  The result is
the expected severity, the sum of P(grade > j).

The model is fitted on the ``SAMPLE`` labelled rows that come first by a hash
of their id (a documented bound; all rows if fewer), the lowest grade and
all others weighing the same, and an L1 penalty that shrinks with the root of
the smaller side's rows, so only words that tell the grades apart get a weight.  Scores read every row's whole
text.

NULL and empty texts have no feature: their severity is 0.  Rows with a NULL
label or no document teach nothing; without any labelled grade above 0 every
severity is 0.  Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import extended, fresh

BITS = 20
STEMS = (4, 5, 6)  # letters
OFTEN = (2, 4)     # occurrences
SAMPLE = 6000
STEPS = 300
RATE = 0.3
L1 = 0.15
RELAX = 10
THRESHOLD = 0.4
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature columns of the whole text."""
    words = Counter(WORD.findall((text or "").lower()))
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += n
    names = [*words, *[x + "*" for x in stems]]
    for times in OFTEN:
        names += [f"{x}*{times}" for x, n in stems.items() if n >= times]
    mask = (1 << bits) - 1
    return np.unique(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in names], np.int32))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Model:
    """Shared weights (sparse: columns and values) and ordered thresholds."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.weight = dict(zip(columns.tolist(), weights.tolist()))
        self.cuts = cuts

    def severity(self, columns: np.ndarray) -> float:
        if not len(columns) or not len(self.cuts):
            return 0.0
        z = sum(map(self.weight.get, columns.tolist(), [0.0] * len(columns)))
        return float(_sigmoid(z - self.cuts).sum())


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, l1: float = L1) -> Model:
    """Cumulative-link model by penalised maximum likelihood (driver, a bounded
    sample): proximal AdaGrad over all rows in every step."""
    levels = np.unique(grades)
    if len(levels) < 2:
        return Model(np.zeros(0, int), np.zeros(0), np.zeros(0))
    y = np.searchsorted(levels, grades)
    rest = int((y > 0).sum())
    share = np.where(y > 0, 0.5 / rest, 0.5 / (len(y) - rest))  # the lowest grade against all others, sums to one
    penalty = l1 / np.sqrt(min(rest, len(y) - rest))            # above the noise of the smaller side
    col = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    first, gaps = np.zeros(1), np.zeros(len(levels) - 2)

    def gradients(z):
        cuts = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
        # P(grade = k) = F(upper) - F(lower), F(-inf) = 0, F(inf) = 1
        fu = _sigmoid(np.where(y < len(cuts), cuts[np.minimum(y, len(cuts) - 1)] - z, np.inf))
        fl = _sigmoid(np.where(y > 0, cuts[np.maximum(y - 1, 0)] - z, -np.inf))
        p = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / p * share, fl * (1 - fl) / p * share
        g_cut = np.bincount(np.minimum(y, len(cuts) - 1)[y < len(cuts)], -du[y < len(cuts)], len(cuts))
        g_cut += np.bincount((y - 1)[y > 0], dl[y > 0], len(cuts))
        return du - dl, np.array([g_cut.sum()]), np.array([g_cut[i + 1:].sum() * np.exp(g) for i, g in enumerate(gaps)])

    def move(param, grad, seen, shrink=0.0):
        seen += grad * grad
        rate = RATE / (np.sqrt(seen) + 1e-9)
        param -= rate * grad
        param[:] = np.sign(param) * np.maximum(np.abs(param) - rate * shrink, 0)

    # thresholds alone first; a feature whose gradient then stays below the penalty keeps no weight
    seen = [np.zeros(1), np.zeros_like(gaps)]
    for _ in range(steps):
        _, g_first, g_gaps = gradients(np.zeros(len(rows)))
        move(first, g_first, seen[0])
        move(gaps, g_gaps, seen[1])
    slope = np.bincount(col, gradients(np.zeros(len(rows)))[0][doc])
    strong = np.abs(slope) > penalty
    use = strong[col] if len(col) else np.zeros(0, bool)
    doc, col, cols = doc[use], (np.cumsum(strong) - 1)[col[use]], np.flatnonzero(strong)
    w = np.zeros(len(cols))
    for shrink in (penalty, penalty / RELAX):      # choose the words, then weigh the chosen ones more freely
        kept = w != 0 if shrink < penalty else np.ones(len(w), bool)
        use = kept[col]
        doc, col, cols, w = doc[use], (np.cumsum(kept) - 1)[col[use]], cols[kept], w[kept]
        seen_w = np.zeros(len(w))
        for _ in range(steps):
            g_z, g_first, g_gaps = gradients(np.bincount(doc, w[col], len(rows)))
            move(w, np.bincount(col, g_z[doc], len(cols)), seen_w, shrink)
            move(first, g_first, seen[0])
            move(gaps, g_gaps, seen[1])
    cuts = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
    return Model(cols[w != 0], w[w != 0], cuts)


def train(docs: DataFrame, labels: DataFrame, grade: Column, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on the first ``sample`` labelled documents by a hash of their id.
    ``grade`` is a whole-number column of ``labels``."""
    known = labels.select(F.col("doc_id").alias("l_id"), grade.cast("int").alias("grade")).where(
        F.col("l_id").isNotNull() & F.col("grade").isNotNull())
    known = known.groupBy("l_id").agg(F.max("grade").alias("grade"))
    picked = known.join(docs.select(F.col("doc_id").alias("l_id")).distinct(), "l_id", "left_semi").orderBy(
        F.xxhash64(F.col("l_id").cast("string")), "l_id").limit(sample)

    def run(batches):
        for b in batches:
            rows = [features(t, bits).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("l_id"), b.column("grade"), pa.array(rows, pa.binary())],
                                             names=["l_id", "grade", "x"])

    texts = docs.select(F.col("doc_id").alias("d_id"), "text").join(
        F.broadcast(picked), F.col("d_id") == F.col("l_id"))  # at most `sample` ids
    schema = T.StructType([picked.schema["l_id"], picked.schema["grade"], T.StructField("x", T.BinaryType())])
    one = texts.select("l_id", "grade", "text").mapInArrow(run, schema).groupBy("l_id", "grade").agg(F.min("x").alias("x"))
    rows = one.orderBy("l_id").collect()
    return fit([np.frombuffer(r["x"], np.int32) for r in rows], np.array([r["grade"] for r in rows], int)) if rows else Model(
        np.zeros(0, int), np.zeros(0), np.zeros(0))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, bits: int = BITS,
          names: tuple[str, str] = ("severity", "toxic")) -> DataFrame:
    """``docs`` with severity (expected grade) and toxic; input columns of these
    names are replaced."""
    kept, schema = extended(docs, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.BooleanType())])

    def run(batches):
        for b in batches:
            s = [model.severity(features(t, bits)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array([x >= threshold for x in s], pa.bool_())], names=schema.names)

    return kept.mapInArrow(run, schema)


def label_grade() -> Column:
    """0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.lit(1) + F.when(F.col("quality") == 0, 1).otherwise(0))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose expected severity is below ``threshold``."""
    names = fresh(docs, "severity"), fresh(docs, "toxic")
    rated = score(docs, train(docs, labels, label_grade()), threshold, names=names)
    return rated.where(~F.col(names[1])).drop(*names)
