"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (``DIM`` components, drawn from
the code point).  An n-gram's vector binds its letters: the product of their
vectors, each rotated by its place.  A text's vector bundles (adds) the
vectors of all its n-grams, a language's prototype those of all its training
texts, and a text gets the language whose prototype has the largest cosine.

Texts are lower-cased; every run of characters that are not letters counts as
one blank, with one before and after the text.  Prototypes are sums of whole
numbers, so they don't depend on how rows are dealt; each task adds up its
texts and Spark adds up the tasks' sums.  The prototypes alone (languages x
DIM numbers) reach the driver and the tasks.

NULL texts and texts without a letter get ``und`` and score 0, as does any
text where nothing was learned.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import extended

DIM = 1024
N = 3
SEED = 7
CACHE = 20_000  # n-gram vectors a task keeps (80 MB)
UND = "und"

_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 for no letter."""
    global _table
    if _table is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x30000):  # no cased or alphabetic letter of text use lies beyond plane 2
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        for c in range(0x30000, 0x33480):
            if chr(c).isalpha():
                out[c] = c
        _table = out
    return _table


def ngrams(text: str, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (21 bits a letter, 0 the blank) and their counts."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.r_[np.uint32(0), _letters()[cp], np.uint32(0)].astype(np.int64)
    x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]
    if not x.any():
        return x[:0], x[:0]
    x = np.r_[np.zeros(max(0, n - len(x)), np.int64), x]
    g = x[:len(x) - n + 1].copy()
    for i in range(1, n):
        g = g << 21 | x[i:len(x) - n + 1 + i]
    return np.unique(g, return_counts=True)


class Vectors:
    """Vectors of n-grams, kept while there are at most CACHE of them."""

    def __init__(self, dim: int = DIM, n: int = N, seed: int = SEED):
        self.dim, self.n, self.seed = dim, n, seed
        self.letter: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self):
        self.at: dict[int, int] = {}
        self.rows = np.empty((256, self.dim), np.float32)

    def _letter(self, c: int) -> np.ndarray:
        v = self.letter.get(c)
        if v is None:
            bits = np.random.default_rng([self.seed, c]).integers(0, 2, self.dim, dtype=np.int8)
            v = self.letter[c] = bits * np.int8(2) - np.int8(1)
            if len(self.letter) > 8 * CACHE:
                self.letter = {c: v}
        return v

    def gram(self, g: int) -> np.ndarray:
        v = np.ones(self.dim, np.int8)
        for place in range(self.n):
            v = v * np.roll(self._letter((g >> 21 * (self.n - 1 - place)) & 0x1FFFFF), self.n - 1 - place)
        return v

    def _index(self, grams: list[int]) -> np.ndarray:
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams):
            j = self.at.get(g)
            if j is None:
                j = self.at[g] = len(self.at)
                if j == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[j] = self.gram(g)
            out[i] = j
        return out

    def bundle(self, text: str) -> np.ndarray | None:
        """Sum of the text's n-gram vectors (whole numbers), None without a letter."""
        grams, counts = ngrams(text, self.n)
        if not len(grams):
            return None
        total = np.zeros(self.dim)
        for s in range(0, len(grams), 4096):
            part = grams[s:s + 4096].tolist()
            if len(self.at) + len(part) > CACHE:
                self.clear()
            at = self._index(part)
            total += counts[s:s + 4096].astype(np.float32) @ self.rows[at]
        return np.rint(total)


def prototypes(train: DataFrame, dim: int = DIM, n: int = N) -> dict[str, np.ndarray]:
    """Language -> sum of its texts' vectors, over all rows of ``train``
    (text, lang) with a non-NULL lang and a letter."""

    def run(batches):
        vectors, sums = Vectors(dim, n), {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                v = vectors.bundle(text or "")
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "v"])

    part = train.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(
        run, "lang string, v array<long>")
    total = part.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("v")).collect()
    return {r["lang"]: np.array(r["v"], float) for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], n: int = N) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, 0 to 1); only ``text`` is read."""
    names = list(learned)
    unit = np.array([v / (np.linalg.norm(v) or 1.0) for v in learned.values()])
    dim = unit.shape[1] if names else DIM
    kept, schema = extended(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        vectors = Vectors(dim, n)
        for b in batches:
            lang, score = [], []
            for text in b.column("text").to_pylist():
                v = vectors.bundle(text or "") if names else None
                cos = unit @ v / (np.linalg.norm(v) or 1.0) if v is not None else None
                best = -1 if cos is None else int(np.argmax(cos))
                lang.append(UND if cos is None else names[best])
                score.append(0.0 if cos is None else float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=schema.names)

    return kept.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
