"""Periodic runs of words by recompression.

A run is a stretch of consecutive words with smallest period q, of at least
``max(least, times * q)`` words, that cannot be made longer on either side
without losing the period.  Words are the maximal stretches of bytes other than
blank and the ASCII controls 9 to 13, compared byte by byte.

1. The words of several documents stand in one sequence, each document followed
   by a symbol of its own.  Recompression turns it into a run-length grammar:
   block compression replaces every maximal block of one symbol by a symbol for
   (symbol, length); pair compression splits the symbols into a left and a right
   class by a hash bit and replaces every pair left-right by a new symbol; both
   alternate until a document is one symbol.  The rules depend on the symbols
   alone, so equal stretches are parsed alike up to their ends.
2. A longest common extension (LCE) of two places climbs the grammar while both
   stand at the start of a symbol, passes what is equal, and comes down again
   where symbols differ: a few steps a level, exact, to the left as to the right.
3. Candidates are places of a harmonic grid.  In a run of period q words i and
   i + q are equal over a stretch of ``max(least - q, (times - 1) * q)`` words at
   least, so one of the multiples of that number lies in it; the grid is closer by
   ``GRAM - 1``, so that GRAM equal words stand there.  Grid places whose hash of
   GRAM words equals that q words further are extended by LCE to both sides.
   The places of all periods are n/2 + n/4 + n/6 ... in number.
4. Stretches found for several periods have the smallest of them.

A word is dropped from the collapsed text if a run holds it after the run's
first q words.  Documents are taken whole, some at a time (``CHUNK`` words, or
one longer document); time is n log n, memory linear in the longest document.

NULL, empty and blank texts have no word, no run and an empty collapsed text;
repeated rows have a row each; an empty table gives no row.  Columns of the
documents are kept but for those named like the result's own (``n_words``,
``runs``, ``collapsed``, in any letter case), which are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import extended

LEAST, TIMES = 24, 3
GRAM = 8            # words that a grid place must share with that q words further
CHUNK = 1 << 17     # words that share a grammar
BLOCK = 1 << 16     # candidates extended at once
RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                    T.StructField("period", T.LongType())])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
          T.StructField("collapsed", T.StringType())]
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt + 1)) * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Level:
    """One sequence of the grammar and, but for the last, how its symbols are
    grouped into the next one's: ``up`` (the group of each symbol), ``head`` and
    ``tail`` (first and last of its group), ``start`` and ``stop`` (each group's
    first and last symbol), ``right`` and ``left`` (how many symbols from here on
    are sure to equal this one: the rest of a block, else 1)."""

    def __init__(self, sym: np.ndarray):
        self.sym, self.up = sym, None

    def group(self, start: np.ndarray, blocks: bool) -> None:
        n = len(self.sym)
        self.start, self.stop = start, np.r_[start[1:], n] - 1
        self.up = np.repeat(np.arange(len(start)), self.stop - start + 1)
        at = np.arange(n)
        self.head, self.tail = at == start[self.up], at == self.stop[self.up]
        self.right = self.stop[self.up] - at + 1 if blocks else np.ones(n, np.int64)
        self.left = at - start[self.up] + 1 if blocks else self.right


def _named(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """Symbols for keys, from ``first`` on, and the next free one."""
    values, of = np.unique(keys, return_inverse=True)
    return first + of.reshape(-1), first + len(values)


class Grammar:
    """Run-length grammar of a sequence; ``ends`` marks the symbols, each
    occurring once, that no block or pair holds: the first and last are such."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        sym, free, parts, turn = ids.astype(np.int64), int(ids.max()) + 1, int(ends.sum()), 0
        self.levels = [Level(sym)]
        full = int((ends[:-1] & ~ends[1:]).sum())        # documents with a word
        while len(sym) > parts + full:
            sym, ends, free = self._blocks(sym, ends, free)
            sym, ends, free = self._pairs(sym, ends, free, turn)
            turn += 1

    def _blocks(self, sym, ends, free):
        start = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]])
        self.levels[-1].group(start, blocks=True)
        size = np.diff(np.r_[start, len(sym)])
        new, long = sym[start], size > 1
        if long.any():
            new[long], free = _named(new[long] * np.int64(size.max() + 1) + size[long], free)
        self.levels.append(Level(new))
        return new, ends[start], free

    def _pairs(self, sym, ends, free, turn):
        side = (_mixed(sym, turn) & np.uint64(1)).astype(bool)
        left, right = ~side & ~ends, side & ~ends
        pair, other = left[:-1] & right[1:], right[:-1] & left[1:]
        if other.sum() > pair.sum():
            pair = other
        start = np.flatnonzero(np.r_[True, ~pair])
        self.levels[-1].group(start, blocks=False)
        new, joined = sym[start], np.r_[pair, False][start]
        if joined.any():
            at = start[joined]
            new[joined], free = _named(sym[at] * np.int64(free) + sym[at + 1], free)
        self.levels.append(Level(new))
        return new, ends[start], free

    def extend(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from places ``x`` and ``y`` (x < y, of one document)
        on are equal; ``back``: up to and with these places, to the left."""
        side = -1 if back else 1
        from_x, q, stuck = x, np.arange(len(x)), []
        for lv in self.levels:                            # climb
            differ, risen = [], []
            while len(q):
                if lv.up is not None:
                    edge = lv.tail if back else lv.head
                    rise = edge[x] & edge[y]
                    risen.append((q[rise], lv.up[x[rise]], lv.up[y[rise]]))
                    q, x, y = q[~rise], x[~rise], y[~rise]
                same = lv.sym[x] == lv.sym[y]
                differ.append((q[~same], x[~same], y[~same]))
                q, x, y = self._pass(lv, back, side, q[same], x[same], y[same])
            stuck.append(differ)
            q, x, y = (np.concatenate(c) for c in zip(*risen)) if risen else (q, x, y)
        q = x = y = np.zeros(0, np.int64)
        for lv, differ in zip(reversed(self.levels), reversed(stuck)):   # come down
            if lv.up is not None:
                child = lv.stop if back else lv.start
                x, y = child[x], child[y]
            while len(q):
                same = lv.sym[x] == lv.sym[y]
                differ.append((q[~same], x[~same], y[~same]))
                q, x, y = self._pass(lv, back, side, q[same], x[same], y[same])
            if differ:
                q, x, y = (np.concatenate(c) for c in zip(*differ))
        out = np.zeros(len(from_x), np.int64)
        out[q] = side * (x - from_x[q])
        return out

    @staticmethod
    def _pass(lv, back, side, q, x, y):
        if lv.up is None:
            return q, x + side, y + side
        room = lv.left if back else lv.right
        n = np.minimum(room[x], room[y])
        return q, x + side * n, y + side * n


def _grid(gram: np.ndarray, sizes: np.ndarray, least: int, times: int, k: int):
    """Places x and periods q of the harmonic grid where k words equal those q
    further.  ``sizes``: words of the documents, longest first."""
    ends = np.cumsum(sizes + 1) + 1                       # after each document's own symbol
    xs, qs, docs = [], [], len(sizes)
    for q in range(1, int(sizes[0]) // times + 1):
        need = max(least, times * q)
        while docs and sizes[docs - 1] < need:            # only documents that can hold such a run
            docs -= 1
        if not docs:
            break
        step = max(least - q, (times - 1) * q) - k + 1
        x = np.arange(1, min(int(ends[docs - 1]), len(gram)) - q, step)   # place 0 is no word
        x = x[gram[x] == gram[x + q]]
        if len(x):
            xs.append(x)
            qs.append(np.full(len(x), q))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(xs), np.concatenate(qs)) if xs else (empty, empty)


def find_runs(ids: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs (start, length, period), by start then period, of every sequence of
    word numbers."""
    out = [np.zeros((0, 3), np.int64) for _ in ids]
    order = sorted((i for i in range(len(ids)) if len(ids[i]) >= least), key=lambda i: -len(ids[i]))
    if not order:
        return out
    sizes = np.array([len(ids[i]) for i in order])
    first = int(max(ids[i].max() for i in order)) + 1     # numbers from here on end documents
    seq = np.concatenate([[first], *(np.r_[ids[i], first + 1 + d] for d, i in enumerate(order))]).astype(np.int64)
    k = max(1, min(GRAM, min(max(least - q, (times - 1) * q) for q in range(1, least + 1)) // 2))
    word = _mixed(seq)
    gram = np.zeros(max(len(seq) - k + 1, 0), np.uint64)
    for j in range(k):
        gram = gram * MIX + word[j:len(seq) - k + 1 + j]
    x, q = _grid(gram, sizes, least, times, k)
    if not len(x):
        return out
    grammar, found = Grammar(seq, seq >= first), []
    for s in range(0, len(x), BLOCK):
        a, p = x[s:s + BLOCK], q[s:s + BLOCK]
        back = grammar.extend(a - 1, a + p - 1, back=True)
        length = back + grammar.extend(a, a + p) + p
        long = length >= np.maximum(least, times * p)
        found.append(np.unique(np.c_[a - back, length, p][long], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)       # by start, length, period
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)][:len(runs)]]   # the smallest period
    begins = np.cumsum(np.r_[1, sizes[:-1] + 1])          # each document's first place
    doc = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    runs[:, 0] -= begins[doc]
    for d, part in zip(np.unique(doc), np.split(runs, np.flatnonzero(np.diff(doc)) + 1)):
        out[order[d]] = part
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that no run holds after its first period."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(gone[:-1]) == 0)


def _chunks(texts: pa.Array):
    """Words of the texts, of about CHUNK words at once."""
    words, size = [], 0
    for t in texts:
        w = (t.as_py() or b"").split()
        if size and size + len(w) > CHUNK:
            yield words
            words, size = [], 0
        words.append(w)
        size += len(w)
    if words:
        yield words


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The documents with ``n_words``, ``runs`` (start, length and period, by start
    then period) and ``collapsed``, the kept words joined by one blank."""
    kept, schema = extended(docs, FIELDS)
    names = schema.names
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for b in batches:
            texts = b.column(b.schema.names.index("text")).cast(pa.binary())
            sizes, runs, collapsed = [], [], []
            for words in _chunks(texts):
                number = defaultdict(count().__next__)
                ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words]
                for w, found in zip(words, find_runs(ids, least, times)):
                    sizes.append(len(w))
                    runs.append(found)
                    collapsed.append(b" ".join([w[i] for i in kept_words(len(w), found)] if len(found) else w))
            flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            column = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
                [pa.array(flat[:, j]) for j in range(3)], fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), column,
                                              pa.array(collapsed, pa.binary()).cast(pa.string())], names=names)

    return kept.mapInArrow(work, schema)


def densest_run(runs: Column) -> Column:
    """The run of greatest length / period, compared as fractions; ties to the
    smaller start, then period; NULL where there is none."""
    def order(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(runs, order), F.lit(0))
