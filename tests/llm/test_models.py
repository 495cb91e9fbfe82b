"""Predictions of the trained models against plain versions of their formulas."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from chatlake.llm import language, queries, toxicity
from chatlake.llm.common import table
from tests.llm.cases import SF001


def _trigrams(text):
    kept = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or ""]
    words = " ".join("".join(kept).split())
    return Counter(f" {words} "[i:i + 3] for i in range(len(words))) if words else Counter()


def test_language_equals_brute_force(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text", "lang").collect()
    letters, grams = language.Vectors(), {}

    def vector(text):
        out = np.zeros(language.DIM)
        for g, n in _trigrams(text).items():
            if g not in grams:
                a, b, c = (letters._letter(0 if x == " " else ord(x)).astype(int) for x in g)
                grams[g] = np.roll(a, 2) * np.roll(b, 1) * c
            out += n * grams[g]
        return out

    vectors = {d.doc_id: vector(d.text) for d in docs}
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    learned = {}
    for d in docs:
        if d.lang is not None and not held[d.doc_id]:
            learned[d.lang] = learned.get(d.lang, 0) + vectors[d.doc_id]
    name = next(k for k in queries.queries() if k.startswith("op5_"))
    got = {r.doc_id: r for r in queries.queries()[name](spark, SF001).collect()}
    assert len(got) == len(docs) and set(held.values()) == {True, False}
    for d in docs:
        r, v = got[d.doc_id], vectors[d.doc_id]
        assert r.held_out == held[d.doc_id]
        if not _trigrams(d.text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cos = {x: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for x, p in sorted(learned.items())}
        best = max(cos.values())
        assert math.isclose(cos[r.lang_pred], best, abs_tol=1e-9) and math.isclose(r.score, max(0, best), abs_tol=1e-9)


def _columns(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    names, often = set(words), Counter()
    for w in words:
        often.update(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)
    names |= set(often) | {f"{x}{n}" for x, m in often.items() for n in (2, 4) if m >= n}
    return {zlib.crc32(x.encode()) % 2 ** 20 for x in names}


def test_severity_equals_brute_force(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, SF001, "labels"), toxicity.label_grade())
    assert len(model.cuts) and list(model.cuts) == sorted(model.cuts) and model.weight
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and {r.toxic for r in rows} == {True, False}
    for r in rows:
        z = sum(model.weight.get(c, 0.0) for c in _columns(r.text))
        want = sum(1 / (1 + math.exp(t - z)) for t in model.cuts) if _columns(r.text) else 0.0
        assert math.isclose(r.severity, want, abs_tol=1e-9) and r.toxic == (want >= toxicity.THRESHOLD)


def test_shared_weights_follow_the_likelihood():
    """Without a penalty's pull the thresholds give the grades' shares (each side half)."""
    grades = np.array([0] * 60 + [1] * 30 + [2] * 10)
    model = toxicity.fit([np.zeros(0, np.int32)] * 100, grades, steps=3000)
    above = 1 / (1 + np.exp(model.cuts))  # P(grade > j) of a text without a weight
    assert np.allclose(above, [0.5, 0.125], atol=0.01) and not model.weight
