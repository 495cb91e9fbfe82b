"""Periodic runs: brute force, the grammar's extensions, edges."""

import hashlib

import numpy as np
from brute import periodic, repeated
from cases import LONG, ROWS, edge, empty  # noqa: F401

from chatlake.llm import periods, queries


def sequences(rng):
    for _ in range(rng.integers(1, 6)):
        n = int(rng.integers(0, 300))
        a = rng.integers(0, int(rng.choice([1, 2, 3, 10])), n)
        if n > 10 and rng.random() < 0.7:
            s = int(rng.integers(0, n))
            p = 1 + (n - s) // int(rng.integers(3, 11))
            i = np.arange(n)
            i[s:] = s + (i[s:] - s) % p
            a = a[i]
        yield a.astype(np.int64)


def test_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(150):
        docs = list(sequences(rng))
        least, times = (24, 3) if trial % 3 else (int(rng.integers(2, 30)), int(rng.integers(2, 5)))
        got = [[tuple(r) for r in x.tolist()] for x in periods.find_runs(docs, least, times)]
        assert got == [periodic(d.tolist(), least, times) for d in docs]


def test_grammar_extensions():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5):
        a = rng.integers(0, k, 500)
        a[250:] = a[:250]
        seq = np.r_[k, a, k + 1].astype(np.int64)
        g = periods.Grammar(seq, seq >= k)
        assert len(g.levels[-1].sym) == 3
        x = rng.integers(1, 500, 400)
        y = x + rng.integers(1, 501 - x)
        ahead, back = g.extend(x, y), g.extend(x, y, back=True)
        for i, j, f, b in zip(x, y, ahead, back):
            n = 0
            while seq[i + n] == seq[j + n]:
                n += 1
            m = 0
            while seq[i - m] == seq[j - m]:
                m += 1
            assert (f, b) == (n, m)


def test_a_run_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(periods, "BLOCK", 100)
    assert [r.tolist() for r in periods.find_runs([np.zeros(5000, np.int64), np.arange(40)])] == [[[0, 5000, 1]], []]


def test_edges(edge, empty):
    got = periods.periodic_runs(edge)
    assert got.columns == [*edge.columns, "n_words", "runs", "collapsed"] and periods.periodic_runs(empty).count() == 0
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        words = [w.decode() for w in (r.text or "").encode().split()]
        assert r.n_words == len(words)
        if r.text == LONG:
            assert [tuple(x) for x in r.runs] == [(0, 30_000, 977)] and r.collapsed.split() == words[:977]
        else:
            assert r.runs == [] and r.collapsed == " ".join(words)


def test_only_blanks_and_controls_part_words(spark):
    text = "a b \x1cc\td\x0be\x0c\rf g\n"
    row = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.collapsed == "a b \x1cc d e f g" and row.n_words == 5


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"v{x}" for x in rng.integers(0, 50, int(rng.integers(0, 400))))) for i in range(120)]
    docs += [(1000, None), (1001, ""), (None, "ab " * 30), (1002, "x " * 23), (1003, "x " * 24 + "y " + "u v w " * 9 + "u")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op13_periods(spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs)
    found = 0
    for d, t in docs:
        w = repeated(d, (t or "").split())
        runs = periodic(w)
        keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        r = rows[d]
        found += bool(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(keep).encode()).hexdigest()
    assert found > 5
