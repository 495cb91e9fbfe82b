"""Nulls, empty and long texts, repeats, clashing columns and empty tables."""

import numpy as np
import pytest
from brute import base_places, contamination, simhash
from cases import LONG, ROWS, SF001, edge, empty  # noqa: F401
from pyspark.sql import functions as F

from chatlake.llm import (decontaminate, kdtree, language, licenses, line_dedup, mixing, pii, simhash as sim,
                          toxicity, urls)

ITEMS = [(1, "all rights reserved"), (2, " ".join(LONG.split()[50:70])), (2, None), (None, "5678"), (3, "")]


def by_text(rows, *names):
    return sorted(([getattr(r, n) for n in names] for r in rows), key=repr)


def test_decontaminate(spark, edge, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.contamination(edge, items).collect()
    want = [[d, *contamination(t, ITEMS)] for d, t, *_ in ROWS]
    assert by_text(rows, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    kept = decontaminate.decontaminate(edge, items)
    assert kept.columns == edge.columns
    assert kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(empty, items).count() == 0
    none = decontaminate.contamination(edge, items.limit(0)).collect()
    assert len(none) == len(ROWS) and not any(r.n_hit for r in none)


def test_licenses(spark, edge, empty):
    grams = licenses.template_grams(spark)
    rows = licenses.scan(edge, grams).collect()
    want = []
    for d, t, *_ in ROWS:
        n, at = base_places(t, licenses.BASE)
        want.append([d, n, len(at), at[0][0] if at else None, ",".join(sorted({x for _, x in at}))])
    assert by_text(rows, "doc_id", "n_words", "n_base", "first_word", "base_labels") == sorted(want, key=repr)
    assert licenses.scan(empty, grams).count() == 0


def test_license_with_a_word_inserted_or_lost(spark):
    text = ("x y permission is hereby granted free of any charge to any person obtaining a copy of this "
            "software and associated documentation z")
    rows = spark.createDataFrame([(1, text), (2, "permission to obtain a copy of the text")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows, licenses.template_grams(spark)).collect()}
    assert got[1].labels == "mit" and got[1].n_base == 0 and 0.75 <= got[1].score < 1
    assert got[1].spans[0].start == 2
    assert got[2].labels == "" and got[2].score == 0


def test_simhash(edge, empty):
    rows = sim.clusters(edge).collect()
    assert len(rows) == len(ROWS)
    prints = {(d, simhash(t)) for d, t, *_ in ROWS}
    assert {(r.k_id, r.fp & (2**64 - 1)) for r in rows} == prints
    kept = sim.deduplicate(edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids  # 3, 4, 5 have no word
    assert sim.clusters(empty).count() == 0 and sim.deduplicate(empty).count() == 0


def test_simhash_hot_bucket_in_chunks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.int64)
    fp = {int(b) ^ sum(1 << int(x) for x in rng.choice(60, rng.integers(0, 4), replace=False)) for b in base for _ in range(60)}
    fp = sorted(fp | {int(x) for x in rng.integers(0, 2**63, 200, dtype=np.int64)})
    from brute import near_prints
    want = near_prints(fp)
    from chatlake.llm.components import components
    for bucket, chunk in ((1024, 2048), (4, 16), (1, 1000)):
        edges = sim.links(spark.createDataFrame([(x,) for x in fp], "fp long"), len(fp), bucket=bucket, chunk=chunk)
        root = {r.node: r.root for r in components(edges).collect()}
        assert [root.get(x, x) for x in fp] == [fp[c] for c in want]


def test_fingerprint_text_forms():
    for t in ["a", "a b", "A b\x0bC  d\te", "é É ß", LONG[:4000]]:
        assert sim.fingerprint(t) == simhash(t)


def test_lines(edge, empty):
    out = line_dedup.deduplicate(edge)
    assert out.columns == edge.columns and out.count() == len(ROWS)
    text = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, ROWS[0][1]) in text and (2, "") in text and (3, None) in text and (5, "   \n\t\n") in text and (6, LONG) in text
    assert line_dedup.deduplicate(empty).count() == 0 and line_dedup.line_clusters(empty).count() == 0


def test_line_bands_meet_at_the_stated_rate():
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnop qrstuvwxyz"))
    met = []
    for _ in range(400):
        a = letters[rng.integers(0, 27, 300)]
        b = a.copy()
        for at in (60, 150, 240)[:rng.integers(2, 4)]:
            b[at] = "#"
        x, y = "".join(a), "".join(b)
        s, t = ({f[i:i + 8] for i in range(len(f) - 7)} for f in (x, y))
        j = len(s & t) / len(s | t)
        keys = line_dedup.band_keys([x, y])
        met.append(((keys[0] == keys[1]).any(), 1 - (1 - j ** line_dedup.ROWS) ** line_dedup.BANDS))
        assert line_dedup.similar_pairs([x, y], 0.8)[0, 1] == (j >= 0.8)
    got, want = np.mean(met, 0)
    assert want > 0.985 and got > want - 0.015


def test_language(edge, empty):
    learned = language.prototypes(edge.where("lang is not null"))
    assert sorted(learned) == ["de", "en", "fr"][:len(learned)] or set(learned) <= {"de", "en", "fr"}
    rows = language.predict(edge, learned).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
    assert language.prototypes(empty) == {}
    assert {r.lang_pred for r in language.predict(edge, {}).collect()} == {"und"}


def test_language_vectors_are_products_of_rotated_letters():
    v = language.Vectors(64, 3)
    g = (ord("a") << 42) | (ord("b") << 21) | ord("c")
    want = np.roll(v._letter(ord("a")), 2) * np.roll(v._letter(ord("b")), 1) * v._letter(ord("c"))
    assert (v.gram(g) == want).all()
    one, two = v.bundle("abc abd"), v.bundle("ABC, 12 abd!")
    assert (one == two).all()


def test_toxicity(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, None, 1), (7, 1, None), (None, 1, 1), (99, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(edge, labels, toxicity.label_grade())
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == len(ROWS) and all(r.severity >= 0 for r in rows)
    assert all(r.severity == 0 for r in rows if not (r.text or "").strip())
    bare = toxicity.train(edge, labels.limit(0), toxicity.label_grade())
    assert toxicity.clean(edge, labels.limit(0)).count() == len(ROWS) and not len(bare.cuts)
    assert toxicity.clean(empty, labels).count() == 0
    assert toxicity.clean(edge, labels).columns == edge.columns


def test_toxicity_thresholds_are_ordered_and_severity_grows():
    rng = np.random.default_rng(3)
    x = [np.unique(rng.integers(0, 40, 10)) for _ in range(600)]
    grade = np.array([min(2, (1 in r) + (2 in r)) for r in x])
    m = toxicity.fit(x, grade)
    assert list(m.cuts) == sorted(m.cuts) and len(m.cuts) == 2
    low, mid, high = (np.mean([m.severity(r) for r, g in zip(x, grade) if g == k]) for k in range(3))
    assert low < 0.5 < mid < 1.5 < high


def test_pii_round_trip(edge, empty):
    rows = pii.pseudonymize(edge, "k")
    back = pii.pseudonymize(rows.drop("n_pii", "pii_kinds", "pii_spans"), "k", invert=True)
    texts = lambda d: sorted((repr(r.doc_id), r.text or "") for r in d.select("doc_id", "text").collect())
    assert texts(back) == texts(edge) and pii.pseudonymize(empty, "k").count() == 0


PII = ("4111 1111 1111 1111, 4111111111111111 and 123-45-6789 or +1 (017) 555-7713 and +49 170 1234567. On "
       "2024-02-29, 29.02.2024, 1.5.1999, 3/7/1999 or 07/03/1999; 1.2.3.4, 255.255.255.255. "
       "DE89 3704 0044 0532 0130 00 a.b27@mail7.example.com")
KEEP = "4111111111111112 999-00-0000 1.2.3.400 31.02.2020 2024-13-01 DE00 3704 0044 0532 0130 00 v1.2.3 1000000"


def test_pii_values_are_linked_valid_and_invertible():
    hide, show = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", invert=True)
    new, found = hide.replace(PII)
    assert len(found) == 14 and show.replace(new)[0] == PII
    again, same = hide.replace("x " + PII + " y")
    assert again == "x " + new + " y" and [k for *_, k in same] == [k for *_, k in found]
    assert all(PII[s:e] not in new for s, e, _ in found)
    a, b = new.split(", ")[0], new.split(", ")[1].split()[0]
    assert a.replace(" ", "") == b  # the same card, written in two ways
    assert hide.replace(KEEP) == (KEEP, [])
    assert pii.Pseudonyms(b"other").replace(PII)[0] != new


def test_feistel_is_a_permutation():
    for size in (2, 3, 10, 997):
        f = pii.Feistel(b"key", "t", size)
        assert sorted(map(f, range(size))) == list(range(size))
        assert all(f(f(i), True) == i for i in range(size))


def test_urls(spark):
    data = [(1, "http://Shop.example.org/es/1", "<p>cheap pills shop</p>"), (1, "http://Shop.example.org/es/1", None),
            (2, None, "<p>cheap</p>"), (3, "no scheme", ""), (4, "http://cheappills.example.net/de/x?y#z", "pills"),
            (5, "http://a.com/de/cheappills", "x"), (6, "http://a.com/fr/good", "x"), (None, "x://org", "y"),
            (7, "http://notorg/", None), (8, "http://a.b.org?q", None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("rule", F.lit("r")).withColumn("id", F.lit(1))
    rows = urls.judge(pages).collect()
    assert len(rows) == len(data)
    got = {r.page_id: r for r in rows}
    assert (got[1].rule, got[1].verdict) == ("example.org/es/", "block")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("", "", None, "allow")
    assert (got[4].path, got[4].rule, got[4].verdict) == ("/de/x", None, "block")
    assert {"h:cheap", "h:pills"} <= set(got[4].words)
    assert got[None].rule is None and got[7].rule is None and got[8].rule is None and got[8].host == "a.b.org"
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_split_words_of_any_length(spark):
    word, other = "verylong" * 5, "verylong" * 3 + "x" * 9  # both start with the same 24 letters
    huge = "cheap" * 1200
    data = [(1, f"http://a.com/de/{word}pills", f"<p>{word} pills {other} cheap</p>"), (2, f"http://b.net/{other}pills", "pills cheap"),
            (3, f"http://c.net/{huge}", None), (4, "http://d.net/" + "q" * 40, huge + "z")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.words for r in urls.judge(pages).collect()}
    assert {f"p:{word}", "p:pills"} <= set(got[1]) and {f"p:{other}", "p:pills"} <= set(got[2])
    assert [w for w in got[3] if w.startswith("p:")] == ["p:cheap"] and "p:" + "q" * 40 in got[4]


def brute_split(piece, vocab, total):
    from functools import cache
    from math import log

    @cache
    def best(end):
        if not end:
            return 0.0, 0, 0, ()
        out = []
        for s in range(end):
            w = piece[s:end]
            p = log(vocab[w] / total) if w in vocab else -log(total) - len(w) * log(10)
            head = best(s)
            out.append((round(head[0] + p, 9), head[1] - 1, s, head[-1] + (w,)))
        return max(out)
    return list(best(len(piece))[-1])


def test_viterbi_with_long_words():
    from math import log
    vocab, total = {"a" * 30: 4, "ab": 3, "b": 2, "c" * 26 + "ab": 1}, 10
    for piece in ("a" * 30 + "b", "a" * 31, "c" * 26 + "abab", "x" * 50 + "ab", "ab" * 20, "z"):
        known = {(s, n): log(vocab[piece[s:s + n]] / total) for s in range(len(piece))
                 for n in range(1, len(piece) - s + 1) if piece[s:s + n] in vocab}
        assert urls.viterbi(piece, known, -log(total)) == brute_split(piece, vocab, total), piece


def test_url_verdicts_against_brute_force(spark):
    """The Bayes verdict and score of URLs without a rule, over sf0.001 pages."""
    import re as regex
    from collections import Counter
    from math import log
    rows = spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url", "html").collect()
    counts = Counter()
    for r in rows:
        plain = regex.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", r.html or "")
        counts.update(regex.findall(r"[^\W\d_]+", regex.sub(r"<[^>]*>|&\w+;", " ", plain).lower()))
    total = sum(counts.values())
    got = urls.judge(spark.read.parquet(f"{SF001}/pages.parquet")).collect()
    assert len(got) == len(rows)

    def tokens(r):
        for part, text in (("h", r.host), ("p", r.path)):
            for piece in regex.findall(r"[^\W\d_]+|\d+", text.lower()):
                split = [piece] if piece[0].isdigit() else brute_split(piece, counts, total)
                yield from (f"{part}:{w}" for w in split)

    words = {u: list(tokens(r)) for u, r in {r.url: r for r in got}.items()}
    bad, good = Counter(), Counter()
    for r in got:
        if r.rule is not None:
            (bad if r.verdict == "block" else good).update(words[r.url])
    kinds = len(bad | good)
    n_bad, n_good = sum(bad.values()), sum(good.values())
    for r in got:
        assert r.words == sorted(set(words[r.url])), r.url
        if r.rule is None:
            score = sum(log((bad[w] + 1) / (n_bad + kinds)) - log((good[w] + 1) / (n_good + kinds))
                        for w in words[r.url] if w in bad or w in good)
            assert abs(score - r.score) < 1e-6 and r.verdict == ("block" if r.score > 0 else "allow"), r.url
    assert any(r.rule is None for r in got)


def test_viterbi_is_the_best_split():
    from itertools import product
    from math import log
    piece, vocab, total = "thethere", {"the": 50, "there": 9, "he": 20, "re": 5, "t": 1}, 100
    known = {(s, n): log(vocab[piece[s:s + n]] / total) for s in range(8) for n in range(1, 9) if piece[s:s + n] in vocab}

    def cost(split):
        return sum(log(vocab[w] / total) if w in vocab else -log(total) - len(w) * log(10) for w in split)

    splits = []
    for cuts in product([0, 1], repeat=7):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], 8]
        splits.append([piece[a:b] for a, b in zip(at, at[1:])])
    assert urls.viterbi(piece, known, -log(total)) == max(splits, key=lambda s: (cost(s), -len(s))) == ["the", "there"]


VECTORS = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]),
           (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.2]), (100, [0.3, 0.3]), (None, [9.0, 9.0]),
           (200, [1.0, 2.0, 3.0]), (300, []), (400, [1e30, 1.0])]


@pytest.mark.parametrize("shard_rows", [2, 100])
def test_top_k(spark, shard_rows):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    rows = kdtree.top_k(v, F.col("vec_id") % 100 == 0, k=3, shard_rows=shard_rows, block=1).collect()
    good = {i: [int(np.floor(1024 * x)) if x < 1e20 else int(x) * 1024 for x in e] for i, e in VECTORS
            if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = set()
    for q in (0, 100, 200, 300, 400):
        c = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(good[q], e)))), i) for i, e in good.items()
             if i != q and len(e) == len(good[q])]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(c)[:3], 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in rows} == want
    assert kdtree.top_k(v.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_keeps_all_vectors_of_an_id(spark):
    """Found by the contract: every row but the query's own is a candidate."""
    data = [(100, [1.0, 0.0]), (1, [0.1, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (2, [1.0, 1.0]), (200, [0.0, 1.0]), (200, [0.0, -1.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    for shard_rows in (2, 100):
        rows = kdtree.top_k(v, F.col("vec_id") % 100 == 0, k=2, shard_rows=shard_rows, block=1).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.rank):
            got.setdefault((r.query_id, r.query_vector), []).append((r.vec_id, r.score))
        assert got.pop(next(q for q in got if q[0] == 100)) == [(1, 5 << 20), (2, 1 << 20)]
        assert sorted(got.values()) == [[(1, 0), (1, 0)], [(2, 1 << 20), (1, 0)]]


def test_top_k_over_cells(spark):
    """Clusters far apart: cells are pruned, one vector holds a third of the rows, results stay exact."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 5)) * 0.1 + rng.integers(-3, 4, size=(600, 5))
    x[:200] = x[0]
    v = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = kdtree.top_k(v, F.col("vec_id") % 20 == 0, k=4, shard_rows=40, block=7).collect()
    e = np.floor(x * 1024).astype(np.int64)
    want = set()
    for q in range(0, 600, 20):
        score = e @ e[q]
        best = [j for j in np.lexsort((np.arange(600), -score)) if j != q][:4]
        want |= {(q, r, int(j), int(score[j])) for r, j in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in rows} == want and len(rows) == len(want)


def test_cells_and_bounds():
    rng = np.random.default_rng(8)
    pts = np.floor(rng.normal(size=(3000, 4)) * 300 + rng.integers(-2, 3, size=(3000, 4)) * 4000)
    nodes = kdtree.fit_cells(pts[:1000], 16)
    cell = kdtree.cell_of(pts, nodes)
    assert set(cell) == set(range(16)) and len(nodes) == 15
    assert kdtree.fit_cells(np.ones((100, 3)), 8) == [] and set(kdtree.cell_of(np.ones((5, 3)), [])) == {0}
    lo, hi = (np.array([f(pts[cell == c], axis=0) for c in range(16)]) for f in (np.min, np.max))
    score = pts[:50] @ pts.T
    floors = np.sort(score, axis=1)[:, -10]
    keep = kdtree.reaches(pts[:50], lo, hi, floors)
    for q in range(50):
        assert all(keep[q, c] for c in set(cell[score[q] >= floors[q]]))
    assert keep.mean() < 0.9  # cells are left out


def test_kd_tree_walk_is_exact():
    rng = np.random.default_rng(0)
    pts = np.floor(rng.normal(size=(900, 6)) * 300)
    pts[100:300] = pts[100]
    ids = rng.permutation(900).astype(np.int64)
    tree = kdtree.Tree(pts, ids, leaf=8)
    bounds = tree.bounds(pts)
    for i in range(0, 900, 30):
        score = pts @ pts[i]
        want = [(int(score[j]), int(ids[j])) for j in np.lexsort((ids, -score)) if j != i][:10]
        got = [(int(s), int(tree.ids[j])) for s, j in tree.search(pts[i], ids[i], bounds[i], 10)]
        assert got == want
        floor = want[4][0]
        got = [(int(s), int(tree.ids[j])) for s, j in tree.search(pts[i], ids[i], bounds[i], 10, floor)]
        assert [x for x in want if x[0] >= floor] == got


def test_mix(spark, edge, empty):
    out = mixing.mix(edge, {"a": 2})
    assert out.count() == len(ROWS) and "Slot" not in out.columns and {"slot", "block", "pos", "on_target"} <= set(out.columns)
    assert mixing.mix(empty, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(edge, {"a": 0})


def test_mix_spreads_documents_without_id(spark):
    """A third of the rows has no id: they are no single run, and every place is taken once."""
    rows = [(i if i % 3 else None, "a" if i % 2 else None, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    a, b = (mixing.mix(docs.repartition(n), {"a": 3}, run_rows=100).collect() for n in (3, 5))
    assert sorted((r.source or "", r.block, r.pos) for r in a) == sorted(
        (s or "", k // 8, k % 8) for s in ("a", None) for k in range(1500))
    at = lambda rs: {r.text: (r.slot, r.pos) for r in rs}
    assert at(a) == at(b)
    first = [r.doc_id is None for r in a if r.block < 60]
    assert 0.25 < sum(first) / len(first) < 0.42


def test_period_of_many_slots(spark):
    from brute import edf_slots
    weights = {f"s{i}": 1 + i * i % 37 for i in range(40)}
    src = spark.createDataFrame([(s, w) for s, w in weights.items()], "src string, a long")
    slots, p = edf_slots(weights)
    got = mixing.period(src).collect()
    assert {(r.src, r.i): r.at for r in got} == dict(slots) and {r.p for r in got} == {p} and len(got) == p


def test_mix_stays_within_one_block(spark):
    from brute import mix
    n = {"a": 400, "b": 100, "c": 90, "d": 60, "e": 37}
    rows = [(i * 10 + j, s) for j, s in enumerate(n) for i in range(n[s])]
    weights = {"a": 5, "b": 3, "c": 3, "d": 1}
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    for run_rows in (10, 5000):
        got = mixing.mix(docs, weights, block_docs=4, run_rows=run_rows).collect()
        want = mix(rows, weights, block=4)
        assert {r.doc_id: (r.block, r.pos, r.slot) for r in got} == want
    share = {s: weights.get(s, 1) / 13 for s in n}
    at = {r.slot: r.source for r in got if r.on_target}
    had = dict.fromkeys(n, 0)
    assert sorted(at) == list(range(max(at) + 1))
    for t in range(max(at) + 1):
        had[at[t]] += 1
        assert all(abs(had[s] - share[s] * (t + 1)) < 1 for s in n)
