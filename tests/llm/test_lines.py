"""Lines of every length: short repeats, small edits and the bands' recall."""

import numpy as np

from chatlake.llm import line_dedup, queries


def test_short_lines_take_part(spark):
    texts = [(1, "ok\n\nOne line.\n  "), (2, "One  line.\n\nok\nother\n \t"), (3, "é\nother\né"), (4, "ok")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(docs).collect()}
    assert got == {1: "ok\n\nOne line.\n  ", 2: "\nother\n \t", 3: "é", 4: ""}
    rows = line_dedup.line_clusters(docs).collect()
    assert len(rows) == 9 and sum(r.kept for r in rows) == 4


def test_op4_has_a_row_for_every_line_that_is_not_blank(spark):
    from cases import SF001
    from oracle_util import duck
    texts = duck(SF001).execute("SELECT doc_id, text FROM documents").fetchall()
    forms = {(d, i): f for d, t in texts for i, x in enumerate((t or "").split("\n")) if (f := " ".join(x.split()).lower())}
    rows = queries.op4_lines(spark, SF001).collect()
    assert len(rows) == len(forms) and {(r.doc_id, r.line_no) for r in rows} == set(forms)
    kept = [forms[r.doc_id, r.line_no] for r in rows if r.kept]
    assert len(kept) == len(set(kept))


def test_components_equal_brute_force(spark):
    """op4 on sf0.001, where the bands miss none of the links."""
    from brute import line_components
    from cases import SF001
    from oracle_util import duck
    docs = duck(SF001).execute("SELECT doc_id, text FROM documents").fetchall()
    want = line_components(docs)
    rows = {(r.doc_id, r.line_no): r for r in queries.op4_lines(spark, SF001).collect()}
    assert set(rows) == set(want) and {k for k, r in rows.items() if r.kept} == {k for k, (_, kept) in want.items() if kept}
    assert len({(want[k][0], r.component) for k, r in rows.items()}) == len({c for c, _ in want.values()})


def test_pairs_at_once_follow_the_same_rule():
    rng = np.random.default_rng(9)
    forms = []
    for _ in range(300):
        a = "".join(rng.choice(list("abcde fg"), int(rng.integers(1, 220))))
        b = list(a)
        for _ in range(int(rng.integers(0, 6))):
            b[int(rng.integers(0, len(b)))] = "#"
        forms += [a, "".join(b)]
    want = [line_dedup.similar_pairs(forms[i:i + 2], 0.8)[0, 1] for i in range(0, len(forms), 2)]
    assert line_dedup.similar_two(forms, 0.8).tolist() == want and 0 < sum(want) < 300


def test_small_and_large_groups_and_the_far_side(spark, monkeypatch):
    """The same links by matrix as by pairs, with broadcast hashes as with joined ones."""
    rng = np.random.default_rng(12)
    docs = [(2 * i + j, x) for i in range(150) for j, x in enumerate(_edited(rng, int(rng.integers(60, 110)), "letter"))]
    docs += [(1000 + i, "the same start of a line that many others have, and number %03d" % i) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    answer = lambda: sorted((r.k_id, r.kept, r.first.k_id) for r in line_dedup.line_clusters(df, chunk=16).collect())
    one = answer()
    monkeypatch.setattr(line_dedup, "FEW_LINES", 0)
    assert answer() == one


def _edited(rng, n, edit):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(letters[rng.integers(0, 26, 5)]) for _ in range(n // 6 + 1)]
    line = " ".join(words)[:n - 1] + "z"
    at = 6 * int(rng.integers(1, n // 6 - 1))
    if edit == "word":
        return line, line[:at] + "".join(letters[rng.integers(0, 26, 5)]) + line[at + 5:]
    return line, line[:at + 2] + ("7" if edit == "digit" else "é") + line[at + 3:]


def test_small_edits_of_short_lines_are_linked(spark):
    rng = np.random.default_rng(8)
    cases = [_edited(rng, n, e) for n in range(40, 121, 4) for e in ("letter", "digit", "word") for _ in range(4)]
    assert all(line_dedup.similar_pairs(list(c), 0.8)[0, 1] for c in cases)
    assert not line_dedup.similar_pairs([a for a, _ in cases], 0.8)[~np.eye(len(cases), dtype=bool)].any()
    docs = spark.createDataFrame([(i * 2 + j, x) for i, c in enumerate(cases) for j, x in enumerate(c)], "doc_id long, text string")
    got = {r.k_id: (r.first.k_id, r.kept) for r in line_dedup.line_clusters(docs).collect()}
    assert all(got[2 * i] == (2 * i, True) for i in range(len(cases)))
    assert sum(got[2 * i + 1] == (2 * i, False) for i in range(len(cases))) >= 0.99 * len(cases)


def test_lines_that_share_less_stay_apart():
    a = "the first of these lines is about apples and pears"
    b = "the second of those lines was about plums or pears"
    assert not line_dedup.similar_pairs([a, b, "part 11", "part 12"], 0.8)[~np.eye(4, dtype=bool)].any()
    assert not line_dedup.similar_pairs(["-" * 60, "=" * 60], 0.8)[0, 1]


def test_bands_let_few_pairs_at_the_threshold_pass():
    assert 1 - (1 - 0.8 ** line_dedup.ROWS) ** line_dedup.BANDS >= 0.995
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnop qrstuvwxyz"))
    met = 0
    for _ in range(500):
        a = letters[rng.integers(0, 27, 300)]
        b = a.copy()
        b[[40, 110, 180, 250]] = "#"  # 32 of 293 shingles differ on each side: similarity 0.803
        keys = line_dedup.band_keys(["".join(a), "".join(b)])
        met += (keys[0] == keys[1]).any()
    assert met >= 0.99 * 500


def test_a_line_repeated_within_a_task_gives_its_keys_once(spark):
    line = "one long line that stands in a lot of documents, again and again"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    rows = line_dedup._line_rows(docs, 1, with_text=False).collect()
    assert len(rows) == 100 and sum(len(r["keys"]) > 0 for r in rows) == 51
    got = line_dedup.deduplicate(docs).collect()
    assert sum(line in r.text for r in got) == 1


def test_keys_do_not_depend_on_the_lines_beside():
    """Lines with characters of two 16-bit units, lone halves of such, lines shorter than a shingle."""
    forms = ["a", "\U0001f600", "ab\U0001f600" * 30, "\ud83d", "\ude00 y", "x" * 39, "1234567", "12345678", "\u00e9" * 50,
             "the quick brown fox jumps over the lazy dog again and again"]
    keys, n = line_dedup.line_keys(forms)
    alone = [line_dedup.line_keys([f]) for f in forms]
    assert n.tolist() == [int(a[1][0]) for a in alone]
    assert keys.tolist() == [k for a in alone for k in a[0].tolist()]


def test_forms_of_a_whole_text_are_those_of_its_lines():
    rng = np.random.default_rng(3)
    letters = list("aΣς­'. \n\t\r\x0b\x1c\x85\xa0 　éİ")
    texts = ["", "\n", "a b\nC", "ΑΣ\nΣ", "A É\n\nb ", " x", "two  blanks"] + ["".join(rng.choice(letters, 9)) for _ in range(5000)]
    for t in texts + ["Ab cΣ\n" * 3 + t for t in texts]:
        assert line_dedup.forms_of(t) == [line_dedup.normal(x) for x in t.split("\n")]
    assert line_dedup.forms_of(None) == []


def test_keys_of_two_lines_are_found_whatever_their_range(spark, monkeypatch):
    """Ranges of few keys, tasks that sort few at once, a key of very many lines, lines that repeat."""
    monkeypatch.setattr(line_dedup, "KEYS", 50)
    monkeypatch.setattr(line_dedup, "RANGE", 40)
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(-9, 9)), [int(k) for k in rng.integers(-1 << 63, 1 << 63, 600)[:3]] + [int(rng.integers(0, 200)) - 100 << 55]) for _ in range(400)]
    rows += [(i, [-7]) for i in range(300)] + [(5, [77, 78])] * 30 + [(8, []), (6, [78])]
    df = spark.createDataFrame(rows, "h1 long, keys array<long>").repartition(3)
    lines = {}
    for h, keys in rows:
        for k in keys:
            lines.setdefault(k, set()).add(h)
    got = [r.key for r in line_dedup._shared_keys(df).collect()]
    want = {k for k, v in lines.items() if len(v) > 1}
    assert len(got) == len(set(got)) and set(got) == want and {-7, 78} <= want and 77 not in want
    none = spark.createDataFrame([], "h1 long, keys array<long>")
    assert line_dedup._shared_keys(none).count() == 0


def test_a_line_of_many_pairs_is_cut_once(monkeypatch):
    rng = np.random.default_rng(10)
    base = "".join(rng.choice(list("abcdefgh "), 90)).strip()
    forms = [base[:i] + "#" + base[i + 1:] for i in range(0, 80, 10)] + ["x", "\U0001f600" * 50, base * 9]
    one, two = np.triu_indices(len(forms), 1)
    cut, shingles = [], line_dedup.shingles
    monkeypatch.setattr(line_dedup, "shingles", lambda some, k=line_dedup.K: cut.extend((f, k) for f in some) or shingles(some, k))
    near = line_dedup.similar_at(forms, one, two, 0.8)
    assert len(cut) == len(set(cut)) and {f for f, k in cut if k == line_dedup.K} == set(forms)
    assert near.tolist() == line_dedup.similar_pairs(forms, 0.8)[one, two].tolist() and 0 < near.sum() < len(near)


def test_lines_that_stand_once_or_twice_or_in_components(spark):
    """First occurrence and component of each; rows without id and rows that repeat whole."""
    a = "a line that stands here with a number at its end 1"
    docs = [(3, f"{a}\nonly here"), (1, f"{a[:-1]}2\ntwice"), (None, "twice\nnobody's"), (2, "twice"), (9, "own\ncopy"), (9, "own\ncopy")]
    rows = line_dedup.line_clusters(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r.k_id or 0, r.line, r.first.k_id or 0, r.first.line, r.kept) for r in rows)
    assert got == [(0, 0, 1, 1, False), (0, 1, 0, 1, True), (1, 0, 1, 0, True), (1, 1, 1, 1, True), (2, 0, 1, 1, False),
                   (3, 0, 1, 0, False), (3, 1, 3, 1, True), (9, 0, 9, 0, True), (9, 0, 9, 0, True), (9, 1, 9, 1, True), (9, 1, 9, 1, True)]
    roots = {(r.k_id, r.line): r.root for r in rows}
    assert roots[3, 0] == roots[1, 0] and roots[1, 1] == roots[2, 0] == roots[None, 0] and len(set(roots.values())) == 6
    assert all(r.root == r.id for r in rows if (r.k_id, r.line) not in {(3, 0), (1, 0)})


def test_links_become_stars_of_the_same_components():
    rng = np.random.default_rng(11)
    links = [tuple((int(x), -int(x)) for x in rng.integers(0, 300, 2)) for _ in range(200)]
    links = [(a, b) for a, b in links if a != b] + [((i, 0), (i + 1, 0)) for i in range(1000, 1100)]
    label = {x: x for e in links for x in e}
    for _ in range(len(links)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(line_dedup._stars(links)) == sorted((x, r) for x, r in label.items() if x != r)
    assert line_dedup._stars([]) == []
