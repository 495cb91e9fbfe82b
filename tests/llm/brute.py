"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter
from itertools import combinations

import xxhash

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def contamination(text, items, size=13, ratio=20):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        grams = [iw[i:i + size] for i in range(max(1, len(iw) - size + 1))] if iw else []
        for g in grams:
            for p in range(len(w) - len(g) + 1):
                if w[p:p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    found.add("" if item is None else str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), sha, bool(hit) and ratio * len(hit) >= len(w)


def base_places(text, base):
    w, out = words(text), []
    for label, phrase in base:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), sorted(out)


def simhash(text, k=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_prints(prints, radius=3):
    return union(len(prints), [(i, j) for (i, a), (j, b) in combinations(enumerate(prints), 2)
                               if (a ^ b).bit_count() <= radius])


def shingle_sets(forms, k):
    return [{f[i:i + k] for i in range(max(1, len(f) - k + 1))} for f in forms]


def similar_lines(forms, threshold=0.8):
    """Component of every line form: Jaccard similarity of the sets of 8-character
    shingles, and for two lines of 40 to 159 characters of 5-character ones, with
    a threshold that follows the larger set."""
    long, short = shingle_sets(forms, 8), shingle_sets(forms, 5)
    pairs = []
    for i, j in combinations(range(len(forms)), 2):
        a, b = long[i], long[j]
        near = min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b)
        if not near and 40 <= len(forms[i]) < 160 and 40 <= len(forms[j]) < 160:
            a, b = short[i], short[j]
            m = max(len(a), len(b))
            asked = min(max((m - 9) / (m + 9), 0.6), threshold)
            near = min(len(a), len(b)) >= asked * m and len(a & b) >= asked * len(a | b) - 1e-4
        if near:
            pairs.append((i, j))
    return union(len(forms), pairs)


def line_components(docs):
    """{(doc_id, line): (component, kept)} of every line that is not blank; docs:
    (doc_id, text) with distinct ids."""
    occ = [(d, n, " ".join(x.split()).lower()) for d, t in sorted(docs) if t is not None for n, x in enumerate(t.split("\n"))]
    occ = [o for o in occ if o[2]]
    forms = sorted({o[2] for o in occ})
    comp, seen, out = dict(zip(forms, similar_lines(forms))), set(), {}
    for d, n, f in occ:
        out[d, n] = comp[f], comp[f] not in seen
        seen.add(comp[f])
    return out


def dedup_lines(docs):
    """docs: (doc_id, text) with distinct ids; the texts without repeated lines."""
    part = line_components(docs)
    return [(d, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if part.get((d, n), (0, True))[1]))
            for d, t in docs]


def edf_slots(weights):
    """{(source, block of the period): slot} by earliest deadline first."""
    p = sum(weights.values())
    wait = [(-(-(i + 1) * p // a), s, i, i * p // a) for s, a in weights.items() for i in range(a)]
    out = {}
    for t in range(p):
        best = min(b for b in wait if b[3] <= t)
        wait.remove(best)
        out[best[1], best[2]] = t
    return out, p


def mix(docs, weights, default=1, block=8):
    """docs: (doc_id, source); returns {doc_id: (block, pos, slot)}."""
    by = {}
    for d, s in docs:
        by.setdefault(s, []).append(d)
    w = {s: weights.get(s, default) for s in by}
    slots, p = edf_slots(w)
    out = {}
    for s, ids in by.items():
        for k, d in enumerate(sorted(ids, key=lambda x: hashlib.md5(str(x).encode()).hexdigest())):
            b = k // block
            out[d] = (b, k % block, b // w[s] * p + slots[s, b % w[s]])
    return out


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lexical(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text); rows (item_id, rank, doc_id, score)."""
    words_of = [(d, TERMS.findall((t or "").translate(LOWER))) for d, t in docs]
    words_of = [(d, w) for d, w in words_of if w]
    n, total = len(words_of), sum(len(w) for _, w in words_of)
    counts = [(d, len(w), Counter(w)) for d, w in words_of]
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        asked = Counter(TERMS.findall((text or "").translate(LOWER)))
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, _, c in counts) + 1))) for t in asked}
        for d, length, c in counts:
            m = 25 + 75 * length * n // total
            s = sum(times * weights[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def periodic(w, least=24, times=3):
    """Runs (start, length, period) of a list of words."""
    found, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def repeated(doc_id, words):
    """The words that the contract of op13 makes of a document's."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]


def nearest(rows, queries, k=5):
    """rows: (vec_id, vector) of one length; {(query_id, vector): [(vec_id, cosine)]}."""
    out = {}
    for q, x in queries:
        scored = [(-sum(a * b for a, b in zip(x, y)) / (math.hypot(*x) * math.hypot(*y)), v) for v, y in rows if v != q]
        out[q] = [(v, -s) for s, v in sorted(scored)[:k]]
    return out
