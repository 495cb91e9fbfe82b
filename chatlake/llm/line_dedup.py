"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard
verification and distributed union-find, keeping one line per component.

A text is cut at line feeds.  Lines are compared in a normalised form (white
space runs become one blank, outer blanks go, lower case); only blank lines
(those of fewer than ``min_chars`` characters, by default 1) take no part and
always stay.  Lines of equal form are one line; two different ones are linked if the Jaccard similarity of
their sets of ``K``-character shingles is at least ``threshold``.  One changed
letter costs up to K shingles on each side, too many for a short line, so two
lines of SHORT characters (40 to 159) are also linked if the similarity of
their sets of SHORT_K-character shingles is at least what one changed word of
five letters leaves: (m - 9) / (m + 9) for m shingles, but 0.6 or more, and never
more than ``threshold``.  Below 40 characters one word is too much of a line
("part 11" and "part 12"): there ``threshold`` holds.  Of every
component the first occurrence stays, by doc_id, then hash of the text, then
line number; all others are removed from their documents.

1. One pass over the texts gives a row per line: two 64-bit hashes of the form,
   its band keys (``_bands``).  A task gives the keys of a form once: they
   are the same for its repeats, which have their rows without keys.
2. Keys of two lines or more are found: sorted ranges of keys (``_shared_keys``),
   to which a task gives two lines of a key at most; only these keys are joined back
   to their lines, by a broadcast where they are few.  A key held by several lines is a bucket; buckets with the same members are compared once (two near copies
   meet in most bands).
3. Only lines in a bucket fetch their text.  A group holds one bucket, or one
   pair of chunks of a bucket beyond ``CHUNK`` lines.  Groups stream, sorted,
   through a task, which counts the shared shingles of all pairs of a group as
   one matrix product and returns a spanning forest of the pairs at or above
   the threshold, never all pairs; of small groups, the pairs of many in one sort.
4. Components by ``components``; the first occurrence of each is found with
   partial aggregation, so a line repeated in a third of the documents is no
   hot group.

With 12 bands of 4 values a pair at similarity 0.8 meets with probability
0.998, one at 0.9 with 0.999997.
SHORT lines have 36 (40 characters) to 12 (from 77) bands of 4 values: a pair at
the similarity asked of its length meets with probability 0.993 or more.

A document whose lines are all removed stays, with an empty text.  Rows that
repeat doc_id and text are one document and keep the same lines.  NULL texts
have no line and stay NULL.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import saved
from chatlake.llm.components import components
from chatlake.session import shuffle_partitions

K = 8              # characters in a shingle
BANDS, ROWS = 12, 4
SHORT = range(40, 160)  # characters of lines that are also compared by shorter shingles
SHORT_K, SHORT_BANDS, SHORT_LEAST = 5, 36, 0.6
TIERS = (12, 14, 16, 20, 24, 30, SHORT_BANDS)  # bands computed at once for SHORT lines of alike length
MISSED = 0.007     # share of SHORT pairs at the similarity asked that may not meet
WORD = 9           # SHORT_K-character shingles that a word of five letters is in
MIN_CHARS = 1      # blank lines alone take no part
THRESHOLD = 0.8
CHUNK = 256        # lines on one side of a verification group
SEEN = 1 << 18     # line hashes a task remembers, to give keys once
FEW_LINES = 1_000_000  # line hashes that may be broadcast (8 bytes each)
FEW, PAIRS = 8, 1024  # lines of a small group; pairs compared in one sort
KEYS, RANGE = 1 << 20, 1 << 17  # keys that a task sorts at once; keys in a range of them, about
HELD = 1 << 23     # characters of small groups' lines held at once
COLUMNS = 8192     # shingles of a group multiplied at once
PART = 1 << 16     # characters of lines signed at once (fits the cache)
_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(0, 1 << 31, max(BANDS, SHORT_BANDS) * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FOLD = _rng.integers(0, 1 << 63, max(BANDS, SHORT_BANDS) * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SPACES = [c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n"]
_ASCII_SPACES = [c for c in _SPACES if c.isascii()]


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else text.split("\n")


def forms_of(text: str | None) -> list[str]:
    """``normal`` of every line; at once for a text whose only white space is single
    blanks within lines (lower case looks at a letter's word, never beyond a line)."""
    if text is None:
        return []
    if ("  " in text or " \n" in text or "\n " in text or text.startswith(" ") or text.endswith(" ")
            or any(c in text for c in (_ASCII_SPACES if text.isascii() else _SPACES))):
        return [normal(x) for x in lines_of(text)]
    return lines_of(text.lower())


def _mix(x: np.ndarray, moved: np.ndarray | None = None) -> np.ndarray:
    moved = np.empty_like(x) if moved is None else moved
    x ^= np.right_shift(x, np.uint64(32), out=moved)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= np.right_shift(x, np.uint64(32), out=moved)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= np.right_shift(x, np.uint64(32), out=moved)
    return x


def shingles(forms: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-character shingles (k from 5 to 8) of the lines,
    one line after the other, and each line's first index.  A line shorter than
    k is padded and gives one."""
    padded = [f if len(f) >= k else f.ljust(k, "\0") for f in forms]
    units = "".join(padded).encode("utf-16-le", "surrogatepass")
    n = np.array([len(f) for f in padded])
    if len(units) != 2 * n.sum():  # characters of two units
        each = [f.encode("utf-16-le", "surrogatepass") for f in forms]
        each = [u if len(u) >= 2 * k else u.ljust(2 * k, b"\0") for u in each]
        units, n = b"".join(each), np.array([len(x) // 2 for x in each])
    four = np.ndarray(len(units) // 2 - 3, "<u8", units, strides=(2,)).astype(np.uint64)  # at every character, four
    last = four[k - 4:]  # the last four characters; with the first four they are all
    h = last >> np.uint64(29)
    h ^= last
    h *= np.uint64(0xBF58476D1CE4E5B9)
    first = four[:len(last)]
    first *= np.uint64(0x9E3779B97F4A7C15)
    h += first
    _mix(h, first)
    ends = np.cumsum(n)
    keep = np.ones(len(units) // 2, bool)
    for back in range(1, k):
        keep[ends - back] = False  # shingles that would reach into the next line
    starts = np.r_[0, np.cumsum(n - k + 1)[:-1]]
    return h[keep[:len(h)]], starts


def band_keys(forms: list[str], k: int = K, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit keys of every line (lines x bands)."""
    h, starts = shingles(forms, k)
    low = (h >> np.uint64(32)).astype(np.uint32)
    moved = np.empty_like(low)
    least = np.empty((bands * rows, len(forms)), np.uint32)
    for i in range(bands * rows):
        np.minimum.reduceat(np.multiply(low, FACTORS[i], out=moved), starts, out=least[i])
    keys = np.zeros((bands, len(forms)), np.uint64)
    for r in range(rows):
        keys ^= least[r::rows]
        keys *= FOLD[r:bands * rows:rows, None]
    keys += (np.arange(bands, dtype=np.uint64)[:, None] + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(keys).T


def _least(m: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Similarity asked of two SHORT lines, the larger set having m shingles."""
    return np.minimum(np.maximum((m - WORD) / (m + WORD), SHORT_LEAST), threshold)


def _bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands of K and of SHORT_K characters for lines of n characters.  The
    longer line of a pair has the fewer SHORT_K bands, enough for the similarity
    asked of its length.  A line of fewer than four shingles (two 16-bit units a
    character at most) is linked only to an equal set: one band."""
    k = np.where(2 * n < K + 3, 1, BANDS)
    s = np.ceil(np.log(MISSED) / np.log1p(-_least(n - SHORT_K + 1.0) ** ROWS)).clip(BANDS, SHORT_BANDS).astype(int)
    return k, np.where((n >= SHORT[0]) & (n <= SHORT[-1]), s, 0)


def line_keys(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the lines, one line after the other, and their number by line."""
    keys = np.zeros((len(forms), BANDS + SHORT_BANDS), np.uint64)
    k, s = _bands(np.array([len(f) for f in forms]))
    def fill(some, at, shingle, bands):
        for i, j in _parts(len(forms[x]) for x in some):
            keys[some[i:j], at:at + bands] = band_keys([forms[x] for x in some[i:j]], shingle, bands)

    fill(np.flatnonzero(k), 0, K, BANDS)
    for low, high in zip((0, *TIERS), TIERS):              # not more bands than lines of that length need
        fill(np.flatnonzero((s > low) & (s <= high)), BANDS, SHORT_K, high)
    has = np.c_[np.arange(BANDS) < k[:, None], np.arange(SHORT_BANDS) < s[:, None]]
    return keys[has], has.sum(1)


def _shared(forms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that each two lines share, and the sizes of the lines' shingle sets."""
    h, starts = shingles(forms, k)
    bits = np.uint64(len(forms).bit_length())              # below the hash's upper bits stands the line
    x = np.repeat(np.arange(len(forms), dtype=np.uint64), np.diff(np.r_[starts, len(h)]))
    x |= h >> bits << bits
    x = _once(x)                                           # a set holds a shingle once
    owner = (x & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    x >>= bits
    code = np.cumsum(np.r_[True, x[1:] != x[:-1]]) - 1
    size = np.bincount(owner, minlength=len(forms)).astype(np.float32)
    both = np.zeros((len(forms), len(forms)), np.float32)
    for s in range(0, int(code[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(code, [s, s + COLUMNS])
        m = np.zeros((len(forms), COLUMNS if b < len(code) else int(code[-1]) + 1 - s), np.float32)
        m[owner[a:b], code[a:b] - s] = 1
        both += m @ m.T
    return both, size


def _at_least(both: np.ndarray, size: np.ndarray, threshold) -> np.ndarray:
    return both >= np.asarray(threshold, np.float32) * (size[:, None] + size[None, :] - both) - 1e-4


def similar_pairs(forms: list[str], threshold: float) -> np.ndarray:
    """Boolean matrix: exact Jaccard similarity of the lines' shingle sets, for
    two SHORT lines also of their sets of shorter shingles."""
    near = _at_least(*_shared(forms, K), threshold)
    short = np.flatnonzero([len(f) in SHORT for f in forms])
    if len(short) > 1:
        both, size = _shared([forms[i] for i in short], SHORT_K)
        m = np.maximum(size[:, None], size[None, :])
        near[np.ix_(short, short)] |= _at_least(both, size, _least(m, threshold))
    return near


def _once(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]]


def _sets(forms: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """54 bits of the shingles' hashes, each once a line, one line after the other;
    each line's first index and number."""
    found, size = [], []
    for i, j in _parts((max(len(f), PART // PAIRS) for f in forms)):  # PAIRS lines at most
        h, starts = shingles(forms[i:j], k)
        x = np.repeat(np.arange(j - i, dtype=np.uint64) << np.uint64(54), np.diff(np.r_[starts, len(h)]))
        x |= h >> np.uint64(10)
        x = _once(x)
        size.append(np.diff(np.searchsorted(x, np.arange(j - i, dtype=np.uint64) << np.uint64(54)), append=len(x)))
        found.append(x & np.uint64((1 << 54) - 1))
    size = np.concatenate(size)
    return np.concatenate(found), np.cumsum(size) - size, size


def similar_at(forms: list[str], one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    """The rule of ``similar_pairs`` for each pair of lines one[p] and two[p]."""
    def at_least(k, some, asked):
        """Pairs ``some``, whose lines are cut into shingles once however many pairs they are in."""
        lines, at = np.unique(np.r_[one[some], two[some]], return_inverse=True)
        h, start, size = _sets([forms[i] for i in lines], k)
        a, b = at[:len(some)], at[len(some):]
        low, most = np.minimum(size[a], size[b]).astype(np.float32), np.maximum(size[a], size[b]).astype(np.float32)
        asked = np.broadcast_to(np.asarray(asked(most), np.float32), most.shape)
        near = low >= asked * most - 1e-4                  # else not even if one set were within the other
        left = np.flatnonzero(near)
        for i, j in _parts((int(n) for n in np.maximum(low + most, PART // PAIRS)[left])):  # PAIRS pairs at most
            p = left[i:j]
            ends = np.c_[a[p], b[p]].ravel()
            n = size[ends]
            x = h[np.arange(n.sum()) + np.repeat(start[ends] - (np.cumsum(n) - n), n)]
            x |= np.repeat(np.arange(len(p), dtype=np.uint64) << np.uint64(54), n[::2] + n[1::2])
            x.sort()
            both = np.bincount((x[1:][x[1:] == x[:-1]] >> np.uint64(54)).astype(np.int64), minlength=len(p)).astype(np.float32)
            near[p] = both >= asked[p] * (low[p] + most[p] - both) - 1e-4
        return near

    near = at_least(K, np.arange(len(one)), lambda m: threshold)
    n = np.array([len(f) in SHORT for f in forms])
    short = np.flatnonzero(n[one] & n[two] & ~near)
    if len(short):
        near[short] = at_least(SHORT_K, short, lambda m: _least(m, threshold))
    return near


def similar_two(forms: list[str], threshold: float) -> np.ndarray:
    """The rule of ``similar_pairs`` for lines 2p and 2p + 1, all pairs at once."""
    at = np.arange(0, len(forms), 2)
    return similar_at(forms, at, at + 1, threshold)


def _parts(sizes, part: int = PART):
    """Slices whose sizes (characters) are about ``part`` in sum."""
    at = size = end = 0
    for end, n in enumerate(sizes, 1):
        size += n
        if size >= part:
            yield at, end
            at, size = end, 0
    if at < end:
        yield at, end


def _hash128(form: str) -> bytes:
    return xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass"))


def _line_rows(docs: DataFrame, min_chars: int, with_text: bool) -> DataFrame:
    """A row per line that takes part: document key, line number, two hashes
    and the keys (none where the task gave them before), or (``with_text``)
    hashes and the normalised line, repeats left out within a task."""
    fields = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
    if with_text:
        fields.append(T.StructField("form", T.StringType()))
    else:
        fields = [T.StructField("k_id", docs.schema["doc_id"].dataType), T.StructField("k_text", T.LongType()),
                  T.StructField("k_len", T.IntegerType()), T.StructField("line", T.IntegerType()), *fields,
                  T.StructField("keys", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields)

    def halves(hashes):
        both = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
        return [pa.array(both[:, 0]), pa.array(both[:, 1])]

    def run(batches):
        seen = set()  # forms whose keys or text this task has given
        for b in batches:
            forms, lines = [], []
            for text in b.column("text").to_pylist():
                own = forms_of(text)
                forms += own
                lines.append(len(own))
            size = np.array([len(f) for f in forms], np.int64)
            part = np.flatnonzero(size >= min_chars)
            row = np.repeat(np.arange(len(lines)), lines)[part]
            number = part - (np.cumsum(lines) - lines)[row]
            forms = [forms[i] for i in part]
            for s, e in _parts(size[part].tolist(), 64 * PART):
                h = [_hash128(f) for f in forms[s:e]]
                first = []
                for i, x in enumerate(h):
                    if x not in seen:
                        seen.add(x)
                        first.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                new = [forms[s + i] for i in first]
                if with_text:
                    h = [h[i] for i in first]
                out = halves(h)
                if with_text:
                    out.append(pa.array(new, pa.string()))
                else:
                    n = np.zeros(e - s, np.int64)
                    keys, n[first] = line_keys(new) if new else (np.zeros(0, np.uint64), 0)
                    of = pa.array(row[s:e])
                    out = [b.column("k_id").take(of), b.column("k_text").take(of), b.column("k_len").take(of),
                           pa.array(number[s:e], pa.int32()), *out,
                           pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, schema=None, names=schema.names)

    key = [] if with_text else [F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text"),
                                F.length("text").alias("k_len")]
    return docs.select(*key, "text").mapInArrow(run, schema)


def _forest(side: np.ndarray, forms: list[str], ci: int, cj: int, threshold: float) -> list[tuple[int, int]]:
    """Spanning forest of the similar pairs between chunk ci and chunk cj."""
    near = similar_pairs(forms, threshold)
    if ci != cj:
        near &= (side[:, None] == ci) & (side[None, :] == cj)
    label, out = np.arange(len(forms)), []
    for i, j in zip(*np.nonzero(np.triu(near, 1) if ci == cj else near)):
        if label[i] != label[j]:
            out.append((int(i), int(j)))
            label[label == label[j]] = label[i]
    return out


def _stars(links: list[tuple]) -> list[tuple]:
    """The same components with fewer links and short ways: every line and the
    smallest one that it hangs together with."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(up) if up[x] != x]


def _edges(groups: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b), structs of two hashes, of the groups' lines.  The pairs of many
    small groups are compared in one go, a larger group's as one matrix."""
    names = ["bucket", "ci", "cj"]

    def run(batches):
        key, rows = None, []           # (id, form, chunk) of the group that is being read
        at, forms, pairs, found = {}, [], set(), []
        held = 0

        def finish():
            nonlocal held
            if len(rows) < 2:
                return
            if len(rows) <= FEW and key[1] == key[2]:
                here = []
                for i, x, _ in rows:
                    here.append(at.setdefault(i, len(forms)))
                    if here[-1] == len(forms):
                        forms.append(x)
                        held += len(x)
                pairs.update(combinations(sorted(here), 2))
            else:
                side = np.array([r[2] for r in rows])
                found.extend((rows[i][0], rows[j][0]) for i, j in _forest(side, [r[1] for r in rows], key[1], key[2], threshold))

        def compare():
            nonlocal held
            if pairs:
                ids = list(at)
                one, two = np.array(list(pairs)).T
                near = similar_at(forms, one, two, threshold)
                found.extend((ids[i], ids[j]) for i, j in zip(one[near].tolist(), two[near].tolist()))
            out = batch(_stars(found))
            for x in (at, forms, pairs, found):
                x.clear()
            held = 0
            return out

        for b in batches:
            cols = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}
            for k, h1, h2, form, c in zip(zip(*(cols[n] for n in names)), cols["h1"], cols["h2"], cols["form"], cols["c"]):
                if k != key:
                    finish()
                    key, rows = k, []
                    if held > HELD:
                        yield compare()
                rows.append(((h1, h2), form, c))
            yield compare()
        finish()
        yield compare()

    def batch(found):
        side = lambda i: pa.StructArray.from_arrays([pa.array([e[i][j] for e in found], pa.int64()) for j in (0, 1)], ["h1", "h2"])
        return pa.RecordBatch.from_arrays([side(0), side(1)], names=["a", "b"])

    return (groups.repartition(*names).sortWithinPartitions(*names)
            .mapInArrow(run, "a struct<h1:long,h2:long>, b struct<h1:long,h2:long>"))


def _shared_keys(rows: DataFrame) -> DataFrame:
    """Keys of two lines or more, each once.  A line that occurs often shares its keys
    with itself: only other lines count.  Keys travel as arrays, a range of keys each;
    from KEYS keys at once at most two lines of a key go on."""
    ranges = rows.count() * BANDS // RANGE + 1
    tasks = min(ranges, shuffle_partitions(rows.sparkSession))
    ranges = -(-ranges // tasks) * tasks                   # as many for each task

    def ordered(key, line):
        """Sorted by key; which ones are of another key than the one before, and which of another line with the same key."""
        order = np.argsort(key)
        key, line = key[order], line[order]
        new = np.r_[True, key[1:] != key[:-1]]
        return key, line, new, ~new & np.r_[False, line[1:] != line[:-1]]

    def deal(batches):
        def out():
            key, line, new, other = ordered(np.concatenate(keys), np.concatenate(lines))
            at = np.flatnonzero(other)
            new[at[np.r_[True, key[at[1:]] != key[at[:-1]]]] if len(at) else at] = True  # the first of another line
            key, line = key[new], line[new]
            own, first = np.unique((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), return_index=True)
            ends = pa.array(np.r_[first, len(key)], pa.int32())
            cols = [pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))) for x in (key, line)]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *cols], names=["part", "key", "line"])

        keys, lines, n = [], [], 0
        for b in batches:
            each = b.column("keys")
            keys.append(each.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            lines.append(np.repeat(b.column("h1").to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(each).to_numpy(zero_copy_only=False)))
            n += len(keys[-1])
            if n >= KEYS:
                yield out()
                keys, lines, n = [], [], 0
        if n:
            yield out()

    def meet(batches):
        def out():
            key, _, _, other = ordered(np.concatenate(keys), np.concatenate(lines))
            return pa.RecordBatch.from_arrays([pa.array(np.unique(key[other]).view(np.int64))], names=["key"])

        part, keys, lines = None, [], []
        for b in batches:
            for i, own in enumerate(b.column("part").to_pylist()):
                if own != part and keys:
                    yield out()
                    keys, lines = [], []
                part = own
                keys.append(b.column("key")[i].values.to_numpy().view(np.uint64))
                lines.append(b.column("line")[i].values.to_numpy().view(np.uint64))
            keys, lines = [np.concatenate(keys)], [np.concatenate(lines)]  # the batch goes
        if keys:
            yield out()

    dealt = rows.select("h1", "keys").mapInArrow(deal, "part int, key array<long>, line array<long>")
    return dealt.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part").mapInArrow(meet, "key long")


def _groups(rows: DataFrame, docs: DataFrame, min_chars: int, chunk: int) -> DataFrame:
    """bucket, ci, cj, c, h1, h2, form: the lines of every group to verify."""
    keyed = rows.select("h1", F.explode("keys").alias("key"))
    shared = saved(_shared_keys(rows), "line-shared")
    few = shared.count() <= FEW_LINES
    cand = saved(keyed.join(F.broadcast(shared) if few else shared.hint("shuffle_hash"), "key").distinct(), "line-candidates")
    buckets = (cand.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("h1").alias("x"),
                                       F.bit_xor(F.xxhash64("h1")).alias("y"))
               .where("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("bucket"))
               .select("bucket", F.ceil(F.col("m") / chunk).cast("int").alias("parts")))
    members = saved(cand.join(buckets, F.col("key") == F.col("bucket")).select(
        "bucket", "h1", "parts", F.pmod(F.xxhash64(F.lit(7), "h1"), F.col("parts")).cast("int").alias("c")), "line-members")
    wanted = members.select(F.col("h1").alias("w")).distinct()
    few = wanted.limit(FEW_LINES + 1).count() <= FEW_LINES
    forms = _line_rows(docs, min_chars, with_text=True).join(
        F.broadcast(wanted) if few else wanted, F.col("h1") == F.col("w"), "left_semi").dropDuplicates(["h1", "h2"])
    spread = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select("bucket", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"), "c", "h1").join(forms, "h1")


def line_clusters(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS,
                  chunk: int = CHUNK) -> DataFrame:
    """A row per line that takes part: k_id, k_text, k_len, line, id (the line's
    hashes), root (its component), first (the kept occurrence) and kept."""
    rows = saved(_line_rows(docs, min_chars, with_text=False), "lines")
    comp = components(_edges(_groups(rows, docs, min_chars, chunk), threshold))
    lines = rows.select("k_id", "k_text", "k_len", "line", F.struct("h1", "h2").alias("id"))
    at = F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "k_text", "k_len", "line")
    # a line that stands once and is in no component is its own first and root
    heads = saved(lines.groupBy("id").agg(F.count("*").alias("n"), F.min(at).alias("first"))
                  .join(comp, F.col("id") == F.col("node"), "left").where("n > 1 or node is not null")
                  .select(F.col("id").alias("of"), "node", F.coalesce("root", "id").alias("head"), "first"), "line-heads")
    # grouped by a struct: the join back shuffles both sides by itself, a large component's lines can be split there
    best = heads.where("node is not null").groupBy(F.struct("head").alias("g")).agg(F.min("first").alias("best")).select(
        F.col("g.head").alias("best_head"), "best")
    named = heads.join(best, F.col("head") == F.col("best_head"), "left").select(
        "of", "head", F.coalesce("best", "first").alias("first"))
    out = lines.join(named.hint("shuffle_hash"), F.col("id") == F.col("of"), "left").select(
        "k_id", "k_text", "k_len", "line", "id", F.coalesce("head", "id").alias("root"), F.coalesce("first", at).alias("first"))
    return out.withColumn("kept", at.eqNullSafe(F.col("first")))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their repeated lines; n_chars, where present, is
    the new text's length."""
    gone = (line_clusters(docs, threshold, min_chars).where(~F.col("kept"))
            .select("k_id", "k_text", "k_len", "line").distinct()
            .groupBy("k_id", "k_text", "k_len").agg(F.collect_set("line").alias("gone")))
    cond = (F.col("d.doc_id").eqNullSafe(F.col("g.k_id")) & F.xxhash64("d.text").eqNullSafe(F.col("g.k_text"))
            & F.length("d.text").eqNullSafe(F.col("g.k_len")))
    left = docs.alias("d").join(gone.alias("g"), cond, "left")
    kept = F.array_join(F.transform(
        F.filter(F.arrays_zip(F.split("d.text", "\n").alias("l"), F.sequence(F.lit(0), F.size(F.split("d.text", "\n")) - 1).alias("i")),
                 lambda x: ~F.array_contains("g.gone", x["i"])), lambda x: x["l"]), "\n")
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(kept)
    cols = []
    for c in docs.columns:
        col = text if c == "text" else F.col(f"d.`{c}`")
        if c == "n_chars":
            col = F.when(F.col("g.gone").isNull(), F.col("d.n_chars")).otherwise(
                F.length(text)).cast(docs.schema["n_chars"].dataType)
        cols.append(col.alias(c))
    return left.select(*cols)
