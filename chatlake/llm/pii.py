"""PII: format-preserving Feistel pseudonyms.

Validated values are replaced by others of the same format: a value is mapped
to a whole number below the size of its format's domain, permuted there by a
keyed Feistel network (cycle walking keeps it inside the domain) and written
back with the same punctuation.  The network orders the domain in one cycle and a
value becomes the next one, so none stays as it is.  Equal values get equal pseudonyms in all
documents, different ones different pseudonyms, and ``invert=True`` with the
same key gives the text back.

kind    validated                                    kept
card    13 to 19 digits, Luhn check digit right      length, punctuation, a right check digit
ssn     ddd-dd-dddd outside the ranges never issued  punctuation, validity
phone   +country (area) exchange-line or in pairs, 10 to 15 digits punctuation, country code
        (area) exchange-line, area-exchange-line, 0d dd dd dd dd  punctuation, validity
ip      four numbers 0 to 255 without leading zeros  validity
date    a day of 1900 to 2099: y-m-d (also before T), form, validity, leading zeros
        d.m.y, y/m/d, m/d/y, and d/m/y where that is no m/d/y
iban    2 letters, the country's length, mod-97      country, length, right check digits, each letter a letter
email   local part @ domain with a dot               domain, each letter or digit its alphabet (``ALPHABETS``; other
                                                     characters stay, and a local part of them alone is no value)

The whole text is read.  NULL texts stay NULL.  The permutation depends on the
key alone, so tasks need no shared table and repeated runs agree.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chatlake.llm.common import extended

ROUNDS = 8
FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[^\W_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|(?:(?:\(0\))?\d{1,2}[ .-])?\d{2}(?:[ .-]\d{2}){3})(?![\w-]))"
    r"|(?P<nanp>(?<![\w+.-])(?:1[ .-])?(?:\([2-9]\d{2}\)[ -]?[2-9]\d{2}[ .-]\d{4}"
    r"|[2-9]\d{2}(?P<sep>[.-])[2-9]\d{2}(?P=sep)\d{4})(?!\w|[.-]\d))"
    r"|(?P<pairs>(?<![\w+.-])0[1-9](?P<sep2>[ .-])\d{2}(?:(?P=sep2)\d{2}){3}(?!\w|[ .-]\d))"
    r"|(?P<iso>(?<![\w.-])\d{4}-\d{2}-\d{2}(?:(?=T\d{2})|(?![\w-])))"
    r"|(?P<dmy>(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d))"
    r"|(?P<mdy>(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/]))"
    r"|(?P<ymd>(?<![\w/])\d{4}/\d{1,2}/\d{1,2}(?![\w/]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<card>(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}"
    r"|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{5})(?![A-Za-z0-9]))")
KINDS = ["email", "iban", "phone", "nanp", "pairs", "iso", "dmy", "mdy", "ymd", "ssn", "ip", "card"]
NAMES = {"iso": "date", "dmy": "date", "mdy": "date", "ymd": "date", "nanp": "phone", "pairs": "phone"}
# characters of an IBAN by country (the registry's)
IBAN = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 "
    "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}
# fixed values: size and first character of runs of letters or digits in Unicode
ALPHABETS = [(26, "a"), (26, "A"), (10, "0"), (23, "à"), (8, "ø"), (23, "À"), (7, "Ø"), (25, "α"), (32, "а"), (32, "А"),
             (86, "ぁ"), (90, "ァ"), (20_992, "一"), (11_172, "가")]
QUICK = re.compile(r"[0-9@]")


class Feistel:
    """Keyed permutation of whole numbers below ``size``."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(tweak.encode() + size.to_bytes(64, "big"), key=key).digest()

    def _round(self, i: int, x: int) -> int:
        width = (self.half + 7) // 8
        return int.from_bytes(hashlib.blake2b(bytes([i]) + x.to_bytes(width, "big"), key=self.key,
                                              digest_size=min(64, width + 8)).digest(), "big") & self.mask

    def __call__(self, x: int, invert: bool = False) -> int:
        order = range(ROUNDS - 1, -1, -1) if invert else range(ROUNDS)
        while True:
            left, right = x >> self.half, x & self.mask
            for i in order:
                if invert:
                    left, right = right ^ self._round(i, left), left
                else:
                    left, right = right, left ^ self._round(i, right)
            x = left << self.half | right
            if x < self.size:
                return x


def luhn(digits: str) -> int:
    """Check digit that makes ``digits`` + it valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _day(y: str, m: str, d: str) -> int | None:
    try:
        n = dt.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    return n if FIRST <= n <= LAST else None


def _width_class(d: dt.date) -> tuple[bool, bool]:
    return d.day > 9, d.month > 9


@lru_cache(maxsize=1)
def _days() -> dict[tuple[bool, bool], list[int]]:
    """All days by the width of day and month, so that the writing is kept."""
    out: dict = {}
    for n in range(FIRST, LAST + 1):
        out.setdefault(_width_class(dt.date.fromordinal(n)), []).append(n)
    return out


@lru_cache(maxsize=1)
def _late_days() -> dict[tuple[bool, bool], list[int]]:
    return {k: [n for n in days if dt.date.fromordinal(n).day > 12] for k, days in _days().items()}


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> tuple[int, str] | None:
    return next((a for a in ALPHABETS if 0 <= ord(c) - ord(a[1]) < a[0]), None)


@lru_cache(maxsize=1)
def _areas() -> list[int]:
    return [a for a in range(1, 900) if a != 666]


def _iban_stop(text: str, m: re.Match) -> int:
    """End of the country's length where a group ends there, else of the match."""
    left = IBAN.get(m[0][:2], 0)
    for i in range(m.start(), m.end()):
        left -= text[i] != " "
        if not left:
            return i + 1 if i + 1 == m.end() or text[i + 1] == " " else m.end()
    return m.end()


class Pseudonyms:
    def __init__(self, key: bytes, invert: bool = False):
        self.key, self.invert = hashlib.blake2b(key).digest(), invert
        self._at = lru_cache(maxsize=256)(lambda tweak, size: Feistel(self.key, tweak, size))

    def _move(self, tweak: str, size: int, x: int) -> int:
        """One step along the cycle that the Feistel permutation makes of the whole
        domain, so no value of a domain of two or more stays as it is."""
        turn = self._at(tweak, size)
        return turn((turn(x, True) + (-1 if self.invert else 1)) % size)

    def _digits(self, tweak: str, digits: str) -> str:
        return str(self._move(tweak, 10 ** len(digits), int(digits))).zfill(len(digits))

    def _shaped(self, tweak: str, local: str) -> str | None:
        """Each character of an alphabet another of it; None where there is none."""
        bases = [_alphabet(c) for c in local]
        x, size = 0, 1
        for c, b in zip(local, bases):
            if b:
                x, size = x * b[0] + ord(c) - ord(b[1]), size * b[0]
        if size < 2:
            return None
        shape = "".join(b[1] if b else c for c, b in zip(local, bases))
        x, out = self._move(f"{tweak} {shape}", size, x), []
        for c, b in zip(reversed(local), reversed(bases)):
            if b:
                x, r = divmod(x, b[0])
                c = chr(ord(b[1]) + r)
            out.append(c)
        return "".join(reversed(out))

    def email(self, v: str) -> str | None:
        local, _, domain = v.partition("@")
        new = self._shaped("email", local)
        return new and f"{new}@{domain}"

    def iban(self, v: str) -> str | None:
        flat = v.replace(" ", "")
        check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
        if not 15 <= len(flat) <= 34 or check(flat) % 97 != 1 or not 2 <= int(flat[2:4]) <= 98:
            return None
        body = flat[4:]
        body = self._digits(f"iban {flat[:2]}", body) if body.isdigit() else self._shaped(f"iban {flat[:2]}", body)
        it = iter(f"{98 - check(flat[:2] + '00' + body) % 97:02d}" + body)
        return v[:2] + "".join(c if c == " " else next(it) for c in v[2:])

    def phone(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        if not 10 <= len(digits) <= 15:
            return None
        country = re.match(r"\+(\d{1,3})", v)[1]
        if not re.match(r"\+\d{1,3}[ .(-]", v):
            country = digits[:len(digits) - 9]
        return _refill(v, country + self._digits(f"phone {country}", digits[len(country):]))

    def nanp(self, v: str) -> str:
        digits = re.sub(r"\D", "", v)
        area, exchange, line = int(digits[-10:-7]) - 200, int(digits[-7:-4]) - 200, int(digits[-4:])
        x, line = divmod(self._move("phone nanp", 800 * 800 * 10_000, (area * 800 + exchange) * 10_000 + line), 10_000)
        return _refill(v, f"{digits[:-10]}{x // 800 + 200}{x % 800 + 200}{line:04d}")

    def pairs(self, v: str) -> str:
        x = self._move("phone pairs", 9 * 10 ** 8, int(re.sub(r"\D", "", v)) - 10 ** 8)
        return _refill(v, f"0{x + 10 ** 8}")

    def _day(self, y: str, m: str, d: str, late: bool = False) -> dt.date | None:
        """``late``: stays after the 12th, so that d/m/y is never read as m/d/y."""
        n = _day(y, m, d)
        if n is None:
            return None
        kind = _width_class(dt.date.fromordinal(n))
        days = _late_days()[kind] if late else _days()[kind]
        return dt.date.fromordinal(days[self._move(f"date {'late ' * late}{kind}", len(days), bisect_left(days, n))])

    def iso(self, v: str) -> str | None:
        new = self._day(*v.split("-"))
        return new and new.isoformat()

    def _written(self, v: str, sep: str, day_first: bool) -> str | None:
        a, b, y = v.split(sep)
        new = self._day(y, b, a, late=sep == "/") if day_first else self._day(y, a, b)
        if new is None:
            return None
        x, z = (new.day, new.month) if day_first else (new.month, new.day)
        return f"{str(x).zfill(len(a))}{sep}{str(z).zfill(len(b))}{sep}{new.year:04d}"

    def dmy(self, v: str) -> str | None:
        return self._written(v, ".", True)

    def mdy(self, v: str) -> str | None:
        return self._written(v, "/", False) or self._written(v, "/", True)

    def ymd(self, v: str) -> str | None:
        y, m, d = v.split("/")
        new = self._day(y, m, d)
        return new and f"{new.year:04d}/{str(new.month).zfill(len(m))}/{str(new.day).zfill(len(d))}"

    def ssn(self, v: str) -> str | None:
        a, g, s = map(int, v.split("-"))
        if a not in _areas() or not g or not s:
            return None
        x = (_areas().index(a) * 99 + g - 1) * 9999 + s - 1
        x, s = divmod(self._move("ssn", len(_areas()) * 99 * 9999, x), 9999)
        a, g = divmod(x, 99)
        return f"{_areas()[a]:03d}-{g + 1:02d}-{s + 1:04d}"

    def ip(self, v: str) -> str | None:
        parts = v.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        x = self._move("ip", 2 ** 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def card(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = self._digits("card", digits[:-1])
        return _refill(v, body + str(luhn(body)))

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The new text and (start, stop, kind) of every replaced value in the old."""
        if not text or not QUICK.search(text):
            return text, []
        out, found, at = [], [], 0
        m = PATTERN.search(text)
        while m:
            kind, stop = next(k for k in KINDS if m[k] is not None), m.end()
            if kind == "iban":  # what follows may look like a further group
                stop = _iban_stop(text, m)
            new = getattr(self, kind)(text[m.start():stop])
            if new is not None:
                out += [text[at:m.start()], new]
                at = stop
                found.append((m.start(), stop, NAMES.get(kind, kind)))
            elif kind == "iban":  # other values may stand in its groups
                stop = m.start() + 4
            m = PATTERN.search(text, stop)
        return "".join([*out, text[at:]]), found


def pseudonymize(docs: DataFrame, key: str, invert: bool = False) -> DataFrame:
    """``docs`` with new texts, and n_pii, pii_kinds (distinct, sorted,
    comma-joined) and pii_spans (in the old text).  n_chars, where present, is
    kept up to date by the writer of the texts, as their lengths may change."""
    added = [T.StructField("n_pii", T.LongType()), T.StructField("pii_kinds", T.StringType()),
             T.StructField("pii_spans", T.ArrayType(T.StructType([
                 T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
                 T.StructField("kind", T.StringType())])))]
    kept, schema = extended(docs, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Pseudonyms(key.encode(), invert)
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            done = [maker.replace(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([t for t, _ in done], b.schema.field("text").type) if n == "text" else c
                    for n, c in zip(b.schema.names, b.columns)]
            yield pa.RecordBatch.from_arrays([
                *cols, pa.array([len(f) for _, f in done], pa.int64()),
                pa.array([",".join(sorted({k for _, _, k in f})) for _, f in done], pa.string()),
                pa.array([[dict(zip(("start", "stop", "kind"), x)) for x in f] for _, f in done], span)], names=schema.names)

    return kept.mapInArrow(run, schema)
