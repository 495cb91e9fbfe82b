"""Time column expressions (SRC11, FN5-7) and the since parser (FLT5).

Every expression here is independent of the session time zone: days are
computed from epoch arithmetic after an explicit zone shift, so results do
not change when a cluster runs with a different default zone.
"""

from __future__ import annotations

import datetime as _dt
import re
import time as _time

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_MIN = 60_000
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000
MS_PER_WEEK = 604_800_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_to_ms(col) -> Column:
    """SRC11: ISO-8601 text -> epoch ms; junk or NULL -> NULL."""
    return F.unix_millis(F.try_to_timestamp(_c(col)))


def local_day_number(ms_col, tz: str = "UTC") -> Column:
    """Days since 1970-01-01 of the wall-clock date in ``tz``."""
    ms = _c(ms_col)
    if tz.upper() != "UTC":
        ms = F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), tz))
    return F.floor(ms / F.lit(MS_PER_DAY)).cast("int")


def day_of_ms(ms_col, tz: str = "UTC") -> Column:
    """FN5: epoch ms -> 'yyyy-MM-dd' (string) in ``tz``."""
    return F.date_from_unix_date(local_day_number(ms_col, tz)).cast("string")


def day_of_iso(col, tz: str = "UTC") -> Column:
    """FN6: ISO text -> 'yyyy-MM-dd'."""
    return day_of_ms(iso_to_ms(col), tz)


def ago(ms_col, now_ms: int, long: bool = False) -> Column:
    """FN7: '5m', '3h', '2d' (or '... ago'); NULL or 0 -> ''."""
    ms = _c(ms_col)
    mins = F.floor((F.lit(now_ms) - ms) / F.lit(MS_PER_MIN))
    hours = F.floor(mins / 60)
    days = F.floor(hours / 24)
    suffix = " ago" if long else ""
    txt = (F.when(mins < 60, F.concat(mins.cast("string"), F.lit("m" + suffix)))
           .when(hours < 24, F.concat(hours.cast("string"), F.lit("h" + suffix)))
           .otherwise(F.concat(days.cast("string"), F.lit("d" + suffix))))
    if long:
        return txt
    return F.when(ms.isNull() | (ms == 0), F.lit("")).otherwise(txt)


_REL = re.compile(r"^(\d+)([mhdw])$")
_UNIT_MS = {"m": MS_PER_MIN, "h": MS_PER_HOUR, "d": MS_PER_DAY, "w": MS_PER_WEEK}


def parse_since(value: str, now_ms: int | None = None, tz: str = "UTC") -> int | None:
    """FLT5: '30m', '2h', '3d', '1w', 'today', 'yesterday', a date
    ('2025-07-04', '2025-07', 'Jul 4 2025') -> ms.

    Returns None for text it cannot read.  ``now_ms`` and ``tz`` are
    injectable so results are reproducible.
    """
    from zoneinfo import ZoneInfo

    if now_ms is None:
        now_ms = int(_time.time() * 1000)
    zone = ZoneInfo(tz)
    lower = value.strip().lower()
    now = _dt.datetime.fromtimestamp(now_ms / 1000, zone)
    if lower in ("today", "yesterday"):
        midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
        if lower == "yesterday":
            midnight = (midnight - _dt.timedelta(days=1)).replace(tzinfo=None)
            midnight = midnight.replace(tzinfo=zone)
        return int(midnight.timestamp() * 1000)
    m = _REL.match(lower)
    if m:
        return now_ms - int(m.group(1)) * _UNIT_MS[m.group(2)]
    # Date-only text is midnight UTC, text with a time uses ``tz``.
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", lower):
            d = _dt.datetime.strptime(lower, "%Y-%m-%d").replace(tzinfo=_dt.timezone.utc)
            return int(d.timestamp() * 1000)
        if re.fullmatch(r"\d{4}-\d{2}", lower):
            d = _dt.datetime.strptime(lower, "%Y-%m").replace(tzinfo=_dt.timezone.utc)
            return int(d.timestamp() * 1000)
        for form in ("%b %d %Y", "%B %d %Y", "%d %b %Y", "%d %B %Y"):
            try:
                d = _dt.datetime.strptime(" ".join(lower.replace(",", " ").split()), form)
                return int(d.replace(tzinfo=zone).timestamp() * 1000)
            except ValueError:
                continue
        d = _dt.datetime.fromisoformat(lower.upper().replace("Z", "+00:00"))
        if d.tzinfo is None:
            d = d.replace(tzinfo=zone)
        return int(d.timestamp() * 1000)
    except ValueError:
        return None


# English month names and their numbers.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _ntz_ms(text: Column, tz: str) -> Column:
    """Local date or time text in zone ``tz`` -> epoch ms, whatever the session's zone; NULL
    for other text."""
    local = text.try_cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), local)
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)


def since_ms(value, now_ms, tz: str = "UTC") -> Column:
    """FLT5 as a column: the epoch ms of a time expression per row, by the rules of
    ``parse_since``; NULL where it can't be read.  ``now_ms``: a number or a Column."""
    v = F.lower(F.trim(F.col(value) if isinstance(value, str) else value))
    now = now_ms if isinstance(now_ms, Column) else F.lit(int(now_ms))
    number = F.regexp_extract(v, r"^(\d+)[mhdw]$", 1).try_cast("bigint")
    unit = F.right(v, F.lit(1))
    step = F.when(unit == "m", MS_PER_MIN).when(unit == "h", MS_PER_HOUR).when(unit == "d", MS_PER_DAY).otherwise(MS_PER_WEEK)
    today = day_of_ms(now, tz).try_cast("date")
    words = F.split(F.trim(F.regexp_replace(v, r"[,\s]+", " ")), " ")
    month = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for n in {m, m[:3]} for x in (F.lit(n), F.lit(i))])

    def named(day, name):
        parts = [F.get(words, F.lit(2)), F.lpad(F.try_element_at(month, F.get(words, F.lit(name))).cast("string"), 2, "0"),
                 F.lpad(F.get(words, F.lit(day)), 2, "0")]
        return F.when(F.size(words) == 3, F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2]))

    date = r"^\d{4}-\d{2}-\d{2}$"
    return (F.when(v == "today", _ntz_ms(today.cast("string"), tz))
            .when(v == "yesterday", _ntz_ms(F.date_sub(today, 1).cast("string"), tz))
            .when(v.rlike(r"^\d+[mhdw]$"), now - number * step)
            .when(v.rlike(date), _ntz_ms(v, "UTC"))
            .when(v.rlike(r"^\d{4}-\d{2}$"), _ntz_ms(F.concat(v, F.lit("-01")), "UTC"))
            .when(v.rlike(r"^[a-z]+[ ,]+\d{1,2}[ ,]+\d{4}$"), _ntz_ms(named(1, 0), tz))
            .when(v.rlike(r"^\d{1,2}[ ,]+[a-z]+[ ,]+\d{4}$"), _ntz_ms(named(0, 1), tz))
            .when(v.rlike(r"^\d{4}-\d{2}-\d{2}[t ].*(z|[+-]\d{2}:?\d{2})$"), F.unix_millis(F.upper(v).try_cast("timestamp")))
            .when(v.rlike(r"^\d{4}-\d{2}-\d{2}[t ]"), _ntz_ms(F.upper(v), tz)))
