"""Column expressions and the since parser (fmt-style checks)."""

from pyspark.sql import functions as F

from chatlake.functions import text as TX
from chatlake.functions import time as TM
from chatlake.operators import sessions as SS

NOW = 1_773_000_000_000        # a fixed 'now'


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0]["x"]


def test_parse_since():
    assert TM.parse_since("7h", NOW) == NOW - 7 * 3_600_000
    assert TM.parse_since("12d", NOW) == NOW - 12 * 86_400_000
    assert TM.parse_since("2w", NOW) == NOW - 1_209_600_000
    assert TM.parse_since("45m", NOW) == NOW - 45 * 60_000
    today = TM.parse_since("today", NOW)
    assert today % 86_400_000 == 0 and 0 <= NOW - today < 86_400_000
    assert TM.parse_since("yesterday", NOW) == today - 86_400_000
    assert TM.parse_since("2025-07-04", NOW) == 1_751_587_200_000
    assert TM.parse_since("2025-07", NOW) == 1_751_328_000_000
    assert TM.parse_since("Jul 4 2025", NOW) == 1_751_587_200_000
    assert TM.parse_since("July 4, 2025", NOW) == 1_751_587_200_000
    assert TM.parse_since("not a time", NOW) is None


def test_ago_and_truncate(spark):
    assert one(spark, TM.ago(F.lit(NOW - 17 * 60_000), NOW)) == "17m"
    assert one(spark, TM.ago(F.lit(NOW - 11 * 3_600_000), NOW)) == "11h"
    assert one(spark, TM.ago(F.lit(NOW - 9 * 86_400_000), NOW)) == "9d"
    assert one(spark, TM.ago(F.lit(None).cast("long"), NOW)) == ""
    assert one(spark, TM.ago(F.lit(NOW - 59 * 60_000), NOW, long=True)) == "59m ago"
    assert one(spark, TX.truncate_plain(F.lit("compost heap"), 9)) == "compos..."
    assert one(spark, TX.truncate_plain(F.lit("short"), 8)) == "short"


def test_text_helpers(spark):
    assert one(spark, TX.normalize_title(F.lit("  a\n\tb  c  "))) == "a b c"
    assert one(spark, TX.project_name(F.lit("/x/y/proj"))) == "proj"
    assert one(spark, TX.short_id(F.lit("abcdefghijkl"))) == "abcdefgh"
    assert one(spark, TX.first_lines(F.lit("1\n2\n3"), 2)) == "1\n2"
    assert one(spark, TX.more_lines(F.lit("1\n2\n3"), 2)) == 1
    assert one(spark, TM.day_of_ms(F.lit(1_704_153_599_999))) == "2024-01-01"
    assert one(spark, TM.day_of_ms(F.lit(1_704_153_599_999), "America/New_York")) == "2024-01-01"
    assert one(spark, TM.day_of_ms(F.lit(1_704_067_200_000), "America/New_York")) == "2023-12-31"
    assert one(spark, TM.iso_to_ms(F.lit("2025-07-04T01:02:03.045Z"))) == 1_751_590_923_045


def test_skim_invariants(spark):
    rows = [(f"s{n}", p, "user" if p % 2 == 0 else "assistant", f"m{p}", p) for n in range(1, 10) for p in range(n)]
    m = spark.createDataFrame(rows, "session_id string, position int, role string, content string, timestamp_ms long")
    got = SS.skim(m, 3, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r["session_id"], []).append(r)
    for sid, rs in by.items():
        total = rs[0]["total"]
        heads = sorted(r["position"] for r in rs if r["section"] == "head")
        tails = sorted(r["position"] for r in rs if r["section"] == "tail")
        assert len(heads) + len(tails) + rs[0]["skipped"] == total
        if total <= 6:
            assert heads == list(range(total)) and not tails
        else:
            assert heads == [0, 1, 2] and tails == list(range(total - 3, total))
    no_tail = SS.skim(m, 2, 0).where(F.col("section") == "tail").count()
    assert no_tail == 0                                         # tail=0 -> empty tail (S27)
    only_user = SS.skim(m, 1, 1, role="user").where(F.col("session_id") == "s9").collect()
    assert only_user[0]["total"] == 5
