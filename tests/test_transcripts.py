"""Transcript lines: a small fixture of our own and the edge cases of the
semantics ledger."""

import json
import os

from pyspark.sql import functions as F

from chatlake.operators import search as SR
from chatlake.operators import sessions as SS
from chatlake.operators import usage as US
from chatlake.operators.sessionize import index_messages, index_sessions
from chatlake.sources import transcripts as TR

RAIN, WIND = "rain-0007", "wind-0042"
MODEL = "m-small"


def line(t, sid, ts, branch, role, content, model=None, usage=None, **extra):
    msg = {"role": role, "content": content}
    if model:
        msg["model"] = model
    if usage:
        msg["usage"] = usage
    d = {"type": t, "sessionId": sid, "timestamp": ts, "gitBranch": branch, "message": msg}
    d.update(extra)
    return json.dumps(d, ensure_ascii=False)


def usage(o, r, w):
    return {"output_tokens": o, "cache_read_input_tokens": r, "cache_creation_input_tokens": w}


GARDEN = [
    line("user", WIND, "2025-11-02T06:15:20Z", "south-bed", "user", "How deep do tulip bulbs go?"),
    line("assistant", WIND, "2025-11-02T06:15:41Z", "south-bed", "assistant",
         "About three times their height; see notes/bulbs.md.", MODEL, usage(41, 1200, 9)),
    line("user", WIND, "2025-11-02T06:20:00Z", "south-bed", "user", "And how far apart?"),
    line("assistant", WIND, "2025-11-02T06:20:30Z", "south-bed", "assistant", "A hand's width.", MODEL, usage(77, 0, 31)),
    line("user", WIND, "2025-11-02T07:00:00Z", "south-bed", "user", "Thanks, that covers the tulips."),
    line("assistant", RAIN, "2025-12-24T18:00:05Z", "north", "assistant", "The barrel is full again.", MODEL, usage(5, 640, 0)),
    line("user", RAIN, "2025-12-24T18:00:00Z", "north", "user", "Check the rain barrel, and the tulip bed too."),
]


def write_project(root, slug, name, lines):
    d = os.path.join(root, slug)
    os.makedirs(d, exist_ok=True)
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return p


def index_lines(lines, **kw):
    return index_sessions(lines, **kw), index_messages(lines, **kw)


def build(spark, root, **kw):
    return index_lines(TR.scan_lines(spark, root), **kw)


def test_garden_fixture(spark, tmpdir_fresh):
    write_project(tmpdir_fresh, "-srv-garden", "g.jsonl", GARDEN)
    sessions, messages = build(spark, tmpdir_fresh)
    s = {r["id"]: r for r in sessions.collect()}
    assert sorted(s) == [RAIN, WIND]
    assert (s[WIND]["message_count"], s[RAIN]["message_count"]) == (3, 1)
    assert s[WIND]["title"] == "How deep do tulip bulbs go?" and s[WIND]["branch"] == "south-bed"
    assert s[RAIN]["title"].startswith("Check the rain barrel") and s[RAIN]["directory"] == "/srv/garden"
    assert [m["role"] for m in messages.where(F.col("session_id") == RAIN).orderBy("position").collect()] == ["user", "assistant"]
    found = SR.search_sessions(messages, sessions, ["tulip"]).collect()
    assert [(h["session_id"], h["total_hits"], h["hit_position"]) for h in found] == [(WIND, 2, 0), (RAIN, 1, 0)]
    assert [h["hit_role"] for h in SR.search_sessions(messages, sessions, ["bulbs.md"]).collect()] == ["assistant"]
    assert SR.search_sessions(messages, sessions, ["barrel", "hand's"]).count() == 2
    assert [r["id"] for r in SS.list_sessions(sessions).collect()] == [RAIN, WIND]
    raw = TR.parse_lines(TR.scan_lines(spark, tmpdir_fresh))
    u = US.raw_model_usage(raw).collect()
    assert [(r["model"], r["turns"], r["output_tokens"], r["cache_read"], r["cache_write"]) for r in u] == [
        (MODEL, 3, 41 + 77 + 5, 1200 + 640, 9 + 31)]


def test_search_shows_the_earliest_hit_by_time(spark, tmpdir_fresh):
    """The half second sorts before the bare second as text, but is later."""
    write_project(tmpdir_fresh, "-p-mixed", "m.jsonl", [
        line("user", "mix", "2025-05-05T05:05:05.500Z", "b", "user", "late needle"),
        line("user", "mix", "2025-05-05T05:05:05Z", "b", "user", "early needle"),
        line("user", "mix", None, "b", "user", "timeless needle")])
    sessions, messages = build(spark, tmpdir_fresh)
    hit = SR.search_sessions(messages, sessions, ["needle"]).collect()[0]
    assert (hit["snippet"], hit["total_hits"]) == ("early needle", 3)


def test_only_one_level_of_files_and_plain_paths(spark, tmpdir_fresh):
    """Nested files stay out; blanks, plus and percent signs survive."""
    slug = "-w-my app+100%"
    write_project(tmpdir_fresh, slug, "main.jsonl", GARDEN)
    write_project(tmpdir_fresh, os.path.join(slug, "sub", "agents"), "x.jsonl",
                  [line("user", WIND, "2026-01-01T00:00:00Z", "b", "user", "nested line")])
    write_project(tmpdir_fresh, "", "top.jsonl", [line("user", "top", "2026-01-01T00:00:00Z", "b", "user", "no project")])
    sessions, messages = build(spark, tmpdir_fresh)
    assert messages.count() == len(GARDEN)
    assert {r["directory"] for r in sessions.collect()} == {"/w/my app+100%"}
    files = TR.list_files(spark, tmpdir_fresh).collect()
    assert [(r["slug"], r["directory"]) for r in files] == [(slug, "/w/my app+100%")]
    assert files[0]["path"] in {r["path"] for r in TR.scan_lines(spark, tmpdir_fresh).select("path").distinct().collect()}


def test_slug_map(spark):
    row = spark.createDataFrame([("-a-b-c",), ("-x-y",)], "slug string")
    got = [r[0] for r in row.select(TR.slug_to_directory("slug", {"-a-b-c": "/a/b-c"})).collect()]
    assert got == ["/a/b-c", "/x/y"]


def test_edge_lines(spark, tmpdir_fresh):
    C = "ccc33333"
    lines = [
        "",                                                    # blank line
        "{not json",                                           # malformed
        line("user", C, "2026-03-12T09:00:00Z", "", "user", "hi there  \U0001F600 friend\nsecond"),
        line("assistant", C, "2026-03-12T09:00:00Z", "dev", "assistant", "ok"),          # 2 chars
        line("assistant", C, "2026-03-12T09:01:00Z", "dev", "assistant", "[prose] lost"),  # starts with [
        json.dumps({"type": "assistant", "sessionId": C, "timestamp": "2026-03-12T09:02:00Z",
                    "message": {"role": "assistant", "content": [{"type": "text", "text": "blocks"}],
                                "model": MODEL, "usage": usage(7, 0, 0)}}),            # array content
        json.dumps({"type": "user", "sessionId": C, "timestamp": "2026-03-12T09:03:00Z",
                    "message": {"role": "user", "content": {"a": 1}}}),                # object content
        json.dumps({"type": "user", "sessionId": C, "timestamp": "2026-03-12T09:03:30Z",
                    "message": {"role": "user", "content": None}}),                    # null content
        line("user", None, "2026-03-12T09:04:00Z", "dev", "user", "no session id here"),
        line("user", C, None, "dev", "user", "null timestamp sorts last"),
        line("user", C, "junk-time", "dev", "user", "junk timestamp text"),
        line("assistant", C, "2026-03-12T09:05:00Z", "dev", "assistant", "fractional tokens",
             MODEL, {"output_tokens": 1.5, "cache_read_input_tokens": [1, 2],
                     "cache_creation_input_tokens": "9"}),
        line("user", C, "2026-03-12T09:06:00Z", "dev", "user", "nul\u0000byte kept as text"),
        json.dumps({"type": "user", "sessionId": C, "timestamp": "2026-03-12T09:07:00Z",
                    "message": {"content": "missing role line"}}),
        line("user", C, "2026-03-12T09:08:00Z", "dev", "user", "x" * 300),             # over-long (limit 200)
        line("system", C, "2026-03-12T09:09:00Z", "dev", "system", "system lines are dropped"),
    ]
    write_project(tmpdir_fresh, "-p-edge", "e.jsonl", lines)
    parsed = TR.parse_lines(TR.scan_lines(spark, tmpdir_fresh), max_line_chars=400)
    rejects = {r["reject"]: r["lines"] for r in TR.line_rejects(parsed).collect()}
    assert rejects.get("blank") == 1 and rejects.get("malformed") == 1 and rejects.get("too_long") == 1
    sessions, messages = index_lines(TR.scan_lines(spark, tmpdir_fresh))
    msgs = messages.orderBy("position").collect()
    texts = [m["content"] for m in msgs]
    assert "ok" not in texts and "[prose] lost" not in texts
    assert not any(t.startswith("[") or t.startswith("{") for t in texts)
    assert "no session id here" not in texts and "system lines are dropped" not in texts
    assert "nulbyte kept as text" in texts                      # NUL stripped (S35)
    # positions are dense and NULL timestamps come last
    assert [m["position"] for m in msgs] == list(range(len(msgs)))
    assert msgs[-1]["content"] == "null timestamp sorts last"
    assert msgs[-1]["timestamp_ms"] is None
    junk = [m for m in msgs if m["content"] == "junk timestamp text"][0]
    assert junk["timestamp_ms"] is None                         # S6: kept, NULL time
    frac = [m for m in msgs if m["content"] == "fractional tokens"][0]
    assert frac["output_tokens"] == 2 and frac["cache_read"] == 0 and frac["cache_write"] == 9   # S33
    role_missing = [m for m in msgs if m["content"] == "missing role line"][0]
    assert role_missing["role"] is None                         # S36: NULL, not 'null'
    s = sessions.collect()[0]
    assert s["title"] == "hi there \U0001F600 friend second"    # U+00A0 and newline collapse (S7)
    assert s["branch"] == "dev"                                  # first non-empty branch (S8)
    assert s["started_at"] is not None and s["last_at"] >= s["started_at"]


def test_session_in_two_files_last_wins(spark, tmpdir_fresh):
    D = "ddd44444"
    old = write_project(tmpdir_fresh, "-p-two", "old.jsonl",
                        [line("user", D, "2026-03-01T00:00:00Z", "b", "user", "first version text")])
    new = write_project(tmpdir_fresh, "-p-two", "new.jsonl",
                        [line("user", D, "2026-03-02T00:00:00Z", "b", "user", "second version text"),
                         line("user", D, "2026-03-02T00:01:00Z", "b", "user", "more text")])
    os.utime(old, (1_700_000_000, 1_700_000_000))
    os.utime(new, (1_700_000_100, 1_700_000_100))
    sessions, messages = build(spark, tmpdir_fresh)
    assert [m["content"] for m in messages.orderBy("position").collect()] == \
        ["second version text", "more text"]
    assert sessions.collect()[0]["message_count"] == 2
    _, merged = build(spark, tmpdir_fresh, merge_files=True)
    assert merged.count() == 3


def test_keyword_wildcards_and_escapes(spark):
    rows = [("s1", 0, "100% done_now"), ("s2", 0, "path a\\b here"), ("s3", 0, "it's fine"),
            ("s4", 0, "100x doneznow")]
    m = spark.createDataFrame(rows, "session_id string, position int, content string")
    def hits(kws):
        return sorted(r["session_id"] for r in m.where(SR.TX.any_keyword("content", kws)).collect())
    assert hits(["100%"]) == ["s1", "s4"]          # % stays a wildcard (S18)
    assert hits(["done_now"]) == ["s1", "s4"]      # _ stays a wildcard
    assert hits(["a\\b"]) == ["s2"]                 # backslash matched literally (S19)
    assert hits(["it's"]) == ["s3"]
    assert hits(["DONE"]) == ["s1", "s4"]          # case-insensitive


def test_scope_boundary(spark):
    rows = [("a", "/work/team1/proj1"), ("b", "/work/team1/proj11"), ("c", "/work/team2/proj1")]
    s = spark.createDataFrame(rows, "id string, directory string")
    from chatlake.operators.filters import in_scope
    got = lambda df: sorted(r["id"] for r in df.collect())
    assert got(in_scope(s, ["/work/team1/proj1"])) == ["a", "b"]               # S16
    assert got(in_scope(s, ["/work/team1/proj1"], boundary=True)) == ["a"]
    scope = spark.createDataFrame([("/work/team1/proj1",)], "prefix string")
    assert got(in_scope(s, scope)) == ["a", "b"]
    assert got(in_scope(s, scope, boundary=True)) == ["a"]


def test_bidirectional_scope_as_rows(spark):
    """A scope DataFrame matches both ways, as a list does."""
    from chatlake.operators.filters import filter_sessions
    rows = [("a", "/w/t1", 1), ("b", "/w/t1/p", 1), ("c", "/w/t2", 1), ("d", "/w", 1)]
    s = spark.createDataFrame(rows, "id string, directory string, last_at long")
    prefixes = ["/w/t1"]
    scope = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    for sc in (prefixes, scope):
        assert sorted(r["id"] for r in filter_sessions(s, scope=sc, bidirectional=True).collect()) == ["a", "b", "d"]


def test_session_prefix_set(spark):
    from chatlake.operators.filters import session_prefixes
    ids = spark.createDataFrame([("abc1",), ("abd2",), ("xyz",)], "session_id string")
    want = spark.createDataFrame([("ab",), ("abc",), ("x",), ("q",), ("",)], "prefix string")
    assert sorted(r[0] for r in session_prefixes(ids, want).collect()) == ["abc1", "abd2", "xyz"]
    assert session_prefixes(ids, want.limit(0)).count() == 0
