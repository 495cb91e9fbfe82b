"""The command facade over a stored index."""

import json
import os

from test_transcripts import GARDEN, RAIN, WIND, line, write_project

from chatlake.api import TranscriptIndex

NOW = 1_766_700_000_000     # 2025-12-25T22:00Z


def test_commands(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "projects")
    write_project(src, "-srv-garden", "g.jsonl", GARDEN)
    ix = TranscriptIndex(spark, os.path.join(tmpdir_fresh, "index"), src, buckets=2, now_ms=NOW)
    assert ix.index()["sessions_indexed"] == 2
    assert [r["id"] for r in ix.sessions().collect()] == [RAIN, WIND]
    assert [r["id"] for r in ix.sessions(since="2d").collect()] == [RAIN]
    assert ix.sessions(scope=["/srv/garden/x"], bidirectional=True).count() == 2
    assert ix.sessions(scope=["/srv/gard"], boundary=True).count() == 0
    assert [r["session_id"] for r in ix.search(["bulbs"]).collect()] == [WIND]
    assert [r["session_id"] for r in ix.search(["tulip"], rank="recency").collect()] == [RAIN, WIND]
    assert [r["position"] for r in ix.read("wind", around=1, radius=1).collect()] == [0, 1, 2]
    assert ix.skim("wind", 1, 1).count() == 2 and ix.preview("wind").count() == 5
    models, daily = ix.stats()
    assert models.collect()[0]["output_tokens"] == 123
    assert [r["day"] for r in daily.collect()] == ["2025-11-02", "2025-12-24"]
    assert ix.files("notes/bulbs.md").count() == 1
    assert [r["kind"] for r in ix.browse().collect()] == ["project", "session", "session"]
    assert ix.browse(mode="lineage").count() == 3 and ix.browse(mode="recent", text="barrel").count() == 1
    assert ix.browse(project="garden").count() == 3 and ix.browse(project="nowhere").count() == 0
    rows = [json.loads(r[0]) for r in ix.as_json(ix.sessions()).collect()]
    assert sorted(r["id"] for r in rows) == [RAIN, WIND]


def test_auto_index(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "projects")
    write_project(src, "-srv-garden", "g.jsonl", GARDEN)
    ix = TranscriptIndex(spark, os.path.join(tmpdir_fresh, "index"), src, buckets=2, now_ms=NOW, auto_index=True)
    assert ix.sessions().count() == 2
    write_project(src, "-srv-shed", "s.jsonl", [line("user", "shed", "2025-12-25T01:00:00Z", "b", "user", "Sharpen the spade")])
    assert ix.search(["spade"]).count() == 1
    assert ix.store.pointer()["version"] == 2 and ix.sessions().count() == 3 and ix.store.pointer()["version"] == 2
