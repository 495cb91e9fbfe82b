"""STR1 for sessions that go on in later drops, replayed batches, and runs after a stream."""

import os
import time

from pyspark.sql import functions as F
from test_store import snapshot
from test_transcripts import line, write_project

from chatlake.operators import tree as TRE
from chatlake.sources import transcripts as TR
from chatlake.store.tables import TableSet, run_index
from chatlake.streaming import ingest as STI


def said(minute, text, session="one", role="user", branch=""):
    return line(role, session, f"2025-03-01T10:{minute:02d}:00Z", branch, role, text)


def drop(src, name, rows, at, slug="-my app"):
    p = write_project(src, slug, name, rows)
    os.utime(p, (at, at))
    return p


def take(spark, root, store, merge_files=True):
    q = STI.start_ingest(spark, os.path.join(root, "drops", "*"), store, os.path.join(root, "ck"), merge_files=merge_files)
    q.awaitTermination(120)
    assert q.exception() is None


def test_sessions_go_on_in_later_drops(spark, tmpdir_fresh):
    src, now = os.path.join(tmpdir_fresh, "drops"), time.time() - 1000
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2, postings=True)
    drop(src, "a.jsonl", [said(3, "third text", branch="main"), said(4, "reply four", role="assistant")], now)
    take(spark, tmpdir_fresh, store)
    drop(src, "b.jsonl", [said(6, "sixth text"), said(7, "of another one", "two")], now + 10)
    take(spark, tmpdir_fresh, store)
    folders = store.pointer()["tables"]["message"]
    assert max(len(x) for x in folders.values()) == 2           # added, nothing rewritten
    assert [x[1:] for x in snapshot(store)[1] if x[0] == "one"] == [(0, "third text"), (1, "reply four"), (2, "sixth text")]
    drop(src, "c.jsonl", [said(1, "first text", branch="early"), said(9, "last text")], now + 20)   # begins before what is stored
    take(spark, tmpdir_fresh, store)
    assert [x[1:] for x in snapshot(store)[1] if x[0] == "one"] == [
        (i, t) for i, t in enumerate(["first text", "third text", "reply four", "sixth text", "last text"])]
    one = store.sessions().where("id = 'one'").first()
    assert (one.title, one.branch, one.message_count, one.directory) == ("first text", "early", 4, "/my app")
    assert store.session_files().where("session_id = 'one'").count() == 3
    days = store.daily().collect()
    assert [(r.day, r.sessions, r.user_msgs, r.asst_turns) for r in days] == [("2025-03-01", 2, 5, 1)]
    assert {r.session_id for r in store.messages_with(["sixth"]).collect()} == {"one"}
    # a batch run over the same root: the same paths and times, nothing to do
    before = store.pointer()["version"]
    assert run_index(spark, src, store)["files_indexed"] == 0 and store.pointer()["version"] == before


def test_a_replayed_batch_changes_nothing(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "drops")
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2)
    drop(src, "a.jsonl", [said(1, "a first text")], time.time() - 100)
    lines = TR.scan_lines(spark, src)
    put = STI.upsert_batch(store)
    for batch in (0, 0, 1, 0, 1):
        put(lines if batch == 0 else lines.limit(0), batch)
    assert len(snapshot(store)[1]) == 1 and store.pointer()["streams"] == {"ingest": 1}
    STI.upsert_batch(store, name="other")(lines, 0)             # another stream has its own count
    assert len(snapshot(store)[1]) == 2


def test_the_latest_file_wins_whatever_arrives_last(spark, tmpdir_fresh):
    src, now = os.path.join(tmpdir_fresh, "drops"), time.time() - 1000
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2)
    put = STI.upsert_batch(store, merge_files=False)
    new = drop(src, "new.jsonl", [said(1, "from the new file")], now + 50)
    put(TR.scan_lines(spark, src), 0)
    os.rename(new, new + ".kept")
    drop(src, "old.jsonl", [said(2, "from the old file"), said(3, "only here", "two")], now)
    put(TR.scan_lines(spark, src), 1)
    os.rename(new + ".kept", new)
    assert snapshot(store)[1] == [("one", 0, "from the new file"), ("two", 0, "only here")]
    fresh = TableSet(spark, os.path.join(tmpdir_fresh, "full"), buckets=2)
    run_index(spark, src, fresh)
    assert snapshot(fresh) == snapshot(store)
    assert store.session_files().where("session_id = 'one'").select("path").distinct().count() == 2


def test_a_deep_chain_is_ranked_in_few_rounds(spark):
    n = 3000
    rows = spark.range(n).select(
        F.format_string("c%05d", "id").alias("id"), F.lit("/d").alias("directory"),
        F.when(F.col("id") > 0, F.format_string("c%05d", F.col("id") - 1)).alias("parent_id"), F.col("id").alias("started_at"), F.col("id").alias("last_at"))
    got = TRE.lineage(rows, max_rounds=14)
    assert got.where("preorder <> depth OR format_string('c%05d', depth) <> id OR root_id <> 'c00000'").count() == 0
    assert got.count() == n


def test_preorder_of_a_wide_tree_and_cycles(spark):
    day = 86_400_000
    rows = [("r", "/d", None, 0, 0)] + [(f"k{i}", "/d", "r", (7 - i) * 40 * day, i) for i in range(8)]
    rows += [(f"k{i}-{j}", "/d", f"k{i}", j, j) for i in range(8) for j in range(2)]
    rows += [("x", "/c", "z", 1, 1), ("y", "/c", "x", 1, 1), ("z", "/c", "y", 1, 1), ("t", "/c", "y", 1, 1), ("u", "/c", "t", 1, 1), ("s", "/c", "s", 1, 1), ("v", "/c", None, 1, 1)]
    df = spark.createDataFrame(rows, "id string, directory string, parent_id string, started_at long, last_at long")
    got = sorted((r.preorder, r.id, r.depth) for r in TRE.lineage(df).where("directory = '/d'").collect())
    want = ["r"] + [x for i in range(7, -1, -1) for x in (f"k{i}", f"k{i}-0", f"k{i}-1")]
    assert [x for _, x, _ in got] == want and [p for p, _, _ in got] == list(range(25))
    told = {r.id: (r.cycle, r.on_cycle, r.cycle_size) for r in TRE.cycles(df).collect()}
    assert told == {"x": ("x", True, 3), "y": ("x", True, 3), "z": ("x", True, 3), "t": ("x", False, 3), "u": ("x", False, 3), "s": ("s", True, 1)}
    assert TRE.cycles(df.where("directory = '/d'")).count() == 0


def test_time_expressions_as_a_column(spark):
    from chatlake.functions import time as TM
    now = 1_738_584_000_000
    texts = ["30m", " 2H ", "3d", "1w", "today", "Yesterday", "2025-07-04", "2025-07", "Jul 4 2025", "July 4, 2025", "4 jul 2025", "2025-07-04T10:00:00Z",
             "2025-07-04T10:00:00+02:00", "2025-07-04 10:00", "soon", "", "Foo 4 2025", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for tz in ("UTC", "America/New_York"):
        got = [r.ms for r in df.select(TM.since_ms("t", now, tz).alias("ms")).collect()]
        assert got == [None if t is None else TM.parse_since(t, now, tz) for t in texts]
