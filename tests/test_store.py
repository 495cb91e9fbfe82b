"""Incremental index round trip: run, rerun, change, delete, force; and the
faults that stored indexes had."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from test_transcripts import GARDEN, RAIN, WIND, line, write_project

from chatlake.store.tables import RelationalStore, TableSet, run_index


def snapshot(store):
    s = sorted((r["id"], r["message_count"], r["title"]) for r in store.sessions().collect())
    m = sorted((r["session_id"], r["position"], r["content"]) for r in store.messages().collect())
    return s, m


def touch(path, seconds):
    at = time.time() + seconds
    os.utime(path, (at, at))


def test_incremental_round_trip(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "projects")
    p1 = write_project(src, "-srv-garden", "w.jsonl", GARDEN[:5])
    p2 = write_project(src, "-srv-water", "r.jsonl", GARDEN[5:])
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=4)

    st = run_index(spark, src, store)
    assert st["files_checked"] == 2 and st["files_indexed"] == 2 and st["sessions_indexed"] == 2
    first = snapshot(store)
    assert len(first[0]) == 2 and len(first[1]) == 7

    st = run_index(spark, src, store)                   # nothing changed: nothing written
    assert st["files_indexed"] == 0
    assert store.pointer()["version"] == 1
    assert snapshot(store) == first

    with open(p2, "a", encoding="utf-8") as f:          # append in place
        f.write(line("user", RAIN, "2025-12-24T19:30:00Z", "north", "user", "Then empty it before the frost") + "\n")
        f.write("{broken\n")
    touch(p2, 10)
    st = run_index(spark, src, store)
    assert st["files_indexed"] == 1 and st["lines_rejected"] == {"malformed": 1}
    s, m = snapshot(store)
    assert [x[1] for x in s if x[0] == RAIN] == [2]      # its user messages
    assert len([x for x in m if x[0] == RAIN]) == 3
    assert [x for x in m if x[0] == WIND] == [x for x in first[1] if x[0] == WIND]

    os.remove(p1)                                        # deleted file: manifest row goes (S11)
    run_index(spark, src, store)
    paths = [r["path"] for r in store.manifest().collect()]
    assert len(paths) == 1 and paths[0].endswith("r.jsonl")
    assert len(snapshot(store)[0]) == 2                  # its sessions stay

    fresh = TableSet(spark, os.path.join(tmpdir_fresh, "index2"), buckets=4)
    run_index(spark, src, fresh)
    forced = run_index(spark, src, store, force=True, purge=True)  # purge drops what no file holds
    assert forced["files_indexed"] == 1
    assert snapshot(store) == snapshot(fresh)
    assert store.vacuum(keep=1) and snapshot(store) == snapshot(fresh)


def many(n, first="2025-06-01T00:00:00Z"):
    return [line("user", f"s{i:03d}", first, "b", "user", f"message of {i}") for i in range(n)]


def test_bucket_count_stays(spark, tmpdir_fresh):
    """Reopening a store with another bucket count keeps its layout."""
    src, root = os.path.join(tmpdir_fresh, "p"), os.path.join(tmpdir_fresh, "index")
    rows = many(30)
    write_project(src, "-a", "x.jsonl", rows[:20])
    p = write_project(src, "-b", "y.jsonl", rows[20:])
    run_index(spark, src, TableSet(spark, root, buckets=4))
    touch(p, 20)
    again = TableSet(spark, root, buckets=16)
    run_index(spark, src, again)
    assert again.buckets == 4 and again.messages().count() == 30
    assert again.messages().select("session_id").distinct().count() == 30
    one = again.session_messages(["s007"])
    assert one.count() == 1 and len(one.inputFiles()) < len(again.messages().inputFiles())


def test_odd_file_names(spark, tmpdir_fresh):
    """Pattern characters in names are plain characters."""
    src = os.path.join(tmpdir_fresh, "pro[j]*")
    write_project(src, "-a{b}", "x[1].jsonl", GARDEN[:2])
    write_project(src, "-c d%41", "y?.jsonl", GARDEN[5:])
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2)
    assert run_index(spark, src, store)["files_indexed"] == 2
    assert {r["directory"] for r in store.sessions().collect()} == {"/a{b}", "/c d%41"}
    assert run_index(spark, src, store)["files_indexed"] == 0


@pytest.mark.parametrize("merge", [True, False])
def test_session_in_two_files_incrementally(spark, tmpdir_fresh, merge):
    """After one of a session's files changes, the result is a full run's."""
    src = os.path.join(tmpdir_fresh, "p")
    old = write_project(src, "-a", "old.jsonl", [line("user", "two", "2025-01-01T00:00:00Z", "b", "user", "from the old file")])
    new = write_project(src, "-a", "new.jsonl", [line("user", "two", "2025-01-02T00:00:00Z", "b", "user", "from the new file")])
    touch(old, -500)
    touch(new, -100)
    store = TableSet(spark, os.path.join(tmpdir_fresh, "i1"), buckets=2)
    run_index(spark, src, store, merge_files=merge)
    for path, at in ((new, 50), (old, -300)):            # the older file stays the older one
        touch(path, at)
        run_index(spark, src, store, merge_files=merge)
        fresh = TableSet(spark, os.path.join(tmpdir_fresh, f"f{at}"), buckets=2)
        run_index(spark, src, fresh, merge_files=merge)
        assert snapshot(store) == snapshot(fresh)
    assert len(snapshot(store)[1]) == (2 if merge else 1)


def relational(spark, archived=None, text="water the ferns"):
    session = spark.createDataFrame(
        [("f1", None, "/srv/ferns", "Ferns", None, 10, 90, None), ("f2", "f1", "/srv/ferns", "", "moss-slug", 20, 95, archived)],
        "id string, parent_id string, directory string, title string, slug string, time_created long, time_updated long, time_archived long")
    message = spark.createDataFrame([("m1", "f1", '{"role":"user"}', 11), ("m2", "f2", '{"role":"assistant"}', 21)],
                                    "id string, session_id string, data string, time_created long")
    part = spark.createDataFrame(
        [("p1", "m1", "f1", json.dumps({"type": "text", "text": text}), 12), ("p2", "m1", "f1", '{"type":"tool","text":"no"}', 13),
         ("p3", "m2", "f2", '{"type":"text","text":"moss needs shade"}', 22)],
        "id string, message_id string, session_id string, data string, time_created long")
    return RelationalStore(session, message, part)


def test_both_sources_in_one_index(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "p")
    write_project(src, "-srv-garden", "w.jsonl", GARDEN)
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2)
    st = run_index(spark, src, store, relational=relational(spark))
    assert (st["files_checked"], st["files_indexed"], st["sessions_indexed"]) == (2, 2, 4)
    got = {r["id"]: (r["source"], r["title"], r["parent_id"]) for r in store.sessions().collect()}
    assert got["f2"] == ("opencode", "moss-slug", "f1") and got[RAIN][0] == "claude-code" and store.messages().count() == 9
    assert run_index(spark, src, store, relational=relational(spark))["files_indexed"] == 0
    forced = run_index(spark, src, store, force=True, relational=relational(spark, text="prune the ferns"))
    assert forced["sessions_indexed"] == 4
    assert store.messages().where(F.col("content") == "prune the ferns").count() == 1
    assert run_index(spark, src, store)["files_indexed"] == 0             # without it: its rows stay
    assert {r["source"] for r in store.manifest().collect()} == {"claude-code", "opencode"}


def test_removing_sessions(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "p")
    write_project(src, "-srv-garden", "w.jsonl", GARDEN)
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=1)
    run_index(spark, src, store)
    store.remove_sessions(spark.createDataFrame([(WIND,), ("none",)], "id string"))
    assert [x[0] for x in snapshot(store)[0]] == [RAIN] and {x[0] for x in snapshot(store)[1]} == {RAIN}
    store.remove_sessions(spark.createDataFrame([(RAIN,)], "id string"))
    assert snapshot(store) == ([], [])


def test_building_a_query_runs_no_checkpoint(spark, tmpdir_fresh):
    from chatlake.plans import registry

    made = lambda: sum(len(f) for _, _, f in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    before = made()
    for name in ("sessionize", "index_messages", "sessionize_parts", "text_parts", "merge_sources", "index_stats", "skim_all"):
        registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert made() == before


def test_small_store_operators(spark, tmpdir_fresh):
    from chatlake.store import incremental as INC
    from chatlake.store.output import as_json_lines, write_json
    from chatlake.sources.transcripts import list_files

    src = os.path.join(tmpdir_fresh, "projects")
    write_project(src, "-a", "x.jsonl", GARDEN[:2])
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2)
    files = list_files(spark, src)
    assert INC.needs_index(store.sessions(), files, store.manifest())        # SNK9: empty index
    run_index(spark, src, store)
    assert not INC.needs_index(store.sessions(), list_files(spark, src), store.manifest())
    sessions = store.sessions()
    gone = INC.remove_keys(sessions, sessions.select("id"), "id")             # SNK4
    assert gone.count() == 0
    stats = INC.run_stats(files, INC.changed_files(files, store.manifest(), force=True), sessions).collect()[0]
    assert (stats["files_checked"], stats["files_indexed"], stats["sessions_indexed"]) == (1, 1, 1)  # SNK11
    js = as_json_lines(sessions).collect()[0]["json"]                          # SNK12
    assert f'"id":"{WIND}"' in js
    out = os.path.join(tmpdir_fresh, "json")
    write_json(sessions, out)
    assert spark.read.json(out).count() == 1


def test_ingest_files_matches_view(spark, tmpdir_fresh):
    """Lines derived from the driver table, written as files, indexed and
    stored: every usable message survives and positions stay dense."""
    from chatlake.sources.driver_views import message_view, raw_view

    sf = "/root/testdata/sf0.01"
    src = os.path.join(tmpdir_fresh, "projects")
    files = {}
    for r in raw_view(spark, sf).orderBy("line_no").select("path", "value").toLocalIterator():
        files.setdefault(r["path"], []).append(r["value"])
    for p, lines in files.items():
        full = os.path.join(src, p.split("/projects/", 1)[1])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=8)
    run_index(spark, src, store)
    stored = store.messages()
    assert stored.count() == message_view(spark, sf).count()
    gaps = (stored.groupBy("session_id")
            .agg((F.max("position") + 1 - F.count(F.lit(1))).alias("gap"), F.min("position").alias("lo"))
            .where((F.col("gap") != 0) | (F.col("lo") != 0)).count())
    assert gaps == 0
