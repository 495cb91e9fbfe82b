"""Commits of the stored index: crashes, two writers, order, unreadable files, postings and
roll-ups by difference."""

import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from test_store import many, relational, snapshot, touch
from test_transcripts import GARDEN, RAIN, WIND, line, write_project

from chatlake.operators import search as SR
from chatlake.operators import usage as US
from chatlake.store import layout, tables
from chatlake.store.tables import Change, CommitConflict, TableSet, run_index


class Crashing(TableSet):
    def _publish(self, version, state):
        raise ConnectionError("gone")


def test_what_a_crashed_run_left_is_never_read(spark, tmpdir_fresh):
    src, root = os.path.join(tmpdir_fresh, "p"), os.path.join(tmpdir_fresh, "index")
    p = write_project(src, "-a", "x.jsonl", many(8))
    store = TableSet(spark, root, buckets=2)
    run_index(spark, src, store)
    good = snapshot(store)
    with open(p, "a", encoding="utf-8") as f:
        f.write(line("user", "new", "2025-06-02T00:00:00Z", "b", "user", "lost at first") + "\n")
    touch(p, 30)
    with pytest.raises(ConnectionError):
        run_index(spark, src, Crashing(spark, root))
    assert snapshot(store) == good
    store.remove_sessions(store.sessions().select("id"))       # takes the crashed run's version number
    assert snapshot(store) == ([], []) and store.usage().count() == 0 and store.daily().count() == 0
    assert run_index(spark, src, store)["files_indexed"] == 1  # the crashed run recorded nothing
    assert len(snapshot(store)[0]) == 9
    before = snapshot(store)
    assert store.vacuum(keep=1) and snapshot(store) == before


def test_of_two_writers_the_second_changes_nothing(spark, tmpdir_fresh):
    src, root = os.path.join(tmpdir_fresh, "p"), os.path.join(tmpdir_fresh, "index")
    write_project(src, "-a", "x.jsonl", many(4))
    store = TableSet(spark, root, buckets=2)
    run_index(spark, src, store)
    old, slow = store.pointer(), TableSet(spark, root)
    store.remove_sessions(spark.createDataFrame([("s000",)], "id string"))
    slow._state = lambda: old                                  # it read the pointer before
    with pytest.raises(CommitConflict):
        slow.commit(Change(removed=spark.createDataFrame([("s001",)], "id string")))
    assert [x[0] for x in snapshot(store)[0]] == ["s001", "s002", "s003"]
    # a run that meets another writer starts again from the new state
    write_project(src, "-b", "y.jsonl", many(6)[4:])
    publish, calls = TableSet._publish, []

    class Late(TableSet):
        def _publish(self, version, state):
            calls.append(version)
            if len(calls) == 1:
                publish(self, version, {**store.pointer(), "version": version})
            publish(self, version, state)

    run_index(spark, src, Late(spark, root))
    assert len(calls) == 2 and len(snapshot(store)[0]) == 5


def test_merged_files_have_one_order_in_every_run(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "p")
    texts = lambda f: [line("user", "two", "2025-01-01T00:00:00Z", "b", "user", f"{f} text {i}") for i in range(3)]
    a, b = write_project(src, "-a", "a.jsonl", texts("a")), write_project(src, "-a", "b.jsonl", texts("b"))
    store = TableSet(spark, os.path.join(tmpdir_fresh, "i1"), buckets=2)
    want = [f"{f} text {i}" for f in "ab" for i in range(3)]
    run_index(spark, src, store, merge_files=True)
    for p in (b, a):
        assert [c for _, _, c in snapshot(store)[1]] == want
        touch(p, 60)
        assert run_index(spark, src, store, merge_files=True)["files_indexed"] == 1
    assert [c for _, _, c in snapshot(store)[1]] == want


def test_files_that_cannot_be_read_are_tried_again(spark, tmpdir_fresh, monkeypatch):
    src = os.path.join(tmpdir_fresh, "p")
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2)
    assert run_index(spark, src, store)["files_checked"] == 0   # no transcripts folder yet
    assert store.pointer() is None
    write_project(src, "-a", "x.jsonl", many(3))
    write_project(src, "-a", "gone.jsonl", many(5)[3:])
    real = tables.TR.list_files

    def listed(*args):
        df = real(*args)
        return df.withColumn("size", F.when(F.col("path").endswith("gone.jsonl"), F.col("size") + 10).otherwise(F.col("size")))

    monkeypatch.setattr(tables.TR, "list_files", listed)        # a file that ends too early
    st = run_index(spark, src, store)
    assert (st["files_indexed"], st["files_failed"], len(snapshot(store)[0])) == (1, 1, 3)
    monkeypatch.setattr(tables.TR, "list_files", real)
    st = run_index(spark, src, store)
    assert (st["files_indexed"], st["files_failed"], len(snapshot(store)[0])) == (1, 0, 5)


def test_many_changed_files_and_slug_names(spark, tmpdir_fresh, monkeypatch):
    monkeypatch.setattr(tables, "MAX_LISTED", 2)
    src = os.path.join(tmpdir_fresh, "p")
    for i, row in enumerate(many(5)):
        write_project(src, f"-srv-my-app{i % 2}", f"{i}.jsonl", [row, "{broken"])
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2)
    st = run_index(spark, src, store, slug_map={"-srv-my-app1": "/srv/my-app1"})
    assert st["files_indexed"] == 5 and st["lines_rejected"] == {"malformed": 5}
    assert {r["directory"] for r in store.sessions().collect()} == {"/srv/my/app0", "/srv/my-app1"}


def totals(store):
    """The stored roll-ups, and the same from the stored messages."""
    m, s = store.messages(), store.sessions()
    place = s.select(F.col("id").alias("session_id"), "source", "directory")
    usage = m.where("model IS NOT NULL AND role = 'assistant'").join(place, "session_id").groupBy("source", "directory", "model").agg(
        F.count("*").alias("turns"), *[F.sum(c).cast("long").alias(c) for c in US.TOKEN_COLS])
    days = US.session_days(m).join(place, "session_id").groupBy("source", "directory", "day").agg(
        F.count("*").alias("sessions"), F.sum("user_msgs").alias("user_msgs"), F.sum("asst_turns").alias("asst_turns"))
    got = store.usage().select(*usage.columns[:4], *[F.col(c).cast("long").alias(c) for c in US.TOKEN_COLS])
    rows = lambda df, cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    return [(rows(a, b.columns), rows(b, b.columns)) for a, b in ((got, usage), (store.daily(), days))]


def test_rollups_and_postings_follow_every_commit(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "p")
    p = write_project(src, "-srv-garden", "w.jsonl", GARDEN[:5])
    write_project(src, "-srv-water", "r.jsonl", GARDEN[5:])
    write_project(src, "-srv-many", "m.jsonl", many(40))
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=8, postings=True)
    run_index(spark, src, store, relational=relational(spark))

    def check():
        for got, want in totals(store):
            assert got == want
        for words in (["tulip"], ["ferns", "MESSAGE OF 7"], ["of"], ["t_lip"], ["no such text"]):
            hits = lambda m: sorted(map(tuple, SR.search_sessions(m, store.sessions(), words, limit=None).collect()), key=repr)
            assert hits(store.messages_with(words)) == hits(store.messages())

    check()
    read = [f for f in store.messages_with(["message of 7"]).inputFiles() if "/message/" in f]
    assert 0 < len(read) < len(store.messages().inputFiles())
    with open(p, "a", encoding="utf-8") as f:                   # append in place
        f.write(line("assistant", WIND, "2025-11-09T00:00:00Z", "b", "assistant", "a tulip in november") + "\n")
    touch(p, 30)
    run_index(spark, src, store, relational=relational(spark))
    check()
    write_project(src, "-srv-many", "m.jsonl", [x.replace("message of", "letter from") for x in many(20)])
    touch(os.path.join(src, "-srv-many", "m.jsonl"), 60)
    run_index(spark, src, store, relational=relational(spark, text="prune the ferns"), force=True)
    check()
    store.remove_sessions(spark.createDataFrame([(RAIN,), ("s003",), ("f1",)], "id string"))
    check()
    store.remove_sessions(store.sessions().select("id"))
    assert all(got == want == [] for got, want in totals(store)) and store.messages_with(["tulip"]).count() == 0


def test_relational_feed_reads_new_and_updated_sessions(spark, tmpdir_fresh):
    from pyspark.sql import Row
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2)
    first = relational(spark)
    run_index(spark, None, store, relational=first)
    text = {r["session_id"]: r["content"] for r in store.messages().collect()}
    again = relational(spark, text="other words")               # f1's text changes, its time does not; f2 is updated
    again.session = again.session.withColumn("time_updated", F.when(F.col("id") == "f2", 5000).otherwise(F.col("time_updated")))
    assert run_index(spark, None, store, relational=again)["sessions_indexed"] == 1
    assert {r["session_id"]: r["content"] for r in store.messages().collect()} == text
    gone = relational(spark, archived=9000)
    run_index(spark, None, store, relational=gone, purge=True)
    assert [r["id"] for r in store.sessions().collect()] == ["f1"] and Row


def test_since_skips_row_groups(spark, tmpdir_fresh, monkeypatch):
    import glob

    import pyarrow.parquet as pq
    monkeypatch.setattr(layout, "SESSION_ROW_GROUP", 4096)
    rows = spark.range(0, 20000).select(
        F.format_string("s%05d", "id").alias("id"), F.lit("claude-code").alias("source"), F.lit("/d").alias("directory"), F.lit(None).cast("string").alias("branch"),
        F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit(None).cast("string").alias("parent_id"), F.col("id").alias("started_at"),
        (F.col("id") * 7919 % 20000).alias("last_at"), F.lit(1).alias("message_count"))
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=1)
    store.upsert_sessions(rows)
    files = glob.glob(f"{tmpdir_fresh}/index/session/*/bucket=0/*.parquet")
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    last = [next(g.column(c).statistics for c in range(g.num_columns) if g.column(c).path_in_schema == "last_at") for g in groups]
    read = sum(s.max >= 19000 for s in last)
    assert len(groups) > 20 and read <= len(groups) * 0.1
    assert store.sessions().where("last_at >= 19000").count() == 1000


def test_kept_messages_and_postings_pass_no_exchange(spark, tmpdir_fresh, monkeypatch):
    """A deletion copies what a bucket keeps: no exchange between the old files and the new."""
    src = os.path.join(tmpdir_fresh, "p")
    write_project(src, "-srv-garden", "w.jsonl", GARDEN)
    write_project(src, "-srv-many", "m.jsonl", many(40))
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=2, postings=True)
    run_index(spark, src, store)
    rows = lambda: sorted(map(tuple, store._read("posting").collect()))
    texts = lambda: store.messages().select("session_id", F.lower("content").alias("t")).collect()
    grams = lambda: sorted({(r["t"][i:i + 3], r["session_id"]) for r in texts() for i in range(len(r["t"]) - 2)})
    assert rows() == grams()
    plans, write = {}, DataFrameWriter.parquet

    def seen(self, path, *a, **b):
        plans[path.split("/index/")[-1].split("/")[0]] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    store.remove_sessions(store.sessions().orderBy("id").limit(3).select("id"))
    for table in ("message", "posting"):
        assert plans[table].index("Union") < plans[table].index(" Exchange ")
    assert rows() == grams()
