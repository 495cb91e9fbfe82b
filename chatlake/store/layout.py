"""The stored table set on plain Parquet: layout, reads and commits (SNK1-SNK6).

Layout under ``root`` (any Hadoop path: a shared folder, HDFS, object store)::

    <table>/v=<n>-<run>/bucket=<b>/   the buckets that a commit wrote
    _pointer/v=<n>.json               per table and bucket the folders that hold it

Every table is bucketed by a hash of its key (sessions, messages, roll-up grain and
postings by session, the manifest by path, roll-ups by directory), so a commit reads
and writes only the buckets that its sessions, files and directories fall in.  A
bucket that only gets further rows (streaming) gets one more folder; it is written
anew once it has more than ``MAX_FOLDERS``.

A commit writes its files into folders of its own, named by a random run id, and
publishes the pointer last, by a rename that fails if that version is there
already.  Readers follow the newest pointer.  So a crash before the pointer leaves
the previous state, what it left behind is never read, and of two writers that
start from one version the second gets ``CommitConflict`` and changes nothing.

Messages are cut by ranges of ``(session_id, position)`` within a bucket, postings by a
hash of the trigram, so a bucket is written by several tasks and reads of one session
or trigram skip most row groups.  Only new messages and postings pass an exchange: what
a bucket keeps goes from its old files to the new ones without the sessions that are
replaced or deleted.  Unless there are more than ``FEW_IDS`` of these, they are broadcast;
sessions are sorted by ``last_at``, in small row groups, so a ``since`` filter skips
most of them.  Roll-ups are maintained by difference: what the touched
sessions have now, less what they had (see ``chatlake.store.rollups``).
"""

from __future__ import annotations

import json
import os
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schema as SC
from chatlake.store import incremental as INC
from chatlake.store import postings as PO
from chatlake.store import rollups as RU

DEFAULT_BUCKETS = 64
MAX_FOLDERS = 8
FEW_IDS = 200_000                 # ids of replaced and deleted sessions that may be broadcast
SESSION_ROW_GROUP = 4 << 20       # bytes; sessions are narrow, a row group still holds some ten thousand
# key and schema of every table
TABLES = {
    "session": ("id", SC.STORED_SESSION), "message": ("session_id", SC.MESSAGE), "session_file": ("session_id", SC.SESSION_FILE),
    "manifest": ("path", SC.MANIFEST), "session_usage": ("session_id", SC.SESSION_USAGE), "session_day": ("session_id", SC.SESSION_DAY),
    "usage": ("directory", SC.USAGE), "daily": ("directory", SC.DAILY), "posting": ("session_id", SC.POSTING),
}


class CommitConflict(RuntimeError):
    """Another writer has published this version; nothing was changed."""


def bucket_of(col: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(buckets)).cast("int")


@dataclass
class Change:
    """What a commit does.  Every DataFrame is read several times: give what is stored
    or cheap to compute.  ``None`` stands for no rows."""

    sessions: DataFrame | None = None      # put in place of those with the same id
    messages: DataFrame | None = None      # all messages of the sessions in ``whole``
    whole: DataFrame | None = None         # (id); None: all of ``sessions``
    appended: DataFrame | None = None      # further messages of the other sessions
    facts: DataFrame | None = None         # narrow columns of messages and appended ones; None: from these
    texts: DataFrame | None = None         # (session_id, content) of the same
    files: DataFrame | None = None         # (session_id, path)
    manifest: DataFrame | None = None      # (path, source, mtime_ms) to record
    forget: DataFrame | None = None        # (path)
    removed: DataFrame | None = None       # (id)
    streams: dict = field(default_factory=dict)   # name: last batch


class TableSet:
    def __init__(self, spark: SparkSession, root: str, buckets: int = DEFAULT_BUCKETS, postings: bool = False):
        """``buckets`` and ``postings`` (keep trigram postings) count for a new
        store; an existing one keeps its own."""
        self.spark, self.root, self._new = spark, root.rstrip("/"), (buckets, postings)

    @property
    def buckets(self) -> int:
        return self._state()["n_buckets"]

    # ---- pointer ----------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self) -> list[int]:
        return sorted(int(x[2:-5]) for x in self._names(f"{self.root}/_pointer") if x.startswith("v=") and x.endswith(".json"))

    def _pointer(self, version: int) -> dict:
        fs, p = self._fs(f"{self.root}/_pointer/v={version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def pointer(self) -> dict | None:
        vs = self._versions()
        return self._pointer(vs[-1]) if vs else None

    def _state(self) -> dict:
        return self.pointer() or {"version": 0, "n_buckets": self._new[0], "postings": self._new[1], "tables": {}, "streams": {}}

    def _publish(self, version: int, state: dict) -> None:
        sc = self.spark.sparkContext
        fs, tmp = self._fs(f"{self.root}/_pointer/.{os.urandom(6).hex()}")
        _, to = self._fs(f"{self.root}/_pointer/v={version}.json")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        hadoop = sc._jvm.org.apache.hadoop.fs
        none = sc._gateway.new_array(getattr(hadoop.Options, "Rename"), 0)   # do not overwrite
        tmp, to = fs.makeQualified(tmp), fs.makeQualified(to)
        try:
            hadoop.FileContext.getFileContext(to.toUri(), sc._jsc.hadoopConfiguration()).rename(tmp, to, none)
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise CommitConflict(f"version {version} of {self.root} is there already") from e
            raise

    # ---- reads ------------------------------------------------------------

    def _read(self, table: str, buckets=None, state: dict | None = None) -> DataFrame:
        at = (state or self._state())["tables"].get(table, {})
        paths = [f"{self.root}/{table}/{folder}/bucket={b}" for b in sorted(at, key=int) if buckets is None or int(b) in buckets
                 for folder in at[b]]
        schema = TABLES[table][1]
        return self.spark.read.schema(schema).parquet(*paths) if paths else INC.empty(self.spark, schema)

    def sessions(self) -> DataFrame:
        return self._read("session").select(*SC.SESSION_COLS)

    def manifest(self) -> DataFrame:
        return self._read("manifest")

    def session_files(self) -> DataFrame:
        """``(session_id, path)``: the files that hold each session's lines."""
        return self._read("session_file")

    def messages(self, buckets: list[int] | None = None) -> DataFrame:
        """All messages, or those of some buckets (other buckets' files are not read)."""
        return self._read("message", None if buckets is None else set(buckets))

    def usage(self) -> DataFrame:
        """AGG5 / AGG9, kept up to date: turns and tokens by source, directory and model."""
        return self._read("usage")

    def daily(self) -> DataFrame:
        """AGG7 / AGG10, kept up to date, by UTC day: distinct sessions, user messages
        and assistant turns by source, directory and day."""
        return self._read("daily")

    def _buckets_of(self, ids: DataFrame, key: str, n: int) -> set[int]:
        # bounded by the number of buckets, so it can come to the driver
        return {r["b"] for r in ids.select(bucket_of(key, n).alias("b")).distinct().collect()}

    def session_messages(self, session_ids: list[str]) -> DataFrame:
        """Messages of the given sessions; only their buckets are read."""
        ids = self.spark.createDataFrame([(i,) for i in session_ids], "id string")
        return self.messages(self._buckets_of(ids, "id", self.buckets)).where(F.col("session_id").isin(session_ids))

    def messages_with(self, keywords: list[str]) -> DataFrame:
        """Messages of every session that can hold one of the keywords, found by the
        trigram postings; all messages where these can't tell (no postings, a
        keyword of fewer than three characters or with a wildcard).  The caller
        still matches the keywords."""
        st = self._state()
        grams = [PO.trigrams_of(k) for k in keywords]
        if not st["postings"] or not keywords or None in grams:
            return self._read("message", state=st)
        ids = PO.candidates(self._read("posting", state=st), grams)
        wanted = self._buckets_of(ids, "session_id", st["n_buckets"])
        return self._read("message", wanted, st).join(ids, "session_id", "left_semi")

    # ---- commit -----------------------------------------------------------

    def _write(self, table: str, df: DataFrame, folder: str, n: int, spread=None, order: list | None = None,
               options: dict | None = None, kept: DataFrame | None = None) -> set[int]:
        """Write rows by bucket into a new folder; the buckets that have rows.  ``spread``
        deals out ``df``; ``kept`` rows stay in the tasks that read them."""
        key, schema = TABLES[table]
        placed = lambda d: d.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn("bucket", bucket_of(key, n))
        df = spread(placed(df)) if spread else placed(df).repartition("bucket")
        if kept is not None:
            df = placed(kept).unionByName(df)
        if order:
            df = df.sortWithinPartitions("bucket", *order)
        path = f"{self.root}/{table}/{folder}"
        df.write.options(**(options or {})).partitionBy("bucket").parquet(path)
        return {int(x[7:]) for x in self._names(path) if x.startswith("bucket=")}

    def commit(self, change: Change) -> int:
        """SNK2-SNK6 in one version: upsert sessions, replace or add messages,
        record and forget files, delete sessions, keep roll-ups and postings."""
        spark, st = self.spark, self._state()
        v, n = st["version"] + 1, st["n_buckets"]
        folder = f"v={v}-{os.urandom(4).hex()}"
        none = lambda schema: INC.empty(spark, schema)
        ids = none("id string")
        sessions = change.sessions if change.sessions is not None else none(SC.STORED_SESSION)
        if "state" not in sessions.columns:
            sessions = sessions.withColumn("state", F.lit(None).cast(SC.SESSION_STATE))
        gone = change.removed.select("id").distinct() if change.removed is not None else ids
        whole = (change.whole if change.whole is not None else sessions).select("id").unionByName(gone).distinct()
        touched = sessions.select("id").unionByName(gone).distinct()
        messages = change.messages.select(*SC.MESSAGE_COLS) if change.messages is not None else none(SC.MESSAGE)
        appended = change.appended.select(*SC.MESSAGE_COLS) if change.appended is not None else none(SC.MESSAGE)
        facts = change.facts if change.facts is not None else messages.unionByName(appended)
        manifest = change.manifest if change.manifest is not None else none("path string, source string, mtime_ms long")
        paths = manifest.select("path")
        if change.forget is not None:
            paths = paths.unionByName(change.forget.select("path"))

        # the buckets to write, in one job
        def of(df, key, kind):
            return df.select(F.lit(kind).alias("kind"), bucket_of(key, n).alias("b"))
        at: dict[str, set[int]] = {"touched": set(), "whole": set(), "append": set(), "paths": set()}
        n_whole = 0
        for r in (of(touched, "id", "touched").unionAll(of(whole, "id", "whole")).unionAll(of(paths, "path", "paths"))
                  .unionAll(of(sessions.join(whole, "id", "left_anti"), "id", "append"))
                  .groupBy("kind", "b").agg(F.count(F.lit(1)).alias("n")).collect()):
            at[r["kind"]].add(r["b"])
            n_whole += r["n"] if r["kind"] == "whole" else 0
        tables = {t: dict(st["tables"].get(t, {})) for t in TABLES}
        old = lambda t, buckets: self._read(t, buckets, st)
        long = lambda t: {b for b in at["append"] if len(tables[t].get(str(b), [])) >= MAX_FOLDERS}
        tasks = max(len(at["touched"]), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        rid = whole.select(F.col("id").alias("session_id"))
        if n_whole <= FEW_IDS:
            rid = F.broadcast(rid)

        def replace(table, new, buckets, *layout, **more):
            """New content of whole buckets."""
            written = self._write(table, new, folder, n, *layout, **more)
            for b in buckets:
                tables[table].pop(str(b), None)          # a bucket may have become empty
            for b in written:
                tables[table][str(b)] = [*([] if b in buckets else tables[table].get(str(b), [])), folder]

        def put_sessions():
            rows = INC.upsert(INC.remove_keys(old("session", at["touched"]), touched, "id"), sessions, "id")
            replace("session", rows, at["touched"], None, [F.col("last_at").desc(), "id"], {"parquet.block.size": SESSION_ROW_GROUP})

        def put_messages():
            anew = at["whole"] | long("message")
            kept = INC.remove_keys(old("message", anew), rid, "session_id")
            replace("message", messages.unionByName(appended), anew,
                    lambda d: d.repartitionByRange(tasks, "bucket", "session_id", "position"), ["session_id", "position"], kept=kept)

        def put_files():
            new = change.files.select("session_id", "path") if change.files is not None else none(SC.SESSION_FILE)
            buckets = at["touched"]
            replace("session_file", INC.remove_keys(old("session_file", buckets), rid, "session_id").unionByName(new).distinct(), buckets)

        def put_grain(table, new, merge):
            buckets = at["touched"]
            replace(table, merge(INC.remove_keys(old(table, buckets), rid, "session_id").unionByName(new)), buckets)

        def put_postings():
            texts = change.texts if change.texts is not None else messages.unionByName(appended)
            anew = at["whole"] | long("posting")
            kept, new = INC.remove_keys(old("posting", anew), rid, "session_id"), PO.postings(texts)
            if at["append"] or any(len(tables["posting"].get(str(b), [])) > 1 for b in anew):
                # what appended sessions have may be stored already, in one or more folders
                kept, new = None, kept.unionByName(new)
            replace("posting", new, anew, lambda d: PO.dealt(d, tasks, max(PO.PARTS, tasks // n)), ["trigram", "session_id"], kept=kept)

        def put_manifest():
            rows = INC.remove_keys(old("manifest", at["paths"]), paths, "path").unionByName(
                manifest.select("path", "source", "mtime_ms", F.current_timestamp().alias("indexed_at")))
            replace("manifest", rows, at["paths"])

        jobs = [put_manifest] if at["paths"] else []
        if at["touched"]:
            jobs += [put_sessions, put_messages, put_files, lambda: put_grain("session_usage", RU.usage_grain(facts), RU.merged_usage),
                     lambda: put_grain("session_day", RU.day_grain(facts), RU.merged_days)]
            jobs += [put_postings] if st["postings"] else []
        _together(jobs)

        if at["touched"]:
            now = {"tables": tables}

            def put_rollup(table, grain, totals, apply):
                named = touched.select(F.col("id").alias("session_id"))
                had = totals(old(grain, at["touched"]).join(named, "session_id", "left_semi"), old("session", at["touched"]))
                has = totals(self._read(grain, at["touched"], now).join(named, "session_id", "left_semi"), self._read("session", at["touched"], now))
                delta = RU.difference(has, had)
                buckets = self._buckets_of(delta, "directory", n)
                if buckets:
                    replace(table, apply(old(table, buckets).unionByName(delta)), buckets)

            _together([lambda: put_rollup("usage", "session_usage", RU.usage_totals, RU.applied_usage),
                       lambda: put_rollup("daily", "session_day", RU.day_totals, RU.applied_days)])
        self._publish(v, {"version": v, "n_buckets": n, "postings": st["postings"], "tables": {t: x for t, x in tables.items() if x},
                          "streams": {**st["streams"], **change.streams}, "committed_ms": int(time.time() * 1000)})
        return v

    def upsert_sessions(self, rows: DataFrame) -> int:
        """SNK2 alone: replace or add session rows; messages and manifest stay."""
        return self.commit(Change(sessions=rows.select(*SC.SESSION_COLS), whole=INC.empty(self.spark, "id string")))

    def remove_sessions(self, ids: DataFrame) -> int:
        """SNK4 on the stored tables: delete sessions (column id) and their messages."""
        from chatlake.session import checkpointed

        return self.commit(Change(removed=checkpointed(ids.select("id").distinct())))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders and buckets that the last ``keep`` pointers don't name,
        what crashed runs left included."""
        versions = self._versions()
        live, used = versions[-keep:], set()
        for v in live:
            for table, at in self._pointer(v)["tables"].items():
                used |= {f"{table}/{folder}/bucket={b}" for b, folders in at.items() for folder in folders}
        newest, out = max(versions, default=0), []

        def drop(rel):
            fs, p = self._fs(f"{self.root}/{rel}")
            fs.delete(p, True)
            out.append(rel)

        for v in versions[:-keep]:
            drop(f"_pointer/v={v}.json")
        for table in TABLES:
            for name in self._names(f"{self.root}/{table}"):
                if int(name[2:].split("-")[0]) > newest:
                    continue               # a later run may be writing it
                inner = [x for x in self._names(f"{self.root}/{table}/{name}") if x.startswith("bucket=")]
                unused = [x for x in inner if f"{table}/{name}/{x}" not in used]
                if len(unused) == len(inner):
                    drop(f"{table}/{name}")
                else:
                    for x in unused:
                        drop(f"{table}/{name}/{x}")
        return sorted(out)


def _together(jobs: list) -> None:
    """Run independent writes side by side; the first failure is raised."""
    if len(jobs) < 2:
        for j in jobs:
            j()
        return
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(j) for j in jobs]:
            done.result()
