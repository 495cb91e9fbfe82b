"""The incremental index run over both sources (SNK10, SNK11).

Every changed file is scanned and parsed once: the parsed lines are staged as Parquet
in the shared folder, without the text of lines that are no message, and all else
is derived from their columns.  Counts are observed on the writes themselves.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatlake import schema as SC
from chatlake.functions import text as TX
from chatlake.operators.sessionize import assign_positions, older_files, sessionize
from chatlake.session import checkpointed, scratch_path, staged
from chatlake.sources import relational as RL
from chatlake.sources import transcripts as TR
from chatlake.store import incremental as INC
from chatlake.store.layout import DEFAULT_BUCKETS, Change, CommitConflict, TableSet

__all__ = ["DEFAULT_BUCKETS", "Change", "CommitConflict", "RelationalStore", "TableSet", "run_index", "stage"]

MAX_LISTED = 10_000   # files that one scan names
ATTEMPTS = 3          # runs, where another writer was faster
SOURCE = "claude-code"
REJECTS = ("blank", "malformed", "too_long")


@dataclass
class RelationalStore:
    """A relational session store as three DataFrames.  ``name`` stands for it
    in the manifest; its modification time is its newest row's."""

    session: DataFrame
    message: DataFrame
    part: DataFrame
    name: str = "relational-store"

    def listed(self) -> DataFrame:
        """One row: (path, mtime_ms)."""
        times = [self.session.select(F.max("time_updated").alias("t")), self.session.select(F.max("time_archived").alias("t")),
                 self.part.select(F.max("time_created").alias("t"))]
        rows = times[0].unionByName(times[1]).unionByName(times[2])
        return rows.agg(F.coalesce(F.max("t"), F.lit(0)).cast("long").alias("mtime_ms")).select(F.lit(self.name).alias("path"), "mtime_ms")


def parsed_messages(lines: DataFrame, slug_map: dict[str, str] | None = None) -> DataFrame:
    """Parsed lines with ``usable``, the title text of user lines, the directory, and the
    text of usable lines only."""
    p = TR.clean(TR.parse_lines(lines))
    ok = F.coalesce(F.col("msg_type").isin(*TR.USABLE_TYPES) & TX.usable_content("content") & F.col("session_id").isNotNull(), F.lit(False))
    return p.withColumn("usable", ok).withColumn(
        "title", F.when(ok & (F.col("role") == "user"), TX.normalize_title("content"))).withColumn(
        "content", F.when(ok, F.col("content"))).withColumn("directory", TR.directory_of_path("path", slug_map))


def stage(lines: DataFrame, path: str, counts: dict | None = None, slug_map: dict[str, str] | None = None) -> DataFrame:
    """Parse lines once: written to ``path`` (further rows, if it exists) and read back."""
    df, seen = parsed_messages(lines, slug_map), Observation()
    found = df.observe(seen, *[F.count_if(F.col("reject") == r).alias(r) for r in REJECTS])
    found.write.mode("append").parquet(path)
    for k, v in seen.get.items():
        if counts is not None and v:
            counts[k] = counts.get(k, 0) + v
    return lines.sparkSession.read.schema(df.schema).parquet(path)


def _stage_files(spark: SparkSession, root: str, glob: str, files: DataFrame, path: str, counts: dict, slug_map) -> DataFrame:
    """Stage the lines of files (uri, path), MAX_LISTED files a scan, each of the folders
    that hold its files."""
    folder = F.regexp_extract("path", "(?s)^(.*)/[^/]+$", 1)
    group, out = [], None

    def scan():
        lines = TR.scan_lines(spark, root, glob, [u for u, _ in group], sorted({f for _, f in group}))
        return stage(lines, path, counts, slug_map)

    for r in files.select("uri", folder.alias("folder")).orderBy("folder", "uri").toLocalIterator():
        group.append((r["uri"], r["folder"]))
        if len(group) == MAX_LISTED:
            out, group = scan(), []
    return scan() if group or out is None else out


def run_index(spark: SparkSession, transcripts_root: str | None, store: TableSet, force: bool = False,
              merge_files: bool = False, relational: RelationalStore | None = None, purge: bool = False,
              glob: str = "*.jsonl", slug_map: dict[str, str] | None = None) -> dict:
    """SNK10: one incremental run over both sources; returns counts and the
    lines rejected by reason.

    Files that hold a session of a changed file are read along with it, so a
    session in several files comes out as in a full run.  ``force`` reads
    everything again, the relational store too.  Of the relational store only
    sessions that are new or updated since they were indexed are read.  ``purge`` drops the
    sessions of which no file is listed any more, and the relational ones that are
    archived or gone.  ``slug_map`` names the directories of
    project slugs that the rule gets wrong (S15).  A file that can't be read to its
    end is left out, stays unrecorded and is tried again by the next run.  Where
    another writer commits meanwhile the run starts again from the new state.
    """
    for left in reversed(range(ATTEMPTS)):
        try:
            return _run(spark, transcripts_root, store, force, merge_files, relational, purge, glob, slug_map)
        except CommitConflict:
            if not left:
                raise


def _run(spark, transcripts_root, store, force, merge_files, relational, purge, glob, slug_map) -> dict:
    t0 = time.time()
    manifest = store.manifest()
    listed = spark.createDataFrame([], "path string, uri string, mtime_ms long, size long")
    if transcripts_root:
        listed = TR.list_files(spark, transcripts_root, glob).select("path", "uri", "mtime_ms", "size")
    if relational:
        listed = listed.unionByName(relational.listed().withColumns({"uri": F.lit(None).cast("string"), "size": F.lit(0).cast("long")}))
    watch = Observation()
    is_text = F.col("uri").isNotNull()
    files = staged(INC.file_status(listed, manifest, force).observe(
        watch, F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status").isNotNull()).alias("changed"),
        F.count_if(F.col("status").isNotNull() & is_text).alias("texts")), "index-files")
    seen = watch.get
    changed = files.where(F.col("status").isNotNull())
    # a manifest row of the other source is none of this run's business
    mine = manifest if relational else manifest.where(F.col("source") != RL.SOURCE)
    stale = INC.stale_files(mine, files).select("path")
    change, counts, failed = Change(forget=stale), {}, 0
    sessions = messages = facts = texts = held = feed = None
    if relational and not force and (seen["changed"] > seen["texts"] or purge):
        marks = store.sessions().where(F.col("source") == RL.SOURCE).select("id", "last_at")
        feed = checkpointed(RL.session_changes(relational.session, marks))
    if seen["texts"]:
        todo = changed.where(is_text)
        lines = _stage_files(spark, transcripts_root, glob, todo, scratch_path(spark, "index-lines"), counts, slug_map)
        # files that gave fewer bytes than they have: try again another time
        read = lines.groupBy("path").agg(F.sum("bytes").alias("bytes"))
        bad = checkpointed(todo.join(read, "path", "left").where(F.col("size") > F.coalesce("bytes", F.lit(0))).select("path"))
        failed = bad.count()
        if failed:
            lines, changed, todo = (df.join(bad, "path", "left_anti") for df in (lines, changed, todo))
        msgs = lines.where("usable")
        if store.pointer():
            # unchanged files that hold sessions of the changed ones
            known = store.session_files()
            touched = msgs.select("session_id").unionByName(known.join(todo, "path", "left_semi").select("session_id")).distinct()
            siblings = (known.join(touched, "session_id", "left_semi").select("path").distinct().join(todo, "path", "left_anti")
                        .join(files.where(is_text).select("path", "uri"), "path"))
            siblings = checkpointed(siblings)
            if not siblings.isEmpty():
                more = _stage_files(spark, transcripts_root, glob, siblings, scratch_path(spark, "index-siblings"), {}, slug_map)
                msgs = msgs.unionByName(more.where("usable").join(touched, "session_id", "left_semi"))
        held = staged(msgs.groupBy("session_id", "path").agg(F.max("mtime_ms").alias("mtime_ms")), "index-held")
        if not merge_files:
            msgs = msgs.join(older_files(held), ["session_id", "path"], "left_anti")
        sessions = sessionize(msgs, state=True).drop("first")
        messages = assign_positions(msgs).select(*SC.MESSAGE_COLS)
        facts = msgs.select("session_id", "role", "model", *SC.TOKENS, "timestamp_ms")
        texts = msgs.select("session_id", "content")
    if relational and seen["changed"] > seen["texts"]:
        rel = (relational.session, relational.message, relational.part)
        if feed is not None:
            rel = RL.of_sessions(*rel, feed.where(F.col("status").isin("new", "changed")))
        rows = RL.relational_sessions(*rel).withColumn("state", F.lit(None).cast(SC.SESSION_STATE))
        more = staged(RL.relational_messages(*rel), "index-relational")
        sessions = rows if sessions is None else sessions.unionByName(rows)
        messages = more if messages is None else messages.unionByName(more)
        narrow = more.select("session_id", "role", "model", *SC.TOKENS, "timestamp_ms")
        facts = narrow if facts is None else facts.unionByName(narrow)
        texts = more.select("session_id", "content") if texts is None else texts.unionByName(more.select("session_id", "content"))
    n_sessions = 0
    if sessions is not None:
        count = Observation()
        sessions = staged(sessions.observe(count, F.count(F.lit(1)).alias("n")), "index-sessions")
        n_sessions = count.get["n"]
    if purge:
        stored = store.session_files()
        alive = (stored if held is None else INC.replace_groups(stored, held.select("session_id", "path"), "session_id")).join(
            files.select("path"), "path", "left_semi")
        change.removed = checkpointed(stored.select(F.col("session_id").alias("id")).distinct().join(
            alive.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti").unionByName(
            INC.empty(spark, "id string") if feed is None else feed.where(F.col("status").isin("archived", "vanished")).select("id")))
    source = F.when(F.col("uri").isNull(), F.lit(RL.SOURCE)).otherwise(F.lit(SOURCE))
    change.manifest = changed.select("path", source.alias("source"), "mtime_ms")
    change.sessions, change.messages, change.facts, change.texts, change.files = sessions, messages, facts, texts, held
    n_changed = seen["changed"] - failed
    if n_changed or not stale.isEmpty() or (purge and not change.removed.isEmpty()):
        store.commit(change)
    return {"files_checked": seen["checked"], "files_indexed": n_changed, "files_failed": failed, "sessions_indexed": n_sessions,
            "lines_rejected": counts, "elapsed_ms": int((time.time() - t0) * 1000)}
