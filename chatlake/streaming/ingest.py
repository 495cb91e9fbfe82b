"""STR1: streaming ingest of immutable transcript drops.

The file stream source only picks up *new* files (a file that grows in
place is not re-read), so this suits drops that never change after they
land; appended-in-place transcripts go through the batch manifest path
(``chatlake.store.tables.run_index``).

A session may be cut over several drops.  With ``merge_files`` (the default here) a
later drop goes on where the earlier ones ended: the stored session carries its
number of messages and the places of its last message, title and branch
(``schema.SESSION_STATE``), so its further messages are numbered from there and
added to their bucket as a new folder; no stored message is read.  Messages that
belong before the stored ones (a drop that arrives late) make that session alone be
read and numbered anew, by time, then arrival.  Without ``merge_files`` the latest file
by ``(mtime, path)`` holds a session (S9), whatever order the drops arrive in.

A micro-batch is parsed once and committed as one version that records the batch id
under the ingest's ``name``: a batch that was committed before changes nothing.
Paths, times and session files are those that a batch run writes, so a ``run_index``
over the same root finds nothing to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schema as SC
from chatlake.operators.ranking import sequence_within
from chatlake.operators.sessionize import assign_positions, older_files, sessionize
from chatlake.session import checkpoint_dir, scratch_path, staged
from chatlake.sources import transcripts as TR
from chatlake.store.tables import SOURCE, Change, TableSet, stage



def transcript_stream(spark: SparkSession, root: str, glob: str = "*.jsonl",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """``(path, mtime_ms, block, line_no, bytes, value)`` rows of newly dropped files."""
    reader = spark.readStream.format("text").option("pathGlobFilter", glob).option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(root)
    return df.select(
        TR._plain(F.col("_metadata.file_path")).alias("path"),
        F.unix_millis(F.col("_metadata.file_modification_time")).alias("mtime_ms"),
        F.col("_metadata.file_block_start").alias("block"),
        # streams allow no monotonically_increasing_id: a content hash is a
        # deterministic tie-break; foreachBatch restores offset order
        F.xxhash64("value").alias("line_no"),
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
        F.rtrim(F.ltrim("value", F.lit("﻿")), F.lit("\r")).alias("value"))


def _earlier(a: Column, b: Column) -> Column:
    """a is a place and comes no later than b, or b is none."""
    return a.isNotNull() & (b.isNull() | (a <= b))


def _continued(new: DataFrame, old: DataFrame) -> DataFrame:
    """Session rows after a batch (``new``) is added to the stored ones (``old``), and
    how: ``late`` where messages of the batch belong before stored ones, ``from_n``
    the first position of the others."""
    was = old.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in SC.SESSION_COLS[1:]], F.col("state").alias("_state"))
    j = new.join(was, F.col("id") == F.col("_id"), "left")
    known = F.col("_id").isNotNull()
    title_old = _earlier(F.col("_state.title"), F.col("state.title"))
    branch_old = _earlier(F.col("_state.branch"), F.col("state.branch"))
    file_old = F.coalesce(F.col("_state.file") >= F.col("state.file"), F.lit(False))
    state = F.when(~known, F.col("state")).otherwise(F.struct(
        (F.coalesce(F.col("_state.n"), F.lit(0)) + F.col("state.n")).alias("n"),
        F.greatest("_state.last", "state.last").alias("last"),
        F.when(title_old, F.col("_state.title")).otherwise(F.col("state.title")).alias("title"),
        F.when(branch_old, F.col("_state.branch")).otherwise(F.col("state.branch")).alias("branch"),
        F.when(file_old, F.col("_state.file")).otherwise(F.col("state.file")).alias("file")))
    return j.select(
        "id", F.coalesce("_source", "source").alias("source"),
        F.when(file_old, F.col("_directory")).otherwise(F.col("directory")).alias("directory"),
        F.when(branch_old, F.col("_branch")).otherwise(F.col("branch")).alias("branch"),
        F.when(title_old, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.coalesce("_parent_id", "parent_id").alias("parent_id"),
        F.least("_started_at", "started_at").alias("started_at"), F.greatest("_last_at", "last_at").alias("last_at"),
        (F.coalesce("_message_count", F.lit(0)) + F.col("message_count")).cast("int").alias("message_count"),
        state.alias("state"), F.coalesce(F.col("first") < F.col("_state.last"), F.lit(False)).alias("late"),
        F.coalesce(F.col("_state.n"), F.lit(0)).cast("int").alias("from_n"))


def _merged(store: TableSet, msgs: DataFrame) -> Change:
    """Go on with stored sessions."""
    new = staged(sessionize(msgs, state=True), "stream-sessions")
    at = store._buckets_of(new, "id", store.buckets)
    old = store._read("session", at).join(new.select("id"), "id", "left_semi")
    rows = staged(_continued(new, old), "stream-continued")
    late = rows.where("late").select(F.col("id").alias("session_id"))
    numbered = assign_positions(msgs).select(*SC.MESSAGE_COLS).join(
        rows.select(F.col("id").alias("session_id"), "late", "from_n"), "session_id")
    further = numbered.where("NOT late").withColumn("position", F.col("position") + F.col("from_n")).select(*SC.MESSAGE_COLS)
    change = Change(sessions=rows.drop("late", "from_n"), whole=rows.where("late").select("id"), appended=further)
    change.facts, change.texts = (msgs.select("session_id", "role", "model", *SC.TOKENS, "timestamp_ms"), msgs.select("session_id", "content"))
    if not late.isEmpty():
        stored = store.messages(sorted(store._buckets_of(late, "session_id", store.buckets))).join(late, "session_id", "left_semi")
        both = stored.select(*SC.MESSAGE_COLS, F.lit(0).alias("arrived")).unionByName(
            numbered.where("late").select(*SC.MESSAGE_COLS, F.lit(1).alias("arrived"))).withColumnRenamed("position", "was")
        minute = F.struct(F.col("timestamp_ms").isNull().alias("no_time"), F.floor(F.col("timestamp_ms") / 60000).alias("minute"))
        again = sequence_within(both, "session_id", minute, [F.col("timestamp_ms").asc_nulls_last(), "arrived", "was"])
        # staged: the bucket that it is read from is written by the same commit
        change.messages = staged(again.select(*SC.MESSAGE_COLS), "stream-late")
        # grain and postings of a session that is replaced come from all its messages
        on_time = rows.where("NOT late").select(F.col("id").alias("session_id"))
        change.facts = change.facts.join(on_time, "session_id", "left_semi").unionByName(change.messages.select(*change.facts.columns))
        change.texts = change.texts.join(on_time, "session_id", "left_semi").unionByName(change.messages.select("session_id", "content"))
    return change


def _latest(store: TableSet, msgs: DataFrame) -> Change:
    """A session is what its latest file by (mtime, path) holds."""
    msgs = msgs.join(older_files(msgs), ["session_id", "path"], "left_anti")
    new = staged(sessionize(msgs, state=True).drop("first"), "stream-sessions")
    at = store._buckets_of(new, "id", store.buckets)
    newer = store._read("session", at).select("id", F.col("state.file").alias("file")).join(
        new.select("id", F.col("state.file").alias("mine")), "id").where(F.col("file") > F.col("mine")).select("id")
    msgs = msgs.join(newer.withColumnRenamed("id", "session_id"), "session_id", "left_anti")
    return Change(sessions=new.join(newer, "id", "left_anti"), messages=assign_positions(msgs).select(*SC.MESSAGE_COLS),
                  facts=msgs.select("session_id", "role", "model", *SC.TOKENS, "timestamp_ms"), texts=msgs.select("session_id", "content"))


def upsert_batch(store: TableSet, merge_files: bool = True, name: str = "ingest", slug_map: dict[str, str] | None = None):
    """``foreachBatch`` callback: index the batch's lines and commit them once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if store._state()["streams"].get(name, -1) >= batch_id:
            return
        spark = batch.sparkSession
        lines = stage(batch.withColumn("line_no", F.monotonically_increasing_id()), scratch_path(spark, "stream-lines"), slug_map=slug_map)
        msgs = lines.where("usable")
        change = (_merged if merge_files else _latest)(store, msgs)
        held = staged(msgs.select("session_id", "path").distinct(), "stream-files")
        # the files that held a session before are its files too
        before = store._read("session_file", store._buckets_of(held, "session_id", store.buckets))
        change.files = held.unionByName(before.join(held.select("session_id"), "session_id", "left_semi"))
        change.manifest = lines.groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms")).withColumn("source", F.lit(SOURCE))
        change.streams = {name: batch_id}
        store.commit(change)
    return run


def start_ingest(spark: SparkSession, root: str, store: TableSet, checkpoint: str,
                 available_now: bool = True, processing_time: str | None = None, glob: str = "*.jsonl",
                 merge_files: bool = True, name: str = "ingest", max_files_per_trigger: int | None = None,
                 slug_map: dict[str, str] | None = None):
    """Start STR1; ``available_now`` processes what is there and stops.  ``name`` stands
    for the stream in the store: one per checkpoint."""
    checkpoint_dir(spark)
    w = transcript_stream(spark, root, glob, max_files_per_trigger).writeStream.foreachBatch(
        upsert_batch(store, merge_files, name, slug_map)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()
