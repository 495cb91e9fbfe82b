"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame``
per operator group of the inventory, each over the whole driver tables."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions import json as JS
from chatlake.functions import text as TX
from chatlake.functions import time as TM
from chatlake.operators import search as SR
from chatlake.operators import sessionize as SZ
from chatlake.operators import sessions as SS
from chatlake.operators import filters as FL
from chatlake.operators import tree as TRE
from chatlake.operators import usage as US
from chatlake.plans import params as P
from chatlake.sources import driver_views as DV
from chatlake.sources import relational as RL
from chatlake.sources import transcripts as TR
from chatlake.session import scratch_path
from chatlake.store import incremental as INC
from chatlake.store.output import as_json_lines
from chatlake.store.tables import RelationalStore, TableSet, run_index
from chatlake import schema as SC

Query = Callable[[SparkSession, str], DataFrame]


def _mv(spark, d):
    return DV.views(spark, d)


def search_keyword(spark, d):
    m, s = _mv(spark, d)
    return SR.search_sessions(m, s, P.KW_ONE, limit=P.SEARCH_LIMIT)


def search_multi_keyword(spark, d):
    m, s = _mv(spark, d)
    return SR.search_sessions(m, s, P.KW_MULTI, limit=P.SEARCH_LIMIT)


def search_scoped_since(spark, d):
    m, s = _mv(spark, d)
    return SR.search_sessions(m, s, P.KW_SCOPED, source=P.SOURCE, scope=P.SCOPE,
                              since_ms=P.SINCE_MS, limit=P.SEARCH_LIMIT)


def search_context(spark, d):
    m = DV.message_view(spark, d)
    return SR.search_context(m, P.CONTEXT_KW, P.CONTEXT_RADIUS)


def list_sessions(spark, d):
    _, s = _mv(spark, d)
    return SS.list_sessions(s, limit=P.LIST_LIMIT)


def session_report(spark, d):
    _, s = _mv(spark, d)
    return SS.session_report(SS.list_sessions(s, limit=P.LIST_LIMIT), P.NOW_MS)


def sessions_by_file(spark, d):
    m, s = _mv(spark, d)
    return SR.sessions_by_file(m, s, P.FILE_NEEDLE, limit=P.SEARCH_LIMIT)


def read_messages(spark, d):
    m = DV.message_view(spark, d)
    return SS.read_messages(m, P.READ_PREFIX, from_=P.READ_FROM, to=P.READ_TO)


def read_around(spark, d):
    m = DV.message_view(spark, d)
    return SS.read_messages(m, P.AROUND_PREFIX, around=P.AROUND_AT, radius=P.AROUND_RADIUS,
                            role=P.AROUND_ROLE)


def skim_all(spark, d):
    m = DV.message_view(spark, d)
    return SS.skim(m, P.SKIM_HEAD, P.SKIM_TAIL)


def preview_lines(spark, d):
    m = DV.message_view(spark, d)
    return SS.preview(m, P.PREVIEW_HEAD, P.PREVIEW_TAIL, P.PREVIEW_MAX_LINES)


def model_usage(spark, d):
    m, s = _mv(spark, d)
    return US.model_usage(m, s)


def daily_activity(spark, d):
    m, s = _mv(spark, d)
    return US.daily_activity(m, s)


def daily_last14(spark, d):
    return US.last_days(daily_activity(spark, d), P.LAST_DAYS)


def json_extract(spark, d):
    ev = DV.read_table(spark, d, "events")
    return ev.select("event_id", JS.json_str("props", "$.k").alias("k_text"),
                     JS.json_bigint("props", "$.k").alias("k"))


def _parsed_raw(spark, d):
    return TR.parse_lines(DV.raw_view(spark, d))


def parse_filter_raw(spark, d):
    return TR.clean(TR.usable(_parsed_raw(spark, d))).select(
        "session_id", "msg_type", "role", "content", "ts", "timestamp_ms", "model",
        "output_tokens", "cache_read", "cache_write")


def model_usage_raw(spark, d):
    return US.raw_model_usage(_parsed_raw(spark, d))


def sessionize(spark, d):
    return SZ.index_sessions(DV.raw_view(spark, d))


def index_messages(spark, d):
    return SZ.index_messages(DV.raw_view(spark, d))


def prefix_owner(spark, d):
    prefixes = DV.message_view(spark, d).select(
        F.substring("session_id", 1, P.OWNER_PREFIX_LEN).alias("prefix")).distinct()
    return SZ.prefix_owner(_parsed_raw(spark, d), prefixes)


def changed_files(spark, d):
    return INC.changed_files(DV.files_view(spark, d), DV.manifest_view(spark, d))


def stale_files(spark, d):
    return INC.stale_files(DV.manifest_view(spark, d), DV.files_view(spark, d))


def manifest_upsert(spark, d):
    files, manifest = DV.files_view(spark, d), DV.manifest_view(spark, d)
    return INC.next_manifest(manifest, files, INC.changed_files(files, manifest))


def _session_versions(spark, d):
    _, s = _mv(spark, d)
    cid = F.col("conv_id")
    old = s.where(cid % 5 != 4).select(*SC.SESSION_COLS)
    new = s.where((cid % 2 == 0) | (cid % 5 == 4)).select(
        *[F.concat(F.lit("v2 "), F.col("title")).alias("title") if c == "title"
          else (F.col("message_count") + 1).alias("message_count") if c == "message_count"
          else F.col(c) for c in SC.SESSION_COLS])
    return old, new


def session_upsert(spark, d):
    old, new = _session_versions(spark, d)
    return INC.upsert(old, new, "id")


def message_replace(spark, d):
    m = DV.message_view(spark, d)
    old = m.select(*SC.MESSAGE_COLS)
    new = m.where((F.col("conv_id") % 2 == 0) & (F.col("position") < 2)).select(
        *[F.concat(F.lit("[v2] "), F.col("content")).alias("content") if c == "content" else F.col(c)
          for c in SC.MESSAGE_COLS])
    return INC.replace_groups(old, new, "session_id")


def text_parts(spark, d):
    return RL.relational_messages(*DV.relational_views(spark, d))


def sessionize_parts(spark, d):
    return RL.relational_sessions(*DV.relational_views(spark, d))


def message_counts(spark, d):
    rs, rm, _ = DV.relational_views(spark, d)
    return RL.list_roots_with_counts(rs, rm)


def merge_sources(spark, d):
    _, s = _mv(spark, d)
    claude = s.where(F.col("source") == "claude-code")
    oc = RL.relational_sessions(*DV.relational_views(spark, d, own_sessions=True))
    return SS.merge_sources(claude, oc, limit=P.LIST_LIMIT)


def dedupe_sessions(spark, d):
    old, new = _session_versions(spark, d)
    both = old.withColumn("ord", F.lit(0)).unionByName(new.withColumn("ord", F.lit(1)))
    return SS.dedupe_first(both, "id", ["ord"]).drop("ord")


def distinct_first_hit(spark, d):
    rs, rm, rp = DV.relational_views(spark, d)
    return RL.first_hits(rs, rm, rp, P.KW_ONE)


def usage_merge(spark, d):
    m, s = _mv(spark, d)
    asst = m.where(F.col("model").isNotNull() & (F.col("role") == "assistant"))
    return US.merge_model_usage(US.project_model_usage(asst, s))


def daily_merge(spark, d):
    m, s = _mv(spark, d)
    return US.merge_daily(US.project_session_days(m, s))


def project_rollup(spark, d):
    _, s = _mv(spark, d)
    return TRE.project_rollup(s)


def tree_rows(spark, d):
    _, s = _mv(spark, d)
    return TRE.tree_rows(s)


def flat_rows(spark, d):
    _, s = _mv(spark, d)
    return TRE.flat_rows(s)


def flat_filter(spark, d):
    _, s = _mv(spark, d)
    return TRE.flat_rows(FL.text_filter(s, P.FILTER_TEXT))


def project_filter(spark, d):
    _, s = _mv(spark, d)
    return TRE.tree_rows(TRE.project_sessions(s, P.PROJECT_FILTER_TEXT))


def lineage(spark, d):
    _, s = _mv(spark, d)
    return TRE.lineage(s)


def lineage_rows(spark, d):
    _, s = _mv(spark, d)
    return TRE.lineage_rows(s)


def lineage_cycles(spark, d):
    """Sessions without a root, on parents of which some are tied to cycles."""
    _, s = _mv(spark, d)
    cid = F.col("conv_id")
    tied = F.when(cid % 240 < 20, DV.conv_key(cid + 40)).when((cid % 240).between(60, 79), DV.conv_key(cid - 60)).otherwise(F.col("parent_id"))
    return TRE.cycles(s.withColumn("parent_id", tied))


def search_window(spark, d):
    m, s = _mv(spark, d)
    return SR.search_sessions(m, s, P.KW_ONE, limit=None)


def all_sessions(spark, d):
    _, s = _mv(spark, d)
    return SS.list_sessions(s, limit=None)


def recent_per_project(spark, d):
    _, s = _mv(spark, d)
    return SS.top_per_group(SS.session_list(s), "directory",
                            [F.col("last_at").desc_nulls_last(), F.col("id")], P.PER_PROJECT_K)


def scope_bidirectional(spark, d):
    _, s = _mv(spark, d)
    return SS.list_sessions(FL.filter_sessions(s, scope=P.BIDI_SCOPE, bidirectional=True), limit=None)


def usage_report(spark, d):
    m, s = _mv(spark, d)
    u = US.model_usage(m, s)
    return u.select("model", "turns",
                    TX.scaled_tokens("output_tokens", 1_000_000, "M").alias("out"),
                    TX.scaled_tokens("cache_read", 1_000_000_000, "B").alias("cache_r"),
                    TX.scaled_tokens("cache_write", 1_000_000, "M").alias("cache_w"))


def session_removal(spark, d):
    m = DV.message_view(spark, d)
    gone = m.where(F.col("conv_id") % 10 == 0).select("session_id")
    return INC.remove_keys(m.select(*SC.MESSAGE_COLS), gone, "session_id")


def daily_activity_raw(spark, d):
    return US.raw_daily_activity(_parsed_raw(spark, d))


def index_stats(spark, d):
    files, manifest = DV.files_view(spark, d), DV.manifest_view(spark, d)
    sessions = SZ.index_sessions(DV.raw_view(spark, d))
    return INC.run_stats(files, INC.changed_files(files, manifest), sessions)


class _Crashing(TableSet):
    """A writer that dies after its files are written, before it publishes them."""

    def _publish(self, version, state):
        raise ConnectionError("the writer is gone")


def _indexed_store(spark, d, postings=False, crash=False):
    """A stored index made by two real runs: the transcripts of all sessions that the
    relational store does not own, as files; then one project's files replaced
    (every text gets a prefix), and the relational store added.  ``crash``: a run
    that fails before its commit comes between the two."""
    root = scratch_path(spark, "store-query")
    cid = (F.col("mtime_ms") - DV.EPOCH_BASE_MS) / DV.MS_PER_CONVERSATION
    lines = DV.raw_view(spark, d).where(cid % 4 != 0).select(TR.slug_of_path("path").alias("slug"), "value")

    def write(df):
        (df.repartition("slug").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("slug").text(f"{root}/projects"))

    write(lines)
    store = TableSet(spark, f"{root}/index", buckets=P.STORE_BUCKETS, postings=postings)
    run_index(spark, f"{root}/projects", store, glob="*.txt")
    write(lines.where(F.col("slug") == P.CHANGED_SLUG).withColumn(
        "value", F.replace("value", F.lit('"content":"'), F.lit('"content":"v2: '))))
    if crash:
        with contextlib.suppress(ConnectionError):
            run_index(spark, f"{root}/projects", _Crashing(spark, f"{root}/index"), glob="*.txt")
    run_index(spark, f"{root}/projects", store, glob="*.txt",
              relational=RelationalStore(*DV.relational_views(spark, d, own_sessions=True)))
    return store


def store_messages(spark, d):
    return _indexed_store(spark, d).messages()


def store_sessions(spark, d):
    return _indexed_store(spark, d).sessions()


def _reduced_store(spark, d, **kw):
    """The stored index after those without a user message and those of an archived
    scope were deleted from the tables."""
    store = _indexed_store(spark, d, **kw)
    keep = FL.with_user_messages(store.sessions())
    scope = spark.createDataFrame([(p,) for p in P.REMOVED_SCOPE], "prefix string")
    gone = store.sessions().join(keep.select("id"), "id", "left_anti").select("id").unionByName(
        FL.in_scope(store.sessions(), scope).select("id"))
    store.remove_sessions(gone)
    return store


def store_removed(spark, d):
    """SNK4: what is left per session after the deletion."""
    store = _reduced_store(spark, d)
    return store.messages().groupBy("session_id").agg(F.count(F.lit(1)).alias("messages")).join(
        store.sessions().select(F.col("id").alias("session_id"), "message_count"), "session_id")


def store_search(spark, d):
    """TOP2 through the trigram postings, kept over a replacement, a crashed run and a
    deletion."""
    store = _reduced_store(spark, d, postings=True, crash=True)
    return SR.search_sessions(store.messages_with(P.STORE_KW), store.sessions(), P.STORE_KW, limit=None)


def store_usage(spark, d):
    """AGG5 / AGG9 as maintained by the commits."""
    return _reduced_store(spark, d).usage().select(
        "source", "directory", "model", "turns", *[F.col(c).cast("long").alias(c) for c in SC.TOKENS])


def store_daily(spark, d):
    """AGG7 / AGG10 as maintained by the commits."""
    return _reduced_store(spark, d).daily()


def index_state(spark, d):
    """SNK9 / AGG11 on the listings: is there anything to index, and how much."""
    files, manifest = DV.files_view(spark, d), DV.manifest_view(spark, d)
    _, s = _mv(spark, d)
    changed = INC.changed_files(files, manifest)
    return changed.groupBy("status").agg(F.count(F.lit(1)).alias("files")).withColumn(
        "needs_index", F.lit(INC.needs_index(s, files, manifest)))


def read_prefix_set(spark, d):
    """FLT8 set-wise: messages of the sessions of many id prefixes."""
    m = DV.message_view(spark, d)
    prefixes = m.where(F.col("conv_id") % 7 == 3).select(F.substring("session_id", 1, P.OWNER_PREFIX_LEN).alias("prefix"))
    return FL.session_prefixes(m, prefixes).select("session_id", "position", "role")


def stream_ingest(spark, d):
    """STR1: the transcript files as a stream, until it has taken them all."""
    from chatlake.streaming.ingest import start_ingest
    root = _drops(spark, d, "stream-ingest")
    store = TableSet(spark, f"{root}/index", buckets=P.STORE_BUCKETS)
    start_ingest(spark, f"{root}/drops/*", store, f"{root}/checkpoint", glob="*.txt").awaitTermination()
    return store.messages()


def _streamed_sessions(spark, d):
    """STR1 over several micro-batches: every session is cut over up to three drops; of
    every seventh the drops arrive in reverse order."""
    from chatlake.streaming.ingest import start_ingest
    root = scratch_path(spark, "stream-sessions")
    cid = (F.col("mtime_ms") - DV.EPOCH_BASE_MS) / DV.MS_PER_CONVERSATION
    part = sum((F.col("line_no") >= t).cast("int") for t in P.STREAM_CUTS)
    lines = DV.raw_view(spark, d).select(
        TR.slug_of_path("path").alias("slug"), F.when(cid % 7 == 0, len(P.STREAM_CUTS) - part).otherwise(part).alias("drop"), "value")
    for k in range(len(P.STREAM_CUTS) + 1):
        lines.where(F.col("drop") == k).select("slug", "value").repartition("slug").write.mode("append").partitionBy("slug").text(f"{root}/drops")
    store = TableSet(spark, f"{root}/index", buckets=P.STORE_BUCKETS)
    start_ingest(spark, f"{root}/drops/*", store, f"{root}/checkpoint", glob="*.txt", max_files_per_trigger=P.STREAM_FILES).awaitTermination()
    return store


def stream_sessions(spark, d):
    """STR1: messages of sessions that go on in later drops."""
    return _streamed_sessions(spark, d).messages()


def stream_session_rows(spark, d):
    """STR1: session rows of sessions that go on in later drops."""
    return _streamed_sessions(spark, d).sessions()


def _drops(spark, d, name):
    root = scratch_path(spark, name)
    (DV.raw_view(spark, d).select(TR.slug_of_path("path").alias("slug"), "value").repartition("slug")
     .write.partitionBy("slug").text(f"{root}/drops"))
    return root


def _message_stream(spark, root):
    from chatlake.streaming.ingest import transcript_stream
    lines = transcript_stream(spark, f"{root}/drops/*", "*.txt")
    return TR.clean(TR.usable(TR.parse_lines(lines))).withColumn("directory", TR.directory_of_path("path"))


def stream_daily(spark, d):
    """STR2 exact: the days that the watermark has closed."""
    from chatlake.streaming.rollups import session_day_stream
    root = _drops(spark, d, "stream-daily")
    (session_day_stream(_message_stream(spark, root), "0 seconds").writeStream.format("parquet")
     .option("path", f"{root}/pairs").option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return US.merge_daily(spark.read.schema("day string, session_id string, user_msgs long, asst_turns long")
                          .parquet(f"{root}/pairs"))


def stream_summary(spark, d):
    """STR3: running summaries, upserted into the session table."""
    from chatlake.streaming.rollups import session_summary_stream, upsert_summaries
    root = _drops(spark, d, "stream-summary")
    store = TableSet(spark, f"{root}/index", buckets=P.STORE_BUCKETS)
    (session_summary_stream(_message_stream(spark, root)).writeStream.foreachBatch(upsert_summaries(store))
     .option("checkpointLocation", f"{root}/checkpoint").outputMode("update")
     .trigger(availableNow=True).start().awaitTermination())
    return store.sessions()


def stream_late(spark, d):
    """STR2 exact with late drops: the closed days of what came in time, and how many
    (day, session) rows came after the watermark had passed their day."""
    from chatlake.streaming.ingest import transcript_stream
    from chatlake.streaming.rollups import late_rows, session_day_stream
    root = scratch_path(spark, "stream-late")
    cid = (F.col("mtime_ms") - DV.EPOCH_BASE_MS) / DV.MS_PER_CONVERSATION
    lines = DV.raw_view(spark, d).select(TR.slug_of_path("path").alias("slug"), "value", (cid % 9 == 4).alias("late"))

    def take(part):
        lines.where(part).select("slug", "value").repartition("slug").write.mode("append").partitionBy("slug").text(f"{root}/drops")
        msgs = TR.clean(TR.usable(TR.parse_lines(transcript_stream(spark, f"{root}/drops/*", "*.txt"))))
        query = (session_day_stream(msgs, "0 seconds").writeStream.format("parquet").option("path", f"{root}/pairs")
                 .option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
        return late_rows(query)

    late = take(~F.col("late")) + take(F.col("late"))
    pairs = spark.read.schema("day string, session_id string, user_msgs long, asst_turns long").parquet(f"{root}/pairs")
    return US.merge_daily(pairs).withColumn("late_rows", F.lit(late).cast("long"))


def stream_daily_approx(spark, d):
    """STR2 approximate: the last update of every day, and whether its estimate of distinct
    sessions is near the exact count."""
    from chatlake.streaming.rollups import daily_activity_approx_stream
    root = _drops(spark, d, "stream-approx")
    seen = f"{root}/days"

    def put(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(seen)

    (daily_activity_approx_stream(_message_stream(spark, root)).writeStream.foreachBatch(put).outputMode("update")
     .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    last = SS.dedupe_first(spark.read.parquet(seen), "day", [F.col("batch").desc()])
    exact = daily_activity(spark, d).select("day", F.col("sessions").alias("exact"))
    return last.join(exact, "day").select("day", "user_msgs", "asst_turns", US.within_error("sessions", "exact").alias("near"))


def daily_sketch(spark, d):
    """AGG8 / AGG10 by sketches, day to week to all; a fifth of the sessions went on in a
    second directory (S30)."""
    m, s = _mv(spark, d)
    place = s.select(F.col("id").alias("session_id"), "directory")
    moved = (F.col("conv_id") % 5 == 1) & (F.col("position") >= 2)
    pairs = m.join(place, "session_id").select(
        F.when(moved, F.lit("/work/shared")).otherwise(F.col("directory")).alias("directory"), "session_id",
        TM.day_of_ms("timestamp_ms", "UTC").alias("day"))
    return US.distinct_by_period(pairs).select("level", "period", "sessions", "added", US.within_error("estimate", "sessions").alias("near"))


def relational_changes(spark, d):
    """SRC6 change feed between two states of the relational store."""
    rs, _, _ = DV.relational_views(spark, d)
    cid = F.col("conv_id")
    now = rs.where(cid % 10 != 7)
    marks = rs.where(cid % 6 != 1).select("id", (F.col("time_updated") - F.when(cid % 6 == 2, 1000).otherwise(0)).alias("last_at"))
    return RL.session_changes(now, marks)


def relational_changed_parts(spark, d):
    """SRC7 / SRC9: messages of the new and updated sessions alone."""
    rel = DV.relational_views(spark, d)
    feed = relational_changes(spark, d).where(F.col("status").isin("new", "changed"))
    return RL.relational_messages(*RL.of_sessions(*rel, feed)).select("session_id", "role", "content", "timestamp_ms", "position")


def since_expressions(spark, d):
    """FLT5: a time expression per session, as a column."""
    _, s = _mv(spark, d)
    cid = F.col("conv_id")
    kinds = [F.concat((cid % 50).cast("string"), F.lit(u)) for u in ("m", "h", "D", "w")] + [
        F.lit("today"), F.lit(" Yesterday "), TM.day_of_ms("last_at", "UTC"), F.lit("Jul 4, 2025"), F.lit("2025-07"), F.lit("soon")]
    text = F.element_at(F.array(*kinds), (cid % len(kinds) + 1).cast("int"))
    return s.select("id", text.alias("expression")).withColumn("since", TM.since_ms("expression", P.NOW_MS))


def hit_lines(spark, d):
    """FN4: the hits of a search, in one line each."""
    return search_window(spark, d).select("session_id", TX.one_line("snippet").alias("line"))


def json_rows(spark, d):
    """SNK12: a listing written as JSON texts and read back."""
    rows = as_json_lines(list_sessions(spark, d))
    return rows.select(F.from_json("json", SC.SESSION).alias("r")).select("r.*")


def scope_rows(spark, d):
    """SET5: a scope that lists prefixes twice, as rows."""
    _, s = _mv(spark, d)
    scope = s.where(F.col("directory").rlike("^/work/team[13]/proj1$")).select(F.col("directory").alias("prefix"))
    return SS.list_sessions(s, scope=scope, limit=None)


def queries() -> dict[str, Query]:
    return {
        "stream_sessions": stream_sessions,
        "stream_session_rows": stream_session_rows,
        "store_search": store_search,
        "store_usage": store_usage,
        "store_daily": store_daily,
        "stream_late": stream_late,
        "stream_daily_approx": stream_daily_approx,
        "daily_sketch": daily_sketch,
        "relational_changes": relational_changes,
        "relational_changed_parts": relational_changed_parts,
        "since_expressions": since_expressions,
        "hit_lines": hit_lines,
        "json_rows": json_rows,
        "stream_daily": stream_daily,
        "stream_summary": stream_summary,
        "scope_rows": scope_rows,
        "store_messages": store_messages,
        "store_sessions": store_sessions,
        "store_removed": store_removed,
        "index_state": index_state,
        "read_prefix_set": read_prefix_set,
        "stream_ingest": stream_ingest,
        "search_keyword": search_keyword,
        "search_multi_keyword": search_multi_keyword,
        "search_scoped_since": search_scoped_since,
        "search_context": search_context,
        "list_sessions": list_sessions,
        "session_report": session_report,
        "sessions_by_file": sessions_by_file,
        "read_messages": read_messages,
        "read_around": read_around,
        "skim_all": skim_all,
        "preview_lines": preview_lines,
        "model_usage": model_usage,
        "daily_activity": daily_activity,
        "daily_last14": daily_last14,
        "json_extract": json_extract,
        "parse_filter_raw": parse_filter_raw,
        "model_usage_raw": model_usage_raw,
        "sessionize": sessionize,
        "index_messages": index_messages,
        "prefix_owner": prefix_owner,
        "changed_files": changed_files,
        "stale_files": stale_files,
        "manifest_upsert": manifest_upsert,
        "session_upsert": session_upsert,
        "message_replace": message_replace,
        "text_parts": text_parts,
        "sessionize_parts": sessionize_parts,
        "message_counts": message_counts,
        "merge_sources": merge_sources,
        "dedupe_sessions": dedupe_sessions,
        "distinct_first_hit": distinct_first_hit,
        "usage_merge": usage_merge,
        "daily_merge": daily_merge,
        "project_rollup": project_rollup,
        "tree_rows": tree_rows,
        "flat_rows": flat_rows,
        "flat_filter": flat_filter,
        "project_filter": project_filter,
        "lineage": lineage,
        "lineage_rows": lineage_rows,
        "lineage_cycles": lineage_cycles,
        "search_window": search_window,
        "all_sessions": all_sessions,
        "recent_per_project": recent_per_project,
        "scope_bidirectional": scope_bidirectional,
        "usage_report": usage_report,
        "session_removal": session_removal,
        "daily_activity_raw": daily_activity_raw,
        "index_stats": index_stats,
    }

