"""Structured Streaming: ingest of dropped files, exact day roll-up."""

import os

from pyspark.sql import functions as F
from test_transcripts import GARDEN, WIND, write_project

from chatlake.operators.usage import merge_daily
from chatlake.sources import transcripts as TR
from chatlake.store.tables import TableSet
from chatlake.streaming import ingest as STI
from chatlake.streaming import rollups as STR


def test_stream_ingest_available_now(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "drops")
    write_project(src, "-p-one", "a.jsonl", GARDEN[:5])
    store = TableSet(spark, os.path.join(tmpdir_fresh, "index"), buckets=4)
    q = STI.start_ingest(spark, os.path.join(src, "*"), store, os.path.join(tmpdir_fresh, "ck"))
    q.awaitTermination(120)
    assert store.sessions().count() == 1
    write_project(src, "-p-two", "b.jsonl", GARDEN[5:])
    q = STI.start_ingest(spark, os.path.join(src, "*"), store, os.path.join(tmpdir_fresh, "ck"))
    q.awaitTermination(120)
    assert store.sessions().count() == 2
    assert store.messages().count() == 7


def test_session_day_stream_exact(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "drops")
    write_project(src, "-p-one", "a.jsonl", GARDEN)
    lines = STI.transcript_stream(spark, os.path.join(src, "*"))
    msgs = TR.clean(TR.usable(TR.parse_lines(lines)))
    out = os.path.join(tmpdir_fresh, "pairs")
    q = (STR.session_day_stream(msgs, watermark="0 seconds").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", os.path.join(tmpdir_fresh, "ck2"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    # the watermark closes 2025-11-02 once 2025-12-24 rows arrive; the last
    # day stays open until later data moves the watermark past it
    pairs = spark.read.parquet(out)
    daily = {r["day"]: (r["sessions"], r["user_msgs"], r["asst_turns"]) for r in merge_daily(pairs).collect()}
    assert daily.get("2025-11-02") == (1, 3, 2)


def test_summary_stream_memory(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "drops")
    write_project(src, "-p-one", "a.jsonl", GARDEN)
    lines = STI.transcript_stream(spark, os.path.join(src, "*"))
    msgs = TR.clean(TR.usable(TR.parse_lines(lines))).withColumn("directory", TR.directory_of_path("path"))
    q = (STR.session_summary_stream(msgs).writeStream.format("memory").queryName("summ")
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = {r["session_id"]: r for r in spark.sql("select * from summ").collect()}
    assert rows[WIND]["message_count"] == 3
    assert "tulip" in rows[WIND]["_title"]
    assert F is not None
