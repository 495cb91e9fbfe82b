"""One object per stored index, with a method per command of the
reference's command line (index, sessions, search, read, skim, stats,
files, browse).  Every method returns lazy DataFrames over the stored
tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatlake.functions.time import parse_since
from chatlake.operators import search as SR
from chatlake.operators import sessions as SS
from chatlake.operators import tree as TRE
from chatlake.operators import usage as US
from chatlake.operators.filters import filter_sessions, text_filter
from chatlake.sources.transcripts import list_files
from chatlake.store.incremental import needs_index
from chatlake.store.output import as_json_lines
from chatlake.store.tables import DEFAULT_BUCKETS, RelationalStore, TableSet, run_index


class TranscriptIndex:
    def __init__(self, spark: SparkSession, index_root: str, transcripts_root: str | None = None,
                 buckets: int = DEFAULT_BUCKETS, now_ms: int | None = None, tz: str = "UTC",
                 relational: RelationalStore | None = None, auto_index: bool = False, postings: bool = True,
                 slug_map: dict[str, str] | None = None):
        """``auto_index`` brings the index up to date before a command that reads it;
        ``postings`` keeps trigram postings for search; ``slug_map`` names the
        directories of project slugs."""
        self.spark = spark
        self.store = TableSet(spark, index_root, buckets, postings)
        self.slug_map = slug_map
        self.transcripts_root, self.relational, self.auto_index = transcripts_root, relational, auto_index
        self.now_ms, self.tz = now_ms, tz

    # -- helpers -----------------------------------------------------------
    def _since(self, since) -> int | None:
        if since is None or isinstance(since, int):
            return since
        ms = parse_since(str(since), self.now_ms, self.tz)
        if ms is None:
            raise ValueError(f"cannot read since value {since!r} (e.g. 2h, 3d, 1w, today, 2025-07-04)")
        return ms

    def refresh(self) -> dict | None:
        """SNK9: index if there is no index yet or any listed file is new or changed."""
        listed = self.spark.createDataFrame([], "path string, mtime_ms long")
        if self.transcripts_root:
            listed = listed.unionByName(list_files(self.spark, self.transcripts_root).select("path", "mtime_ms"))
        if self.relational:
            listed = listed.unionByName(self.relational.listed())
        return self.index() if needs_index(self.store.sessions(), listed, self.store.manifest()) else None

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        if self.auto_index:
            self.refresh()
        return self.store.sessions(), self.store.messages()

    # -- commands ----------------------------------------------------------
    def index(self, force: bool = False, merge_files: bool = False, purge: bool = False) -> dict:
        if not self.transcripts_root and not self.relational:
            raise ValueError("no transcripts root and no relational store given")
        return run_index(self.spark, self.transcripts_root, self.store, force, merge_files, self.relational, purge,
                         slug_map=self.slug_map)

    def sessions(self, source=None, scope=None, since=None, limit: int | None = 50,
                 boundary: bool = False, bidirectional: bool = False) -> DataFrame:
        s, _ = self._tables()
        return SS.list_sessions(s, source, scope, self._since(since), limit, boundary, bidirectional)

    def search(self, keywords: list[str], source=None, scope=None, since=None, limit: int | None = 20,
               rank: str = "hits", boundary: bool = False, bidirectional: bool = False) -> DataFrame:
        s, _ = self._tables()
        return SR.search_sessions(self.store.messages_with(keywords), s, keywords, source, scope, self._since(since), limit, rank, boundary, bidirectional)

    def read(self, prefix: str, from_=None, to=None, around=None, radius: int = 3,
             role=None) -> DataFrame:
        return SS.read_messages(self._tables()[1], prefix, from_, to, around, radius, role)

    def skim(self, prefix: str | None = None, head: int = 3, tail: int = 3, role=None) -> DataFrame:
        return SS.skim(self._tables()[1], head, tail, role, prefix)

    def preview(self, prefix: str, head: int = 2, tail: int = 5) -> DataFrame:
        m = self._tables()[1]
        return SS.preview(m.where(m["session_id"].startswith(prefix)), head, tail)

    def stats(self, scope=None, source=None, since=None) -> tuple[DataFrame, DataFrame]:
        """From the stored roll-ups; from the messages where these can't tell (a time
        filter, days of another zone)."""
        s, m = self._tables()
        if since is None and self.tz == "UTC":
            rolled = [filter_sessions(t, source, scope) for t in (self.store.usage(), self.store.daily())]
            return US.merge_model_usage(rolled[0]), US.merge_days(rolled[1])
        return (US.model_usage(m, s, scope, source, self._since(since)),
                US.daily_activity(m, s, scope, source, self._since(since), self.tz))

    def files(self, path: str, source=None, scope=None, since=None, limit: int | None = 20) -> DataFrame:
        s, _ = self._tables()
        return SR.sessions_by_file(self.store.messages_with([path]), s, path, source, scope, self._since(since), limit)

    def browse(self, scope=None, mode: str = "tree", text: str | None = None, project: str | None = None) -> DataFrame:
        """``mode``: tree, lineage or recent; ``text`` keeps sessions, ``project`` whole projects."""
        s = filter_sessions(self._tables()[0], scope=scope)
        if text:
            s = text_filter(s, text)
        if project:
            s = TRE.project_sessions(s, project)
        return {"lineage": TRE.lineage_rows, "recent": TRE.flat_rows}.get(mode, TRE.tree_rows)(s)

    def as_json(self, rows: DataFrame) -> DataFrame:
        """SNK12: any command's rows as one JSON text each."""
        return as_json_lines(rows)
