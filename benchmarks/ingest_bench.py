"""

Writes the ``raw_v`` lines derived from ``conversations`` as one JSONL file
per session under ``<scratch>/projects/<slug>/``, then times:
a full run, a run with no change, and a run after 1 % of files changed.

    python benchmarks/ingest_bench.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatlake.session import build_session  # noqa: E402
from chatlake.sources.driver_views import raw_view  # noqa: E402
from chatlake.store.tables import TableSet, run_index  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="chatlake-ingest-")
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    src = os.path.join(scratch, "projects")
    files: dict[str, list[str]] = {}
    # a benchmark fixture writer, not library code: lines go to local files
    for r in raw_view(spark, sf_dir).orderBy("line_no").select("path", "value").toLocalIterator():
        files.setdefault(r["path"], []).append(r["value"])
    for p, lines in files.items():
        full = os.path.join(src, p.split("/projects/", 1)[1])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    store = TableSet(spark, os.path.join(scratch, "index"), buckets=16)
    out = {"files": len(files), "lines": sum(len(v) for v in files.values())}
    t0 = time.perf_counter()
    out["full"] = run_index(spark, src, store)
    out["full_sec"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    out["no_change"] = run_index(spark, src, store)
    out["no_change_sec"] = round(time.perf_counter() - t0, 3)
    changed = sorted(files)[:: 100]
    later = time.time() + 60
    for p in changed:
        full = os.path.join(src, p.split("/projects/", 1)[1])
        os.utime(full, (later, later))
    t0 = time.perf_counter()
    out["one_percent"] = run_index(spark, src, store)
    out["one_percent_sec"] = round(time.perf_counter() - t0, 3)
    out["sessions_stored"] = store.sessions().count()
    out["messages_stored"] = store.messages().count()
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
