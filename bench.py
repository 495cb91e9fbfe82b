"""Benchmark: run the registered queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and print one JSON line.

Each query runs to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  One warm-up pass, then the
best of ``$BENCH_REPEAT`` (default 2) timed passes per query (one for queries
of more than ``LONG`` seconds); ``value`` is the sum over queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatlake.plans.registry import queries  # noqa: E402
from chatlake.session import build_session  # noqa: E402

HEADLINE = ["search_keyword", "search_multi_keyword", "search_scoped_since", "list_sessions",
            "sessions_by_file", "read_messages", "skim_all", "model_usage", "daily_activity",
            "sessionize", "index_messages", "tree_rows", "lineage_rows"]


LONG = 6.0  # seconds from which a query is timed once only


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    scratch = tempfile.mkdtemp(prefix="chatlake-bench-")
    spark = build_session(f"local[{cpus}]", app="chatlake-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g",
                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"})
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    qs = queries()
    names = only or list(qs)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    warm = {name: run(name) for name in names}          # JIT, file listing caches
    times = {}
    for name in names:
        n = 1 if warm[name] > LONG else max(repeat, 1)
        times[name] = round(min(run(name) for _ in range(n)), 4)
    headline = {k: v for k, v in times.items() if k in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "headline_seconds": round(sum(headline.values()), 4),
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
