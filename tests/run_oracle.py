"""Run every registered query against its SQL oracle and print a report.

    python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from chatlake.session import build_session  # noqa: E402
from oracle_util import compare, duck  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                r = compare(df, con, sqls[name])
            else:
                r = {"rows": df.count(), "ok": True, "no_oracle": True}
        except Exception as e:  # report and go on
            r = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:600]}"}
        r["sec"] = round(time.time() - t0, 2)
        bad += not r["ok"]
        print(name, json.dumps(r, default=str, ensure_ascii=False)[:1500], flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
