"""Timings at 1, 10 and 100 times the conversations, and lineage by chain depth

    python benchmarks/scale_bench.py [sf_dir] [1,10,100]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from chatlake.operators import tree as TRE  # noqa: E402
from chatlake.plans import registry  # noqa: E402
from chatlake.session import build_session  # noqa: E402

QUERIES = ["search_keyword", "daily_activity", "model_usage", "skim_all"]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="chatlake-scale-")
    spark = build_session("local[8]", shuffle_partitions=16, extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))

    def timed(df_of):
        t0 = time.perf_counter()
        df_of().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 2)

    out = {}
    base = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    span = base.agg(F.max("conv_id")).first()[0] + 1
    for times in map(int, (argv[2] if len(argv) > 2 else "1,10,100").split(",")):
        d = os.path.join(scratch, f"x{times}")
        (base.crossJoin(F.broadcast(spark.range(times).withColumnRenamed("id", "copy")))   # fixture: a fixed number of copies
         .withColumn("conv_id", F.col("conv_id") + F.col("copy") * span).drop("copy")
         .write.parquet(f"{d}/conversations.parquet"))
        for q in QUERIES:
            run = lambda: registry.queries()[q](spark, d)
            out[f"{q} x{times}"] = {"cold": timed(run), "warm": timed(run)}
            print(json.dumps({f"{q} x{times}": out[f"{q} x{times}"]}), flush=True)
    for depth in (3, 100, 1000):
        n = 1000 // depth + 1
        chains = spark.range(n * depth).select(
            F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit("/d").alias("directory"),
            F.when(F.col("id") % depth > 0, F.concat(F.lit("s"), (F.col("id") - 1).cast("string"))).alias("parent_id"),
            F.col("id").alias("started_at"), F.col("id").alias("last_at"))
        out[f"lineage depth {depth}"] = timed(lambda: TRE.lineage(chains))  # noqa: B023
        print(json.dumps({f"lineage depth {depth}": out[f"lineage depth {depth}"]}), flush=True)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
