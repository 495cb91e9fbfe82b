"""Pointer-jumping lineage against a brute-force walk, and the skew-safe
position operator against ``row_number``."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlake.operators import tree as TRE
from chatlake.operators.ranking import sequence_within


def brute_lineage(rows):
    by_id = {r[0]: r for r in rows}
    out = {}
    for r in rows:
        seen, cur, depth = set(), r, 0
        while True:
            pid = cur[2]
            parent = by_id.get(pid) if pid else None
            if parent is None or parent[1] != cur[1]:
                out[r[0]] = (cur[0], depth)
                break
            if cur[0] in seen:
                break                    # cycle: no root
            seen.add(cur[0])
            cur, depth = parent, depth + 1
            if depth > len(rows):
                break
    return out


def test_lineage_deep_chain_cycle_orphan(spark):
    rows = []
    n = 130                                            # deeper than a recursion cap of 100
    for i in range(n):
        rows.append((f"c{i:04d}", "/d/chain", f"c{i - 1:04d}" if i else None, 1000 + i, 5000 + i))
    rows += [("x1", "/d/cyc", "x2", 1, 10), ("x2", "/d/cyc", "x1", 2, 11), ("x3", "/d/cyc", "x2", 3, 12)]
    rows += [("o1", "/d/orph", "missing", 1, 2), ("k1", "/d/other", "c0005", 1, 3)]
    rows += [("r1", "/d/fan", None, 1, 100)] + [(f"f{i}", "/d/fan", "r1", 10 + i, 20 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, directory string, parent_id string, started_at long, last_at long")
    got = {r["id"]: (r["root_id"], r["depth"]) for r in TRE.lineage(df).collect()}
    want = brute_lineage(rows)
    assert got == want
    assert "x1" not in got and "x3" not in got       # cycle and its tail vanish (S40)
    assert got["o1"] == ("o1", 0) and got["k1"] == ("k1", 0)
    assert got[f"c{n - 1:04d}"] == ("c0000", n - 1)
    # preorder: every child right after its parent's subtree starts
    full = df.withColumn("branch", F.lit(None).cast("string")).withColumn("title", F.col("id"))
    lr = [r for r in TRE.lineage_rows(full).collect() if r["kind"] == "session"]
    fan = [r["session_id"] for r in lr if r["directory"] == "/d/fan"]
    assert fan == ["r1", "f0", "f1", "f2", "f3", "f4"]
    lasts = {r["session_id"]: r["is_last"] for r in lr if r["directory"] == "/d/fan"}
    assert lasts["f4"] and not lasts["f3"] and not lasts["r1"]


def test_missing_times_sort_last_in_every_view(spark):
    """In the tree, the lineage and the flat list."""
    rows = [("a", "/d/p", None, 5, None), ("z", "/d/p", None, 5, 50), ("q", "/d/none", None, None, None)]
    df = spark.createDataFrame(rows, "id string, directory string, parent_id string, started_at long, last_at long")
    df = df.withColumn("branch", F.lit(None).cast("string")).withColumn("title", F.col("id")).withColumn("message_count", F.lit(1))
    for rows in (TRE.tree_rows(df), TRE.lineage_rows(df)):
        assert [r["session_id"] or r["directory"] for r in rows.collect()] == ["/d/p", "z", "a", "/d/none", "q"]
    assert [r["session_id"] for r in TRE.flat_rows(df).collect()][0] == "z"


def test_lineage_gives_up_loudly(spark):
    import pytest
    rows = [(f"n{i:02d}", "/d", f"n{i - 1:02d}" if i else None, i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, directory string, parent_id string, started_at long, last_at long")
    with pytest.raises(RuntimeError):
        TRE.lineage(df, max_rounds=1)


def test_sequence_within_hot_key(spark):
    hot = spark.range(0, 20000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 20000).alias("o"))
    cold = spark.range(0, 3000).select(F.concat(F.lit("c"), (F.col("id") % 300).cast("string")).alias("k"),
                                       F.col("id").alias("o"))
    df = hot.unionByName(cold)
    got = sequence_within(df, "k", F.floor(F.col("o") / 1000), ["o"])
    want = df.withColumn("position", (F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1).cast("int"))
    diff = got.select("k", "o", "position").exceptAll(want.select("k", "o", "position"))
    assert diff.count() == 0
    assert got.count() == df.count()
