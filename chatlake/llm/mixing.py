"""Mixing sources to target weights: Pfair scheduling of source blocks.

A source of weight a_s (a positive whole number; P is the sum over sources)
gets the share a_s / P of the slots, one block of ``block_docs`` documents to
a slot.  As in Pfair scheduling, block i (from 0) of a source is released at
floor(i * P / a_s) and due at ceil((i + 1) * P / a_s); every slot takes, of the
released blocks, the one due first (ties: the source that sorts first).  With
shares that sum to one every deadline is met, so after any number of slots
every source has had within one block of its share.  Releases and deadlines
repeat every P slots, so only the P blocks of one period are scheduled; block
b of a source stands in slot (b div a_s) * P + slot of block (b mod a_s).

The schedule is a fold over the P slots of one row, whose state is the next block
of every source: P is the sum of the weights, a size of the configuration and
the number of sources, not of the documents.

Inside a source documents come in the order of md5(doc_id), a fixed shuffle
(then by hash of the row); those without id in the order of the md5 of their row's
hash.  So rows that repeat an id, or a whole row without id, are one run: ids
are taken to be keys.  Every row stays, once.  A source that has run out
leaves its slots empty, and the other sources keep their rates; ``on_target``
marks the slots before the first source runs out, where all shares hold.

The index of a document in its source is counted by pieces: a prefix of the
md5 cuts a source into runs, runs are numbered by themselves and offset by the
counts of earlier runs, so a source that holds a third of the rows is no
single task.  NULL is a source of its own.  Texts, empty, NULL or very long, only
enter the hash of their row.  No documents give no rows.  Columns of the input
whose names clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import without

BLOCK_DOCS = 8
RUN_ROWS = 5000  # rows of a run, about
ADDED = ["block", "pos", "slot", "on_target"]


def source_weights(sources: DataFrame, weights: dict[str, int], default: int = 1) -> DataFrame:
    """(src, a): the whole-number weight of every source in ``sources``."""
    if default < 1 or any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights must be positive whole numbers")
    a = F.lit(default)
    for name, w in sorted(weights.items()):
        a = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(int(w))).otherwise(a)
    return sources.withColumn("a", a.cast("long"))


def period(weighted: DataFrame) -> DataFrame:
    """(src, a, p, i, at): slot ``at`` of block i of every source in one period."""
    total = weighted.agg(F.sum("a").alias("p"))
    zero = F.lit(0).cast("long")

    def block(s, i, a, p):
        div = lambda x: F.call_function("div", x, a)
        return F.struct(div((i + 1) * p + a - 1).alias("due"), s.alias("s"), i.alias("i"), div(i * p).alias("free"),
                        a.alias("a"), p.alias("p"))

    # of every source the first block that is not yet scheduled
    source = F.struct(F.col("src").isNull().alias("no"), "src")
    blocks = weighted.join(F.broadcast(total)).select(block(source, zero, F.col("a"), F.col("p")).alias("b"))
    one = blocks.agg(F.sort_array(F.collect_list("b")).alias("wait"), F.max("b.p").alias("p"))

    def step(acc, t):
        pick = F.array(F.array_min(F.filter(acc["wait"], lambda b: b["free"] <= t)))
        return F.element_at(F.transform(pick, lambda c: F.struct(
            F.transform(acc["wait"], lambda b: F.when(
                b["s"].eqNullSafe(c["s"]), block(b["s"], b["i"] + 1, b["a"], b["p"])).otherwise(b)).alias("wait"),
            F.concat(acc["done"], F.array(F.struct(t.alias("at"), c.alias("b")))).alias("done"))), 1)

    kind = blocks.schema["b"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<at:bigint,b:{kind}>>")
    done = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("p") - 1),
                       F.struct(F.col("wait").alias("wait"), empty.alias("done")), step, lambda acc: acc["done"])
    return (one.where("p > 0").select(F.explode(done).alias("d"))
            .select(F.col("d.b.s.src").alias("src"), F.col("d.b.a").alias("a"), F.col("d.b.p").alias("p"),
                    F.col("d.b.i").alias("i"), F.col("d.at").alias("at")))


def mix(docs: DataFrame, weights: dict[str, int], default: int = 1, block_docs: int = BLOCK_DOCS,
        run_rows: int = RUN_ROWS, count: int | None = None) -> DataFrame:
    """``docs`` with ``block`` (of its source, from 0), ``pos`` (in the block),
    ``slot`` and ``on_target``; unsorted: (slot, pos) is the mixed order."""
    total = docs.count() if count is None else count
    digits = 0
    while 16 ** digits * run_rows < total:
        digits += 1
    cols = without(docs, ADDED)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields
              if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    tie = F.xxhash64(*hashed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("source").alias("src"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), tie.cast("string")))).alias("m"),
                       tie.alias("tie"))
    rows = rows.withColumn("run", F.substring("m", 1, digits))
    runs = rows.groupBy("src", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = runs.groupBy("src").agg(F.sum("n").alias("n"))
    slots = period(source_weights(sizes.select("src"), weights, default))
    rates = slots.select("src", "a", "p").distinct()
    # a source of n documents has its last block in this slot; the first to end sets the horizon
    last = F.expr(f"cast(ceil(n / {block_docs}) as bigint)")
    ends = (sizes.join(rates, sizes["src"].eqNullSafe(rates["src"])).select(sizes["src"].alias("e"), (last - 1).alias("b"), "a", "p"))
    ends = ends.withColumn("i", F.expr("b % a"))
    ends = ends.join(slots.select("src", F.col("i").alias("j"), "at"),
                     F.col("e").eqNullSafe(F.col("src")) & (F.col("i") == F.col("j")))
    horizon = ends.agg(F.min(F.expr("b div a * p + at")).alias("horizon"))  # one row
    inside = Window.partitionBy("src", "run").orderBy("m", "tie")
    at = rows.withColumn("k", F.row_number().over(inside) - 1).alias("x").join(
        runs.select(F.col("src").alias("rs"), F.col("run").alias("rr"), "skip"),
        F.col("src").eqNullSafe(F.col("rs")) & (F.col("run") == F.col("rr")))
    at = at.withColumn("k", (F.col("k") + F.col("skip")).cast("long"))
    at = at.select("row", "src", F.expr(f"k div {block_docs}").alias("block"), F.expr(f"k % {block_docs}").alias("pos"))
    per = slots.groupBy(F.col("src").alias("ps")).agg(
        F.any_value("a").alias("a"), F.any_value("p").alias("p"),
        F.sort_array(F.collect_list(F.struct("i", "at"))).alias("ats"))  # one row per source
    out = at.join(per, F.col("src").eqNullSafe(F.col("ps"))).join(F.broadcast(horizon))
    slot = F.expr("block div a * p") + F.element_at("ats", F.expr("block % a").cast("int") + 1)["at"]
    out = out.withColumn("slot", slot)
    return out.select(*[F.col("row").getField(c).alias(c) for c in cols], "block", "pos", "slot",
                      (F.col("slot") <= F.col("horizon")).alias("on_target"))
