"""Position inside a group without sending a whole group to one task.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` puts every row of a
key into one task.  ``sequence_within`` cuts each key into slices by a
column that follows the order (every slice lies before the next one), such as
the minute of a timestamp:

1. rows are numbered inside each ``(key, slice)``: the only exchange that
   moves whole rows;
2. rows are counted per ``(key, slice)``, on the key and order columns alone,
   and a running sum over a key's slices gives each slice its offset;
3. the offsets are joined on ``(key, slice)``, which the numbered rows are
   already partitioned by, so only the small side moves.

The slice is computed from the row itself, so the plan is lazy, nothing is
checkpointed, and a recomputation gives the same positions.  The order must
be total (add a unique tie-break such as a line number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_within(df: DataFrame, key: str, slices: Column, order: list, out: str = "position") -> DataFrame:
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    sliced = df.withColumn("_slice", slices)
    inside = Window.partitionBy(key, "_slice").orderBy(*order_cols)
    numbered = sliced.withColumn("_local", F.row_number().over(inside))
    sizes = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (numbered.join(offsets, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_at")))
            .withColumn(out, (F.col("_off") + F.col("_local") - 1).cast("int"))
            .drop("_slice", "_local", "_off", "_key", "_at"))


def previous_within(df: DataFrame, key: str, slices: Column, order: list, value: str, out: str = "previous") -> tuple[DataFrame, DataFrame]:
    """``df`` with the ``value`` of the row before in the key's order (NULL for the first),
    and ``(key, last)``: the value of each key's last row.  Sliced as above: a
    slice's first row takes it from the last row of the slice before."""
    sliced = df.withColumn("_slice", slices)
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    rows = sliced.withColumn("_before", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    back = Window.partitionBy(key, "_slice").orderBy(*[_reversed(o) for o in order])
    ends = (sliced.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") == 1)
            .select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), F.col(value).alias("_end")))
    along = Window.partitionBy("_key").orderBy("_at")
    ends = ends.withColumn("_carry", F.lag("_end").over(along)).withColumn("_next", F.lead("_at").over(along))
    rows = rows.join(ends.select("_key", "_at", "_carry"), (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_at")))
    rows = rows.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before")))
    return (rows.drop("_slice", "_before", "_first", "_key", "_at", "_carry"),
            ends.where(F.col("_next").isNull()).select(F.col("_key").alias(key), F.col("_end").alias("last")))


def _reversed(order: str) -> Column:
    return F.col(order).desc_nulls_last()
