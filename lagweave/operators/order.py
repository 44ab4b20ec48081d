"""Global order without a one-task sort: row numbers, runs of equal values, zips of two streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored

#: Rows of a stretch within which neighbours are compared in one window.
STRETCH = 100_000


def numbered(df: DataFrame, order: Sequence[Column], name: str = "numbered") -> DataFrame:
    """df with `pos` (long from 0) in the given order.

    A range-partitioned sort numbers rows within partitions; only one count per partition is summed in a single task.
    """
    shift = 33  # monotonically_increasing_id: partition above, row below
    rows = stored(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", shift)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    out = rows.withColumn("_part", part).join(first, "_part")
    return out.withColumn("pos", F.col("_first") + F.col("_mid").bitwiseAND(F.lit((1 << shift) - 1))).drop("_mid", "_part", "_first")


def value_runs(df: DataFrame, value: str, order: Sequence[Column], stretch: int = STRETCH) -> DataFrame:
    """(run, value, first, last, n): stretches of rows that follow each other in `order` with one value; a null is a value.

    first and last are row numbers, run counts from 0. Rows are cut into stretches of a fixed size, within which each
    row is compared with the one before; of each stretch only the outermost two runs meet others, in one task.
    """
    keys = [c.alias(f"o{i}") for i, c in enumerate(order)]
    rows = numbered(df.select(F.col(value).alias("v"), *keys), [F.col(f"o{i}") for i in range(len(keys))], "run-rows")
    rows = rows.select("v", "pos", F.floor(F.col("pos") / stretch).alias("cut"))
    own = Window.partitionBy("cut").orderBy("pos")
    new = (F.row_number().over(own) == 1) | ~F.col("v").eqNullSafe(F.lag("v").over(own))
    cut = rows.withColumn("new", new.cast("int")).withColumn("seg", F.sum("new").over(own))
    segs = cut.groupBy("cut", "seg").agg(F.first("v").alias("v"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))
    segs = stored(segs, "run-segments")
    outer = (F.col("first") % stretch == 0) | ((F.col("last") + 1) % stretch == 0)
    line = Window.orderBy("first")
    joins = F.col("v").eqNullSafe(F.lag("v").over(line)) & (F.lag("last").over(line) + 1 == F.col("first"))
    edge = segs.filter(outer).withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("new").over(line))
    edge = edge.groupBy("run").agg(F.first("v").alias("v"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    whole = edge.drop("run").union(segs.filter(~outer).select("v", "first", "last", "n"))
    return numbered(whole, [F.col("first")], "runs").select(F.col("pos").alias("run"), F.col("v").alias(value), "first", "last", "n")


def zipped(one: DataFrame, two: DataFrame, order_one: Sequence[Column], order_two: Sequence[Column]) -> DataFrame:
    """(pos, x, y): the k-th row of one with the k-th of two, as structs; what one has more than the other is left out."""
    x = numbered(one, order_one, "zip-one").select("pos", F.struct(*one.columns).alias("x"))
    y = numbered(two, order_two, "zip-two").select("pos", F.struct(*two.columns).alias("y"))
    return x.join(y, "pos")
