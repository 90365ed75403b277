"""Gapless places over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matforge.runtime import materialise


def placed(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """``df`` with places 0, 1, ... by ``order``; equal rows follow one another in any order, nulls come first.

    Rows are dealt out by ranges and sorted; a partition's first place is the sum of the sizes before it (one short row per partition).
    """
    tie, at = "__tie", "__at"
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    kept = materialise(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(F.col(at), 33)
    sizes = kept.groupBy(part.alias("__part")).count()
    first = sizes.withColumn("__first", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = kept.withColumn("__part", part).join(F.broadcast(first.drop("count")), "__part")
    return joined.withColumn(out, F.col("__first") + F.col(at).bitwiseAND((1 << 33) - 1)).drop("__part", "__first", at)
