"""Gapless global row numbers and running totals without a global window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.runtime import materialise


def number_rows(df: DataFrame, order: list[str], out: str = "row_no") -> tuple[DataFrame, int]:
    """``df`` with ranks 0..n-1 by ``order``, and n.

    Rows are range-partitioned by ``order``, with the place in the scan as the last key so that
    no key, however common, fills one partition. Each partition numbers its own sorted rows; the
    partitions' row counts (one row each) give the offsets. The rank does not depend on
    the sampled range bounds. Rows that tie in ``order`` share their ranks in any order.
    An empty table gives no rows and n = 0; nulls sort first.
    """
    place, local = "__place", "__local"
    ranged = df.withColumn(place, F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*order, place).sortWithinPartitions(*order, place).drop(place)
    kept = materialise(ranged.withColumn(local, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(local), 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per partition of the range exchange: bounded by the partition count
    offsets = sizes.select("__part", "__n", F.coalesce(before, F.lit(0)).alias("__before"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    numbered = kept.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    within = F.col(local).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(out, F.col("__before") + within).drop("__part", "__before", "__n", local), int(total)


def running_totals(df: DataFrame, order: list[str], size: str, out: str) -> tuple[DataFrame, int]:
    """``df`` with the sum of ``size`` over all rows before each by ``order``, and the sum over all rows.

    Dealt as in :func:`number_rows`; each task adds up its own sorted rows, and the tasks' sums (one row each)
    give the offsets. Rows that tie in ``order`` follow one another in any order. ``size`` is a long without
    nulls. An empty table gives no rows and 0; nulls in ``order`` sort first.
    """
    place, part, own = "__place", "__part", "__own"
    ranged = df.withColumn(place, F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*order, place).sortWithinPartitions(*order, place).drop(place)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes = batch.column(size).to_numpy()
            sums = total + np.cumsum(sizes)
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - sizes), pa.array(np.full(len(sums), task, dtype=np.int32))], [*batch.schema.names, own, part])

    schema = T.StructType([*df.schema, T.StructField(own, T.LongType()), T.StructField(part, T.IntegerType())])
    kept = materialise(ranged.mapInArrow(add_up, schema), "totals")
    sums = kept.groupBy(part).agg(F.sum(size).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    # one row per partition of the range exchange: bounded by the partition count
    offsets = sums.select(part, F.coalesce(before, F.lit(0)).alias("__before"))
    total = sums.agg(F.sum("__sum")).first()[0] or 0
    totals = kept.join(F.broadcast(offsets), part)
    return totals.withColumn(out, F.col("__before") + F.col(own)).drop(part, "__before", own), int(total)
