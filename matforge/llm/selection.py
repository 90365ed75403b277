"""Keeping the rows of a table by marks on their ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matforge.runtime import materialise


def staying(df: DataFrame, marks: DataFrame, id_col: str, key: Column, once: bool) -> DataFrame:
    """The rows of ``df`` that ``marks`` keep, with their own columns.

    ``marks`` (a written table) has one row per id and key of ``df``'s rows: doc_id, key, stays, and n, the number of
    rows alike in both. With ``once``, one of them stays, else all do. Ids whose rows all go are
    anti-joined by id alone: few and short, so the rows themselves are moved only if the ids are too
    many for a broadcast. Only rows whose id is null, or has both rows that stay and rows that go, are told apart by
    ``key``, an expression over ``df``. An empty table gives no rows.
    """
    whole = F.col("stays") & ((F.col("n") == 1) | F.lit(not once))
    ids = marks.groupBy("doc_id").agg(F.bool_and(whole).alias("all"), F.bool_or("stays").alias("some")).filter("NOT all OR doc_id IS NULL")
    name = uuid.uuid4().hex
    own = F.col(id_col).cast("long")
    touched = materialise(ids.select(F.col("doc_id").alias(name), (F.col("some") | F.col("doc_id").isNull()).alias("mixed")), "touched")
    rest = df.join(touched.select(name), own == F.col(name), "left_anti").filter(own.isNotNull())
    mixed = touched.filter("mixed").select(name)
    if mixed.isEmpty():
        return rest
    k, n = name + "k", name + "n"
    kept = marks.filter("stays").select(F.col("doc_id").alias(name), F.col("key").alias(k), F.col("n").alias(n))
    kept = kept.join(mixed.withColumnRenamed(name, k + "m"), F.col(name).eqNullSafe(F.col(k + "m")), "left_semi")
    doubtful = df.withColumns({name + "d": own, name + "x": key})
    doubtful = doubtful.join(kept, F.col(name + "d").eqNullSafe(F.col(name)) & (F.col(name + "x") == F.col(k)))
    if once:
        single = doubtful.filter(F.col(n) == 1)
        doubtful = single.unionByName(doubtful.filter(F.col(n) > 1).dropDuplicates([name, k]))
    return rest.unionByName(doubtful.select(*df.columns))
