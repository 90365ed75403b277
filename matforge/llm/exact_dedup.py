"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm.selection import staying
from matforge.runtime import materialise, remove_path, scratch_path

WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, lower-case hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """A table of known digests, bucketed and sorted by digest.

    ``digest`` is the key, ``keep_id`` the id of the row that stays for it, ``batch`` the batch that brought it. A
    batch is first reduced to one row per digest (map-side partial aggregates, so a group of copies sends one
    row per task), then anti-joined with the index on the bucketing key and the rest
    appended. The index side of that sort-merge join is read bucket by bucket, without a shuffle.

    ``buckets`` is fixed when the table is made: about one per 100 MB that the index shall ever hold. Every append adds
    a file to each bucket; :meth:`compact` makes them one sorted file again, with another number of
    buckets if asked.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, self.name)
        if not spark.catalog.tableExists(self.name) and spark.catalog.tableExists(self._fresh_name):
            spark.sql(f"ALTER TABLE {self._fresh_name} RENAME TO {self.name}")  # a compaction was cut off
        if spark.catalog.tableExists(self.name):
            told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
            self.buckets = int(told["Num Buckets"])
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            empty = spark.createDataFrame([], "digest string, keep_id long, batch string")
            self._writer(empty, "overwrite").option("path", f"{self.path}/{uuid.uuid4().hex}").saveAsTable(self.name)

    @property
    def _fresh_name(self) -> str:
        return f"{self.name}_fresh"

    def _writer(self, df: DataFrame, mode: str):
        return df.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, digests: DataFrame, batch: str) -> None:
        """Add the digests of a batch (columns digest, doc_id) that the index lacks.

        Of a digest's ids the smallest is kept, null if all are null. Repeated rows count once, an empty batch adds
        nothing, and a batch that is appended again under its name finds its own rows.
        """
        # written first: the optimizer would push the anti-join below the aggregate, and shuffle every copy
        firsts = materialise(digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "firsts")
        fresh = firsts.join(self.table().hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        self._writer(fresh.repartition(self.buckets, "digest"), "append").saveAsTable(self.name)

    def compact(self, buckets: int | None = None) -> None:
        """Rewrite the index as one sorted file per bucket. A run that is cut off leaves a whole index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._fresh_name}")
        old, self.buckets = self._location(), buckets or self.buckets
        rows = self.table().repartition(self.buckets, "digest")
        self._writer(rows, "overwrite").option("path", f"{self.path}/{uuid.uuid4().hex}").saveAsTable(self._fresh_name)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {self._fresh_name} RENAME TO {self.name}")
        remove_path(self.spark, old)

    def _location(self) -> str:
        told = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
        return told["Location"]

    def drop(self) -> None:
        """Forget the index and delete its files."""
        old = self._location()
        self.spark.sql(f"DROP TABLE {self.name}")
        remove_path(self.spark, old)


def _settled(rows: DataFrame, first: Column, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """Per digest of ``rows``: group_size, first (the row that comes first), keep_id, and ``won`` if this batch brought it."""
    batch, own = batch or uuid.uuid4().hex, index or DigestIndex(rows.sparkSession)
    own.append_new(rows, batch)
    # one row per digest, written so that the join with the rows is a plain two-sided shuffle in which
    # adaptive execution can split a hot digest
    groups = rows.groupBy("digest").agg(F.sum("n").alias("group_size"), F.min(first).alias("first"))
    groups = groups.join(own.table().hint("merge"), "digest")
    groups = materialise(groups.select("digest", "group_size", "first", "keep_id", (F.col("batch") == batch).alias("won")), "groups")
    if index is None:
        own.drop()
    return groups


def dedup_exact(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their digests are; the smallest id of the first batch that held a text
    stays. The index says which batch that was, so a text that comes again is dropped whatever its id; only a batch of
    the same name (``batch``) is answered as the first time. ``group_size`` counts this batch's rows with that text.
    Only (id, digest) pairs are shuffled. Null and empty texts are one group. Of repeated rows with the staying id one
    is kept. Null ids lose to any other id; a group of null ids alone keeps one. An empty table gives no rows.
    Without ``index`` one is made for this call and dropped again.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.lit(1).cast("long").alias("n"))
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "digests")
    groups = _settled(rows, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"), index, batch)
    out = rows.join(groups, "digest")
    stays = F.col("won") & (F.col("place") == F.col("first.place"))
    return out.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with their own columns only.

    Same rules as :func:`dedup_exact`; of repeated rows with the staying id one stays. Only ids and digests are
    grouped; the texts meet no more than the ids that go.
    """
    keys = df.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    per_id = materialise(keys.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), "digests")
    groups = _settled(per_id, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"), index, batch)
    marks = per_id.join(groups.select("digest", "won", "first"), "digest")
    stays = F.col("won") & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    marks = materialise(marks.select("doc_id", F.col("digest").alias("key"), stays.alias("stays"), "n"), "marks")
    return staying(df, marks, id_col, digest(F.col(text_col)), once=True)
