"""Reproducible sharding: a Feistel permutation over global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matforge.llm.feistel import permute
from matforge.llm.numbering import number_rows


def shard_rows(df: DataFrame, n_shards: int = 8, key: str = "corpus-v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row; law ``rows``: shard sizes differ by at most one.

    Rows are numbered by (id, UTF-8 size, CRC-32 of the text). Row number x goes to position
    p = permute(x), shard ``p mod n_shards`` and slot ``p div n_shards``, so a reader can
    compute either way without a lookup. Only the id, size and checksum are shuffled, never texts.

    A null text has size 1 and checksum 0, like the empty text. Null ids come first. Repeated
    rows each get a slot of their own. An empty table gives an empty result. Other columns are
    not carried, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(keys, ["doc_id", "size", "text_crc32"])
    position = numbered.withColumn("position", permute(F.col("row_no"), n, key))
    return position.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % n_shards).cast("int").alias("shard"),
        ((F.col("position") - F.col("position") % n_shards) / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
