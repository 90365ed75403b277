"""The index of published codes, kept up by a stream of (nmc_code, cpse_id) rows.

Each pair is its own row, so publishing twice or from many writers at once changes nothing. Pairs are spread by
a hash of the code over ``BUCKETS`` folders; a batch reads only the folders its codes fall into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
#: Forms and greatest lengths of a code and of an organisation in a request.
CODE, CODE_LENGTH = "^[A-Za-z0-9][-A-Za-z0-9._/+]*$", 150
ORGANISATION, ORGANISATION_LENGTH = "^[A-Za-z0-9][-A-Za-z0-9 &._]*$", 40
SCHEMA = "nmc_code string, cpse_id string, bucket int"


def requests(rows: DataFrame) -> DataFrame:
    """Rows with ``refused``: why a request cannot be taken, or NULL."""
    bad = lambda x, form, most: f"{x} IS NULL OR length({x}) > {most} OR NOT {x} RLIKE '{form}'"
    return rows.withColumn("refused", F.expr(f"CASE WHEN {bad('cpse_id', ORGANISATION, ORGANISATION_LENGTH)} THEN 'organisation' WHEN {bad('nmc_code', CODE, CODE_LENGTH)} THEN 'code' END"))


def bucketed(rows: DataFrame) -> DataFrame:
    return rows.select("nmc_code", "cpse_id", F.pmod(F.xxhash64("nmc_code"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """All published pairs. Retried batches may leave a pair twice on disk; it is read once."""
    return spark.read.schema(SCHEMA).parquet(path).dropDuplicates(["nmc_code", "cpse_id"])


def publish(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append the pairs of a batch that the index lacks."""
    asked = bucketed(requests(rows).filter("refused IS NULL")).dropDuplicates(["nmc_code", "cpse_id"])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        asked = asked.join(spark.read.schema(SCHEMA).parquet(path), ["bucket", "nmc_code", "cpse_id"], "left_anti").select("nmc_code", "cpse_id", "bucket")
    asked.write.mode("append").partitionBy("bucket").parquet(path)


def publish_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what has arrived; start it again with the same checkpoint to go on from there."""
    return rows.writeStream.foreachBatch(lambda batch, _: publish(batch.sparkSession, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookup(asked: DataFrame, published: DataFrame) -> DataFrame:
    """(nmc_code, cpse_id, others): other organisations that published each asked code, sorted and joined by a bar."""
    found = asked.alias("a").join(published.alias("p"), (F.col("a.nmc_code") == F.col("p.nmc_code")) & (F.col("a.cpse_id") != F.col("p.cpse_id")), "left")
    return found.groupBy("a.nmc_code", "a.cpse_id").agg(F.array_join(F.array_sort(F.collect_set("p.cpse_id")), "|").alias("others"))
