"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Scratch paths of this process that have not been cleared.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local master, whose executors are on the driver's
    machine, may leave it unset: then a folder below the temporary directory is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"{tempfile.gettempdir()}/matforge-checkpoints").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed by :func:`clear_scratch` or when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables made so far; results that are not written yet must no longer be read."""
    while _made:
        remove_path(spark, _made.pop())


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table's files, if they are there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The copy outlives any executor, is computed once however often it is read, and
    gives adaptive execution real sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
