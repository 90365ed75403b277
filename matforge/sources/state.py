"""Small tables that outlive a run: read if there, replaced as a whole; and files that only one writer can make.

A table is a folder of versions and a pointer that names the one in force. A new version is written in full before the
pointer is replaced in one step, so a reader finds the old table or the new one, and a writer that fails leaves the old one.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """Rename in one step; without ``overwrite`` a target that is there is an error."""
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    files, to = _path(spark, target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(source), to, options)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Put a small text in place as a whole; without ``overwrite`` False if another writer's is there."""
    fresh = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    files, target = _path(spark, fresh)
    out = files.create(target, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        _rename(spark, fresh, path, overwrite)
    except Py4JJavaError as error:
        files.delete(target, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()) or "rename destination" in str(error.java_exception.getMessage()):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text; None if nothing is there."""
    files, target = _path(spark, path)
    if not files.exists(target):
        return None
    source = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, sorted, without hidden files; nothing if it is not there."""
    files, target = _path(spark, path)
    found = [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []
    return sorted(n for n in found if not n.startswith("."))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; empty if nothing is there or what is there cannot be read as one."""
    version = read_text(spark, f"{path}/{POINTER}")
    try:
        if version and names(spark, f"{path}/{version.strip()}"):
            found = spark.read.schema(schema).parquet(f"{path}/{version.strip()}")
            found.limit(1).collect()  # a damaged file shows itself here
            return found
    except (AnalysisException, Py4JJavaError):
        pass
    return spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> None:
    """Write a new version, then point to it; a failed write leaves the old table and is raised.

    The version before the one replaced is deleted, so readers of the one replaced can finish.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    old = (read_text(spark, f"{path}/{POINTER}") or "").strip()
    write_text(spark, f"{path}/{POINTER}", version)
    files, _ = _path(spark, path)
    for name in names(spark, path):
        if name.startswith("v-") and name not in (version, old):
            files.delete(_path(spark, f"{path}/{name}")[1], True)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _path(spark, path)
    files.delete(target, True)
