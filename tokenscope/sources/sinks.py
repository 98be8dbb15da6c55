"""Snapshots on a shared file system that are replaced as a whole, and tables kept by them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Options of text formats that keep times to the microsecond; by default they keep milliseconds.
EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where that is unset a temporary one, on a local master only."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace_snapshot(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write df beside path and move it there, so that a reader finds the old snapshot or the new one, never a part.

    Between taking the old one away and moving the new one in, a reader may find none; load_snapshot then reads the old one.
    A write that fails leaves path as it was; a move that fails is an error, with the old snapshot put back.
    """
    spark = df.sparkSession
    files, where = _files(spark, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    df.write.format(fmt).options(**EXACT_TIMES).save(new)
    if files.exists(where(path)):
        files.delete(where(old), True)
        if not files.rename(where(path), where(old)):
            raise OSError(f"{path} can't be moved away")
    if not files.rename(where(new), where(path)):
        files.rename(where(old), where(path))
        raise OSError(f"{new} can't be moved to {path}")
    files.delete(where(old), True)


def load_snapshot(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """The snapshot at path, the one before while it is being replaced, else an empty table."""
    files, where = _files(spark, path)
    for place in (path, f"{path}.old"):
        if files.exists(where(place)):
            return spark.read.format(fmt).schema(schema).load(place)
    return spark.createDataFrame([], schema)
