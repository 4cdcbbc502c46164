"""Cutting the lineage of iterative jobs, in a way that survives lost executors."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Places written and not yet deleted.
_live: set[str] = set()


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that is unset, a folder of this run if all tasks run on this machine; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which drop_all deletes with the tables."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _live.add(path)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "_cut", None):
            _delete(t.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Deletes every table of cut() that is left: for a job's end, when no result that reads them is needed any more."""
    for path in list(_live):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _live.discard(path)
