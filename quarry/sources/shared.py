"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = 1 << 30
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder if the
    session is one local process, else an error."""
    for known in (spark.sparkContext.getConf().get("spark.checkpoint.dir", None), spark.conf.get("spark.checkpoint.dir", None)):
        if known:
            return known.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    _made.append((spark, f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"))
    return _made[-1][1]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back: computed once, however often it is read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table of ``write_table`` that no later plan reads."""
    path = getattr(df, "_quarry_path", None)
    if path:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, below: int = SMALL_BYTES) -> DataFrame:
    """``df``, dealt out to all cores if the optimiser takes it to be smaller than ``below``: one row group
    is one task, and a small file has no more. Larger inputs have row groups enough. For tables as they are read, not for joins,
    whose size the optimiser takes to be the product of their sides'."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= below:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already; the folder is the cluster's to clear
            pass
