"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, a folder of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that goes at the end of the program: it is worked out once, and lost executors cost nothing behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(lambda: [_remove(spark, p) for p in _WRITTEN])
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, n: int, per: int) -> int:
    """Partitions for n rows, `per` of them in one on average, so that a task's memory stays as it is when a table grows."""
    return max(1, min(spark.sparkContext.defaultParallelism, n // 20_000), math.ceil(n / per))


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
