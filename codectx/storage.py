"""Tables written between stages, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, as in local tests, a folder of this machine is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"codectx-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except (Py4JError, AttributeError, OSError):  # the session has ended already
        pass


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    The files outlive a lost executor, unlike a cached frame, and the last stage runs once, unlike with ``checkpoint()``. They go when Python exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codectx/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for stages that spend their time in Python.

    A scan can't split a Parquet row group, so a small table may arrive in one partition; a large one has more than there are cores and stays as it is, without a shuffle.
    Give it a frame of a scan and narrow steps with only the columns that are needed.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)
