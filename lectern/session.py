"""Session helpers shared by every part of the library."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table stored in fewer pieces than there are cores, dealt out to all; others as they are.  Results don't depend on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.  Only where a session runs on this
    machine alone and names none, a temporary folder of it; on a cluster that is an error, for executors would
    write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application's ``materialize`` wrote, once their results are no longer read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(conf).delete(path, True)


@contextmanager
def freeing(spark: SparkSession, on: bool = True) -> Iterator[None]:
    """Shuffle files of what is run within go as soon as it is done, not when the driver collects its garbage."""
    before = spark.conf.get(_FREE)
    try:
        if on:
            spark.conf.set(_FREE, "true")
        yield
    finally:
        spark.conf.set(_FREE, before)


def materialize(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as a table of the shared folder and read it back.

    Unlike a local checkpoint the files outlive the executors that wrote them.  ``clear`` deletes them.
    ``free``: the shuffle files of ``df`` go as soon as it is written, not when the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with freeing(spark, free):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that ``materialize`` gave as ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf, own = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), f"/lectern/{spark.sparkContext.applicationId}/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own not in folder:
            raise ValueError(f"{folder} is no table of materialize")
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def snapshot(spark: SparkSession) -> dict:
    """What the session runs on: cores in all, executors, memory of the driver and of an executor as set, partitions of a shuffle."""
    sc = spark.sparkContext
    conf = sc.getConf()
    return {
        "cores": sc.defaultParallelism, "executors": max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - (0 if re.match(r"local(\[|$)", sc.master) else 1)), "driver_memory": conf.get("spark.driver.memory", "1g"),
        "executor_memory": conf.get("spark.executor.memory", "1g"), "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }
