"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, below one for the application.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is unset, as in
    local tests, a temporary folder takes its place (a local master has one machine).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, and what is lost is reread."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of stored tables for which a shuffle gets one partition more, and of compressed shuffled rows that a task reads.
DEALT, SHARE = 4 << 20, 8 << 20


def deal(spark: SparkSession, *paths: str) -> None:
    """Let shuffles have as many partitions at first as the tables at these paths ask for, so that a task's share does not
    grow with the input. Small ones are merged again by adaptive execution, up to ``SHARE``: ids are alike and shrink to a tenth
    or less in a shuffle. The session's own number of partitions is the least."""
    sc = spark.sparkContext
    held = 0
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        held += p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-held // DEALT))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHARE))


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder, once none of its frames is read any more."""
    _delete(spark, shared_dir(spark, "").rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the files behind a frame that ``materialise`` returned, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, f.rsplit("/", 1)[0])


def together(frames: list[DataFrame]) -> DataFrame:
    """The rows of frames that ``materialise`` returned, all of one schema, in one scan however many they are."""
    files = [f for df in frames for f in df.inputFiles()]
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*files) if files else frames[0]


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, for operators of many queries.

    Only then does Spark remove what finished queries have broadcast, which the driver holds too, and their shuffle files.
    """
    gc.collect()  # frames that Python no longer reaches hold theirs in the JVM
    spark.sparkContext._jvm.System.gc()
