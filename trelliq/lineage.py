"""Plans cut off from what stands before them, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trelliq-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once where a lost executor doesn't lose them, and read by what follows. They go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trelliq-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


#: A table is dealt out only between these sizes in bytes, the upper one for each core of the cluster.
SPREAD_FROM, SPREAD_TO = 1 << 20, 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that is small for the cluster, dealt to all cores before costly work on its rows; a larger one as it is.

    Spark reads a small table in as few tasks as it has files, and the rest of the cluster waits. What is dealt out is
    bounded for each core; larger tables are read in more tasks than there are cores anyway.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return df.repartition(cores) if SPREAD_FROM <= size <= SPREAD_TO * cores else df
