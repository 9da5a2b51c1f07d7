"""Folders for intermediate tables, and files of any store that Spark reads."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one is made on a single machine; on a cluster, whose executors couldn't read each
    other's files there, that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="lexspark-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage as a checkpoint does, and is read by columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, as Spark deletes shuffle files only when what refers to them is collected.

    To be called after a step that shuffled much and whose result is written. Python lets go of the driver's objects in a
    thread that sleeps for a second at a time, so without the wait they would outlive the collection.
    """
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with their place in the order of ``df``, from 0, as ``name``: counted in each partition, after the rows of those
    before, which are a table with a row for each partition."""
    part, at = "_numbered_part", "_numbered_at"
    held = checkpointed(df.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = held.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(part, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_numbered_before"))
    return held.join(before, part).withColumn(name, F.col("_numbered_before") + F.col(at)).drop(part, at, "_numbered_before")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
    p, system = _at(spark, path)
    system.deleteOnExit(p)
    return path


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _at(spark, path)
    return system.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, system = _at(spark, path)
    return system.exists(p) and system.getFileStatus(p).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or a written table."""
    p, system = _at(spark, path)
    system.delete(p, True)


def concatenated(spark: SparkSession, folder: str, target: str, overwrite: bool = False) -> None:
    """The part files of ``folder`` in their order as one file, streamed from store to store."""
    p, system = _at(spark, folder)
    t, to = _at(spark, target)
    parts = sorted((f.getPath().toString() for f in system.listStatus(p) if f.getPath().getName().startswith("part-")))
    out = to.create(t, overwrite)
    try:
        for name in parts:
            source = system.open(_at(spark, name)[0])
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, spark._jsc.hadoopConfiguration(), False)
            finally:
                source.close()
    finally:
        out.close()
