"""Cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets a temporary one; a cluster must set it."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="glossmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, forget: bool = False) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, from where a lost executor's part is read again.

    The shuffle files that led to it are dropped as soon as it is written. A kept table still has the planner's
    size estimate of the plan before; ``forget`` drops that too: in loops of joins the estimates, which multiply,
    would grow to numbers of so many digits that planning takes longer than the work.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint(eager=True)  # a new plan: the setting is read as a plan is made
    finally:
        spark.conf.set(_CLEANUP, before)
    if forget:
        rows = kept._jdf.queryExecution().toRdd()
        kept = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
    return kept


def release(spark: SparkSession) -> None:
    """Let go of results that nothing refers to; Spark's cleaner then drops their checkpoint files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, on any file system of Spark's."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
