"""Cutting lineage so that lost executors cost a re-read, not a re-run."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of this machine only where the session runs on this machine alone and names none.

    On a cluster without a folder every executor would write to its own disk, so that is an error.
    """
    context = spark.sparkContext
    have = context.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get(DIR_KEY, None)
    if not named:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {DIR_KEY} to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="lithoflow-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    Spark removes what is no longer referred to where spark.cleaner.referenceTracking.cleanCheckpoints is set;
    ``clear`` removes all of it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clear(spark: SparkSession) -> None:
    """Removes what this application has cut so far; call it once the results are written."""
    have = spark.sparkContext.getCheckpointDir()
    if have:
        path = spark._jvm.org.apache.hadoop.fs.Path(have)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        # the folder itself stays, for what is cut next
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
