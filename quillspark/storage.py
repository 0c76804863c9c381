"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir``, read from the session.  Only on one machine, where it is
unset, a folder of its own is taken and set.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's address below the checkpoint folder."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getuid()}")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """Cut lineage: write as Parquet in the shared folder and read it back."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer used; else they stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
