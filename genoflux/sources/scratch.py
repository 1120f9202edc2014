"""Tables in the folder that driver and executors share. They cut lineage and are read instead of being worked out again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode, a temporary folder of this machine. On a cluster an unset folder is an
    error, as executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='genoflux-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(top)  # only what exists can be marked
    files.deleteOnExit(top)
    return f"{folder}/table"


def kept(df: DataFrame) -> DataFrame:
    """df, written once and read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
