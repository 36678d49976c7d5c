"""Folders for intermediate tables that driver and executors share."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; on one machine a temporary one will do, which goes
    when the program ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return posixpath.join(root, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The table, written once and read from there: its lineage ends, and losing an executor does not compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
