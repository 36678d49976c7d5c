"""What the corpus operators share."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir, or the one set on the context (as tests do); it must be there, as a
    folder of one machine would lose what others wrote."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    folder = named or sc.getCheckpointDir()
    if not folder and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        import tempfile  # one machine is the whole cluster then

        folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, which is smaller than a checkpoint of many narrow rows."""
    path = posixpath.join(shared_folder(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that are planned and run inside give their shuffle files back as they end, not when the driver's garbage goes."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str):
    """Column names that the table does not have, made from these; one for one name, else a list."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out if len(out) > 1 else out[0]


def staged(first: F.Column, *steps) -> F.Column:
    """The last step's value; each step maps the struct or value before it. A value is computed once however often the next
    step uses it, and lambdas stay side by side: nested ones take the analyzer exponential time."""
    a = F.array(first)
    for step in steps:
        a = F.transform(a, step)
    return F.get(a, F.lit(0))
