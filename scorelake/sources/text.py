"""Readers for protocol, enrolment and score files (S01-S09, S16) and writers (K01-K05). Schemas are explicit; checks raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def protocol(spark: SparkSession, path: str | Sequence[str], columns: str, sep: str = " ", **constants) -> DataFrame:
    """Header-less delimited files with declared columns, and constant columns; several paths are one read."""
    df = spark.read.schema(columns).option("sep", sep).csv(path)
    return df.withColumns({k: F.lit(v) for k, v in constants.items()}) if constants else df


def enrolment(spark: SparkSession, path: str) -> DataFrame:
    """Lines `SPEAKER_ENV f1,f2` as one row per file; blank lines are skipped, the first part is split at its last _."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line != "").select(F.substring_index(line, " ", 1).alias("head"), F.expr("substring(trim(value), instr(trim(value), ' ') + 1)").alias("files"))
    return rows.select(F.regexp_replace("head", "_[^_]*$", "").alias("speaker_id"), F.substring_index("head", "_", -1).alias("env_id"), F.explode(F.split("files", ",")).alias("filename"))


def scores(spark: SparkSession, path: str) -> DataFrame:
    """FILENAME SCORE with any white space; a repeated name raises."""
    parts = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("filename"), F.get(parts, F.lit(1)).cast("double").alias("score"))
    if df.groupBy("filename").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path} names a file twice")
    return df


def paths(spark: SparkSession, folders: Sequence[str], pattern: str = "*") -> DataFrame:
    """Stem, path over several folders; of equal stems the later folder's wins. Contents are not read."""
    out = None
    for part, folder in enumerate(folders):
        rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.lit(part).alias("part"))
        out = rows if out is None else out.unionByName(rows)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return out.groupBy(stem.alias("stem")).agg(F.max_by("path", "part").alias("path"))


def with_paths(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Adds filepath; a file without one raises."""
    out = manifest.join(found.withColumnRenamed("stem", "filename").withColumnRenamed("path", "filepath"), "filename", "left")
    missing = out.where("filepath is null").limit(5).select("filename").collect()
    if missing:
        raise FileNotFoundError(f"no path for {[r.filename for r in missing]}")
    return out


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """n (from 0), and the line: files by name, splits by their start; a row a split is counted and broadcast."""
    rows = spark.read.text(path).select(F.col("value").alias(name), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    splits = rows.groupBy("_f", "_s").agg(F.min("_i").alias("_lo"), F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(splits), ["_f", "_s"]).select((F.col("_b") + F.col("_i") - F.col("_lo")).alias("n"), name)


def zipped(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two row-aligned text files as (n, left, right), joined on line numbers; unequal lengths raise."""
    out = numbered_lines(spark, left, "left").join(numbered_lines(spark, right, "right"), "n", "full")
    if out.where("left is null or right is null").limit(1).count():
        raise ValueError("the files have different numbers of lines")
    return out


def write_scores(df: DataFrame, path: str, name: str = "filename", score: str = "score") -> None:
    """FILENAME SCORE with six decimals, scored rows only."""
    df.where(F.col(score).isNotNull()).select(F.concat_ws(" ", F.col(name).cast("string"), F.format_string("%.6f", F.col(score).cast("double")))).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Each row as a JSON object."""
    df.select(F.to_json(F.struct("*"))).coalesce(1).write.mode("overwrite").text(path)
