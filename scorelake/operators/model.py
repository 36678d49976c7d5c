"""Adapters: supplied tables as the canonical trial model (filename, speaker, y, part, n_frames, h, system, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trials, one score column per system; purchases and signups are bonafide (P01), days make partitions."""
    e = read(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    part = F.when(day <= 20, "eval").when(day <= 25, "progress").otherwise("hidden")
    base = e.select(F.col("event_id").alias("filename"), F.col("user_id").alias("speaker"), "event_type", F.col("event_type").isin("purchase", "signup").cast("int").alias("y"), part.alias("part"), k.alias("n_frames"), F.hour("ts").alias("h"), F.col("value").cast("double").alias("A"))
    return base.withColumn("B", F.col("n_frames").cast("double")).withColumn("C", F.col("A") - F.col("n_frames") / F.lit(2.0))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: a row per trial and system."""
    w = wide_trials(spark, sf_dir)
    return w.unpivot(["filename", "speaker", "event_type", "y", "part", "n_frames", "h"], ["A", "B", "C"], "system", "score")


def asv_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as verifier trials: views are targets, clicks nontargets, errors spoofs; only the eval partition."""
    w = wide_trials(spark, sf_dir).where("part = 'eval'")
    cls = F.when(F.col("event_type") == "view", "target").when(F.col("event_type") == "click", "nontarget").when(F.col("event_type") == "error", "spoof")
    return w.select(cls.alias("class"), F.col("A").alias("score")).where("class is not null")
