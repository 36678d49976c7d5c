"""Resumable scoring (G01-G06, G10): new files are scored once, failures are data, completeness is counted, not assumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Incomplete(RuntimeError):
    """Fewer rows were written than came in."""


class TooManyFailures(RuntimeError):
    """The share of failed rows passed its limit."""


def run_available(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, max_failure_rate: float = 0.01, accept_failures: bool = False, files_per_batch: int = 100) -> int:
    """Scores the Parquet files in source that no earlier run has, a bounded number a batch, and stops when none is left.

    score adds a nullable column error; rows with one go to out/failed, others to out/scored, each batch in a folder of its
    own, so a repeated batch replaces what it had left. A batch whose failures pass max(5, rate x rows) stops the query
    unless they are accepted; the next run starts at that batch again. Returns the rows scored.
    """
    done = [0]

    def each(batch: DataFrame, n: int) -> None:
        rows = score(batch).persist()
        try:
            total, failed = rows.agg(F.count("*"), F.count("error")).first()
            came = batch.count()
            if came != total:  # nothing is written of such a batch
                raise Incomplete(f"batch {n} has {came} rows, {total} came out")
            if failed > max(5, max_failure_rate * total) and not accept_failures:
                raise TooManyFailures(f"{failed} of {total} rows failed in batch {n}")
            rows.where("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/scored/batch={n}")
            rows.where("error is not null").write.mode("overwrite").parquet(f"{out}/failed/batch={n}")
            done[0] += total - failed
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done[0]


def missing(expected: DataFrame, scored: DataFrame, key: str = "filename") -> DataFrame:
    """What is still to be scored."""
    return expected.join(scored.select(key), key, "left_anti")


def allowed(scores: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Only (system, part) pairs on the list."""
    return scores.join(F.broadcast(whitelist.select("system", "part")), ["system", "part"], "left_semi")  # a few rows
