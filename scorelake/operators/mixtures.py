"""Diagonal Gaussian mixtures (L15-L20, K09, S14): exact EM by additive statistics, log-likelihood ratios per file, storage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class DiagonalMixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def component_log_density(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; the square is expanded, so no rows x components x dimensions array is made."""
        inv = 1.0 / self.variances
        const = np.log(self.weights) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.log(self.variances).sum(1) + (self.means**2 * inv).sum(1))
        return const + x @ (self.means * inv).T - 0.5 * (x**2) @ inv.T

    def log_density(self, x: np.ndarray) -> np.ndarray:
        c = self.component_log_density(x)
        top = c.max(1)
        return top + np.log(np.exp(c - top[:, None]).sum(1))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Groups in which executors add the tasks' sums before the driver does.
GROUPS = 16


def added(table):
    import pyarrow as pa

    return pa.table({"v": [matrix(table.column("v").combine_chunks()).sum(0).tolist()]})


def save(spark, m: DiagonalMixture, path: str, **meta: str) -> None:
    """A row a component, and what the model was made with."""
    rows = [(i, float(w), x.tolist(), v.tolist(), dict(meta)) for i, (w, x, v) in enumerate(zip(m.weights, m.means, m.variances))]
    spark.createDataFrame(rows, "component int, weight double, mean array<double>, variance array<double>, meta map<string,string>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> tuple[DiagonalMixture, dict[str, str]]:
    """The model and its metadata."""
    rows = spark.read.parquet(path).orderBy("component").collect()  # a row a component
    return DiagonalMixture(np.array([r.weight for r in rows]), np.array([r["mean"] for r in rows]), np.array([r.variance for r in rows])), dict(rows[0].meta)


def fit(frames: DataFrame, k: int, iterations: int = 30, tol: float = 1e-4, reg: float = 1e-6, column: str = "x") -> tuple[DiagonalMixture, list[float]]:
    """EM on an array column: every task sums its partial statistics, one row of k x d numbers each; executors add these in
    GROUPS groups, and the driver adds the groups' sums.

    Starts from the k rows of least hash; stops when the mean log-likelihood gains less than tol.
    """
    rows = frames.select(F.col(column).cast("array<double>").alias("x")).persist()
    start = np.array([r.x for r in rows.orderBy(F.xxhash64("x")).limit(k).collect()])
    d = start.shape[1]
    total = rows.select(*[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(d)]).first()
    m = DiagonalMixture(np.full(len(start), 1 / len(start)), start, np.tile(np.array([total[i] or 0.0 for i in range(d)]) + reg, (len(start), 1)))
    history: list[float] = []
    try:
        for _ in range(iterations):
            now = m

            def step(batches, now=now):
                import pyarrow as pa

                n, s, t, ll, rows_ = np.zeros(len(now.weights)), np.zeros_like(now.means), np.zeros_like(now.means), 0.0, 0
                for b in batches:
                    x = matrix(b.column(0))
                    if not len(x):
                        continue
                    c = now.component_log_density(x)
                    top = c.max(1, keepdims=True)
                    z = top[:, 0] + np.log(np.exp(c - top).sum(1))
                    r = np.exp(c - z[:, None])
                    n, s, t, ll, rows_ = n + r.sum(0), s + r.T @ x, t + r.T @ x**2, ll + z.sum(), rows_ + len(x)
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[ll, rows_], n, s.ravel(), t.ravel()]).tolist()])], ["v"])

            partial = rows.mapInArrow(step, "v array<double>").withColumn("g", F.spark_partition_id() % GROUPS)
            parts = np.array([r.v for r in partial.groupBy("g").applyInArrow(added, "v array<double>").collect()]).sum(0)
            kk = len(m.weights)
            ll, count, n = parts[0], parts[1], np.maximum(parts[2 : 2 + kk], 1e-10)
            s, t = parts[2 + kk : 2 + kk + kk * d].reshape(kk, d), parts[2 + kk + kk * d :].reshape(kk, d)
            mean = s / n[:, None]
            m = DiagonalMixture(n / n.sum(), mean, np.maximum(t / n[:, None] - mean**2, 0) + reg)
            history.append(float(ll / max(count, 1)))
            if len(history) > 1 and history[-1] - history[-2] < tol:
                break
    finally:
        rows.unpersist()
    return m, history


def file_llr(frames: DataFrame, bona: DiagonalMixture, spoof: DiagonalMixture, file: str = "filename", column: str = "x") -> DataFrame:
    """Filename, score: the mean over a file's frames of the log-likelihood ratio."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = matrix(b.column(1))
            ratio = bona.log_density(x) - spoof.log_density(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ratio)], ["file", "llr"])

    kind = dict(frames.dtypes)[file]
    rows = frames.select(F.col(file).alias("file"), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, f"file {kind}, llr double")
    return rows.groupBy(F.col("file").alias(file)).agg(F.avg("llr").alias("score"))
