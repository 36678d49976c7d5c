"""Classical models (L09-L14, L25): RBF support vector machines and their sweep, an approximation by random Fourier features, random
forests, class weights, block importances."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import forests, kernel_svm, metrics


def class_weights(rows: DataFrame) -> DataFrame:
    """Adds weight, N / (2 N_class)."""
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # two rows
    total = sum(n.values())
    return rows.withColumn("weight", F.when(F.col("y") == 1, total / (2.0 * max(n.get(1, 0), 1))).otherwise(total / (2.0 * max(n.get(0, 0), 1))))


def fourier_features(rows: DataFrame, gamma: float, n: int = 128, seed: int = 0) -> DataFrame:
    """Adds features: n random cosines whose inner products approximate exp(-gamma |a - b|²) (Rahimi and Recht, 2007)."""
    d = len(rows.select("x").first()[0])
    r = np.random.default_rng(seed)
    w, b = r.normal(0, np.sqrt(2 * gamma), (d, n)), r.uniform(0, 2 * np.pi, n)

    def run(batches):
        import pyarrow as pa

        from .mixtures import matrix

        for batch in batches:
            z = np.sqrt(2 / n) * np.cos(matrix(batch.column(batch.schema.get_field_index("x"))) @ w + b) if batch.num_rows else np.zeros((0, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), n).cast(pa.list_(pa.float64()))], [*batch.schema.names, "z"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, z array<double>").withColumn("features", array_to_vector("z")).drop("z")


def standardised(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Arrays less the training rows' means, over their deviations; a deviation of zero counts as 1. A row of statistics."""
    d = len(train.select("x").first()[0])
    st = train.select(*[F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_pop(F.col("x")[i]).alias("d")).alias(f"s{i}") for i in range(d)]).first()
    mean, dev = F.array(*[F.lit(float(s.m)) for s in st]), F.array(*[F.lit(float(s.d or 1.0)) for s in st])
    z = F.zip_with(F.zip_with("x", mean, lambda a, b: a - b), dev, lambda a, b: a / b)
    return [df.withColumn("x", z) for df in (train, *others)]


def fourier_svm_scores(train: DataFrame, test: DataFrame, c: float = 1.0, gamma: float = 0.01) -> DataFrame:
    """An approximate RBF SVM on standardised rows, in a scan a step; score is the decision value. Rows carry x and y. Only the
    weights of the fitted model go on."""
    train, test = standardised(train, test)
    fit = class_weights(fourier_features(train, gamma)).withColumn("label", F.col("y").cast("double"))
    model = LinearSVC(regParam=1.0 / (c * max(train.count(), 1)), weightCol="weight", maxIter=20).fit(fit)
    coef, intercept = model.coefficients.toArray(), float(model.intercept)
    z = vector_to_array("features")
    score = F.aggregate(F.zip_with(z, F.array(*[F.lit(float(v)) for v in coef]), lambda a, b: a * b), F.lit(intercept), lambda a, b: a + b)
    return fourier_features(test, gamma).withColumn("score", score).drop("features")


def rbf_svm_scores(train: DataFrame, test: DataFrame, c: float = 1.0, gamma: float = 0.01) -> DataFrame:
    """Test with score, the decision value of the RBF SVM fitted on train. Rows carry filename, x and y."""
    grid = kernel_svm.fit(train, [(None, c, gamma)], stored)
    return test.join(kernel_svm.scores(grid, test).select("filename", "score"), "filename")


#: The whole sweep: training sizes (None: all rows), C and gamma.
SIZES, CS, GAMMAS = (1000, 2000, 5000, 10000, 20000, 50000, None), (0.1, 1.0, 10.0, 100.0), (0.0001, 0.001, 0.01, 0.1)
#: Points of a sweep that are trained together and written at once.
BATCH = 56


def svm_sweep(train: DataFrame, dev: DataFrame, path: str, sizes=SIZES, cs=CS, gammas=GAMMAS, batch: int = BATCH, vectors: str | None = None) -> DataFrame:
    """n_train, c, gamma, n_vectors, eer of every point of a grid. Points are trained together; a batch is written as it is done, and a
    run that was cut short takes up where it stopped. Sizes are stratified samples by hash, each within the next. The support vectors of
    points fitted on all rows are kept at vectors, if named, for refit_best."""
    spark, total = train.sparkSession, train.count()
    try:
        done = {(r.n_train, r.c, r.gamma) for r in spark.read.parquet(path).collect()}  # a row a point
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    points = [(n, c, g) for n in sorted({min(n or total, total) for n in sizes}) for c in cs for g in gammas if (n, float(c), float(g)) not in done]
    for i in range(0, len(points), batch):
        some = points[i : i + batch]
        grid = kernel_svm.fit(train, some, stored)
        scored = kernel_svm.scores(grid, dev).join(dev.select("filename", "y"), "filename")
        n = grid.vectors.where("alpha > 0").groupBy("point").agg(F.count("*").alias("n_vectors"))
        named = spark.createDataFrame([(k, int(s), float(c), float(g)) for k, (s, c, g) in enumerate(some)], "point int, n_train long, c double, gamma double")
        out = metrics.eer(scored, ["point"]).join(n, "point").join(F.broadcast(named), "point")  # a row a point
        if vectors:  # before the points count as done; each run's apart, should one be cut short between the two
            whole = grid.vectors.join(F.broadcast(named.where(F.col("n_train") == total)), "point").withColumn("run", F.lit(uuid.uuid4().hex))
            whole.select("c", "gamma", "run", "block", "id", "y", "alpha", "intercept", "x").write.mode("append").parquet(vectors)
        out.select("n_train", "c", "gamma", "n_vectors", "eer").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def refit_best(sweep: DataFrame, train: DataFrame, test: DataFrame, vectors: str | None = None) -> DataFrame:
    """The scores of the sweep's best point, fitted on all rows; that fit is taken from vectors if the sweep has kept it there."""
    best = sweep.orderBy("eer", "c", "gamma", F.desc("n_train")).first()
    if vectors:
        held = train.sparkSession.read.parquet(vectors).where((F.col("c") == best.c) & (F.col("gamma") == best.gamma))
        run = held.agg(F.min("run")).first()[0]
        if run is not None:
            grid = kernel_svm.resumed(train, best.c, best.gamma, held.where(F.col("run") == run).select(F.lit(0).alias("point"), "block", "id", "y", "alpha", "intercept", "x"))
            return test.join(kernel_svm.scores(grid, test).select("filename", "score"), "filename")
    return rbf_svm_scores(train, test, best.c, best.gamma)


def forest(train: DataFrame, trees: int = 300, seed: int = 42, depth: int = 30) -> forests.Forest:
    """A balanced random forest. Rows carry filename, x and y."""
    n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}  # two rows
    total = sum(n.values())
    return forests.fit(train, tuple(total / (2.0 * max(n.get(c, 0), 1)) for c in (0, 1)), trees, seed, depth)


def forest_scores(model: forests.Forest, rows: DataFrame) -> DataFrame:
    return forests.scores(model, rows)


def block_importance(spark, model, blocks: int, size: int) -> DataFrame:
    """Importance summed over blocks of features."""
    v = model.importances()
    return spark.createDataFrame([(i, float(v[i * size : (i + 1) * size].sum())) for i in range(blocks)], "block int, importance double")
