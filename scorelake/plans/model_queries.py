"""Queries that train or transform with numpy and pyspark.ml; SQL can't express them, so only tests check their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classical, dsp, lcnn, mixtures, model
from ..sources import files


def vectors(s, d):
    e = model.read(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("filename"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 5).cast("int").alias("y"), (F.col("vec_id") % 4 == 0).alias("held_out"))


def q_gmm_fit(s, d):
    v = vectors(s, d)
    bona, _ = mixtures.fit(v.where("y = 1 and not held_out"), 4, 8)
    spoof, _ = mixtures.fit(v.where("y = 0 and not held_out"), 4, 8)
    return mixtures.file_llr(v.where("held_out"), bona, spoof)


def q_rff_svm(s, d):
    """An approximation of the RBF SVM that needs a scan a step."""
    v = vectors(s, d)
    return classical.fourier_svm_scores(v.where("not held_out"), v.where("held_out"), gamma=0.5).select("filename", "y", "score")


def q_rbf_svm(s, d):
    """Decision values of the RBF SVM."""
    v = vectors(s, d)
    return classical.rbf_svm_scores(v.where("not held_out"), v.where("held_out"), 1.0, 0.01).select("filename", "y", F.round("score", 3).alias("score"))


def swept(s, d, kept=None):
    """The grid of 7 x 4 x 4 points; sizes are the table's halves, quarters, ... so that they grow with it."""
    v = vectors(s, d)
    train, dev = v.where("not held_out"), v.where("held_out")
    n = train.count()
    return classical.svm_sweep(train, dev, files.scratch(s, "sweep"), [max(8, n >> k) for k in range(6, -1, -1)], vectors=kept), train, dev


def q_svm_grid(s, d):
    """All 112 points."""
    return swept(s, d)[0]


def q_svm_sweep(s, d):
    """The scores of the grid's best point, fitted on all rows."""
    kept = files.scratch(s, "vectors")
    return classical.refit_best(*swept(s, d, kept), kept).select("filename", "y", "score")


def q_rf_scores(s, d):
    v = vectors(s, d)
    return classical.forest_scores(classical.forest(v.where("not held_out")), v.where("held_out")).select("filename", "y", "score")


def q_rf_block_importance(s, d):
    return classical.block_importance(s, classical.forest(vectors(s, d)), 4, 16)


def q_lcnn_scores(s, d):
    """Products of the vectors' first 32 numbers as maps of 32 by 32, scored by a stored network."""
    maps = vectors(s, d).select("filename", "y", F.flatten(F.transform(F.slice("x", 1, 32), lambda a: F.transform(F.slice("x", 1, 32), lambda b: a * b))).alias("x"))
    network = lcnn.as_table(s, lcnn.drawn(32, 32, "timepool", 1))
    return lcnn.scores(maps, network, 32, 32).select("filename", F.round("score", 6).alias("score"))


def q_cq_cepstra(s, d):
    """Vectors as records of 8 bins by 8 frames; cepstra and their first and second deltas."""
    v = F.expr("transform(embedding, v -> least(greatest(rint((cast(v as double) * 100 - 40 + 80) / 80 * 255), 0D), 255D))")
    x = dsp.pooled(model.read(s, d, "embeddings").select("vec_id", v.alias("y")), "cepstra8", "vec_id")
    return x.select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + F.lit(0.0)).alias("v"))  # no negative zero


def q_file_llr(s, d):
    """Two mixtures, stored and loaded again; each file's mean log-likelihood ratio."""
    import numpy as np

    e = model.read(s, d, "embeddings")
    first = {r.vec_id: r.embedding for r in e.where("vec_id < 8").collect()}
    found = []
    for name, ids in (("bona", range(4)), ("spoof", range(4, 8))):
        path = files.scratch(s, name)
        mixtures.save(s, mixtures.DiagonalMixture(np.full(4, 0.25), np.array([first[i] for i in ids], np.float64), np.full((4, 64), 0.05)), path, kind=name)
        m, meta = mixtures.load(s, path)
        assert meta == {"kind": name}
        found.append(m)
    rows = e.select((F.col("vec_id") % 50).alias("filename"), F.col("embedding").cast("array<double>").alias("x"))
    return mixtures.file_llr(rows, *found).select("filename", F.round("score", 5).alias("llr"))


def signals(s, d):
    """Each vector, repeated, as a short signal."""
    return vectors(s, d).select("filename", F.flatten(F.array_repeat("x", 40)).alias("y"))


QUERIES = {
    "q_gmm_fit": q_gmm_fit,
    "q_cq_cepstra": q_cq_cepstra,
    "q_file_llr": q_file_llr,
    "q_rff_svm": q_rff_svm,
    "q_lcnn_scores": q_lcnn_scores,
    "q_rbf_svm": q_rbf_svm,
    "q_svm_grid": q_svm_grid,
    "q_svm_sweep": q_svm_sweep,
    "q_rf_scores": q_rf_scores,
    "q_rf_block_importance": q_rf_block_importance,
    **{f"q_{k}": (lambda s, d, k=k: dsp.pooled(signals(s, d), k)) for k in ("lfcc", "cqt")},
    "q_mfcc_pooled": lambda s, d: dsp.pooled(signals(s, d), "mfcc"),
    "q_augment_chain": lambda s, d: dsp.pooled(signals(s, d), "augment"),
}
DENSITY = """c AS (SELECT vec_id AS k, n, v AS m FROM f WHERE vec_id < 8),
lp AS (SELECT f.vec_id, c.k, ln(0.25::DOUBLE) - 32 * ln(2 * pi() * 0.05::DOUBLE) - SUM((f.v - c.m) * (f.v - c.m)) / (2 * 0.05::DOUBLE) AS l FROM f JOIN c ON f.n = c.n GROUP BY ALL),
mx AS (SELECT vec_id, k < 4 AS bona, MAX(l) AS top FROM lp GROUP BY ALL),
ll AS (SELECT lp.vec_id, bona, MAX(top) + ln(SUM(exp(l - top))) AS ll FROM lp JOIN mx ON mx.vec_id = lp.vec_id AND mx.bona = (k < 4) GROUP BY ALL)"""
ORACLE_SQL = {
    "q_cq_cepstra": """WITH r AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
b AS (SELECT vec_id, i // 8 AS b, i % 8 AS t, LEAST(GREATEST(round_even((CAST(v AS DOUBLE) * 100 - 40 + 80) / 80 * 255, 0), 0), 255) / 255 * 80 - 80 AS db FROM r),
c AS (SELECT vec_id, t, k.range AS k, SUM(db * cos(pi() / 8 * (b + 0.5) * k.range)) * CASE WHEN k.range = 0 THEN sqrt(CAST(1 AS DOUBLE) / 8) ELSE sqrt(CAST(2 AS DOUBLE) / 8) END AS c FROM b CROSS JOIN range(5) k GROUP BY vec_id, t, k.range),
w AS (SELECT x.vec_id, x.t, x.k, SUM((y.t - x.t) * y.c) / 28 AS d1, SUM(((y.t - x.t) * (y.t - x.t) - 4) * y.c) / 42 AS d2 FROM c x JOIN c y ON y.vec_id = x.vec_id AND y.k = x.k AND y.t BETWEEN x.t - 3 AND x.t + 3 WHERE x.t IN (3, 4) GROUP BY ALL)
SELECT vec_id, CAST(t * 15 + j.range * 5 + k AS INT) AS i, ROUND(CASE j.range WHEN 0 THEN c WHEN 1 THEN d1 ELSE d2 END, 6) + CAST(0 AS DOUBLE) AS v
FROM (SELECT c.vec_id, c.t, c.k, c.c, w.d1, w.d2 FROM c JOIN w ON w.vec_id = c.vec_id AND w.k = c.k AND w.t = CASE WHEN c.t < 4 THEN 3 ELSE 4 END) z CROSS JOIN range(3) j""",
    "q_file_llr": f"WITH f AS (SELECT vec_id, unnest(range(64)) AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), {DENSITY} SELECT vec_id % 50 AS filename, ROUND(AVG(x), 5) AS llr FROM (SELECT vec_id, SUM(CASE WHEN bona THEN ll ELSE -ll END) AS x FROM ll GROUP BY vec_id) y GROUP BY 1",
}
