"""Logistic fusions (L02, L05-L08, R12): fitted by the operators in passes over the trials, and by their SQL in unrolled Newton steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fusion, metrics, model
from ..sources import files
from .metric_queries import ASV, BASE, coefficients, curve_sql, eer_sql, tdcf_sql, with_
from .sql import duckdb

SYSTEMS = ("A", "B", "C")
CANDIDATES = {"+".join(c): list(c) for c in ("A", "B", "C", "AB", "AC", "BC", "ABC")}
SPLIT = ((42, 5),)
SPLITS = ((42, 5), (43, 5), (42, 10), (43, 10))
#: The stored fusion whose weights are recovered.
STORED = "A+B"


def part(s, d, name):
    return model.wide_trials(s, d).where(F.col("part") == name)


def q_logistic_fusion_cv(s, d):
    """Both arms, every candidate, norm and weighting."""
    out = None
    for arm in ("progress", "hidden"):
        cv = fusion.cross_validate(part(s, d, arm), CANDIDATES, SPLIT, coefficients=coefficients(s, d)).withColumn("arm", F.lit(arm))
        out = cv if out is None else out.unionByName(cv)
    return out.select("arm", "candidate", "n_systems", "norm", "weights", *[F.round(c, 9).alias(c) for c in ("cv_eer", "cv_eer_se", "cv_tdcf")], "folds")


def q_one_se_fusion(s, d):
    """The trained fusion chosen in each arm under each norm."""
    cv = q_logistic_fusion_cv(s, d).where("weights = 'trained'")
    return fusion.one_se_choice(cv, ["arm", "norm"]).select("arm", "norm", "candidate", "n_systems", "cv_eer", "cv_eer_se", F.round("limit", 9).alias("threshold"))


def q_transfer_check(s, d):
    """Every fusion fitted on one part, applied to another under both norms, and what the norm changes."""
    m, scored = fusion.transfer(part(s, d, "progress"), part(s, d, "eval"), CANDIDATES)
    e = metrics.eer(scored, ["candidate", "n_systems", "norm"])
    own = lambda norm: F.max(F.when(F.col("norm") == norm, F.col("eer")))
    coef = [(name, [round(float(m.weights[0, i, 1 + p]), 6) + 0.0 for p in own_places], round(float(m.weights[0, i, 0]), 6) + 0.0) for i, (name, own_places) in enumerate(m.candidates.items())]
    weights = s.createDataFrame(coef, "candidate string, coef array<double>, intercept double").select("candidate", F.concat_ws(",", F.transform("coef", lambda v: F.format_string("%.6f", v))).alias("coef"), "intercept")
    wide = e.groupBy("candidate", "n_systems").agg(F.round(own("fit-norm"), 9).alias("fit_norm"), F.round(own("apply-norm"), 9).alias("apply_norm"), F.round(own("apply-norm") - own("fit-norm"), 9).alias("delta"))
    return wide.join(weights, "candidate")


def q_fusion_weights(s, d):
    """A stored fusion's scores (as floats in a file), its weights fitted again without them, and the scores that these give."""
    m, scored = fusion.transfer(part(s, d, "progress"), part(s, d, "eval").withColumn("y", F.col("filename")), {STORED: CANDIDATES[STORED]}, ("fit-norm",))
    path = files.scratch(s, "fused")
    scored.select(F.col("y").alias("filename"), F.col("score").cast("float").alias("stored")).write.parquet(path)
    w, b = m.weights[0, 0, 1:], float(m.weights[0, 0, 0])
    share = np.abs(w).sum()
    stats = fusion.statistics(part(s, d, "progress"), CANDIDATES[STORED])
    again = sum((F.col(x) - stats[x][0]) / stats[x][1] * float(v) for x, v in zip(CANDIDATES[STORED], w)) + b
    worst = part(s, d, "eval").withColumn("again", again).join(s.read.parquet(path), "filename").agg(F.max(F.abs(F.col("again") - F.col("stored"))).alias("worst"), F.count("*").alias("n"))
    rows = [(x, round(float(v), 6), round(float(abs(v) / share), 6), round(stats[x][0], 6), round(stats[x][1], 6), round(b, 6)) for x, v in zip(CANDIDATES[STORED], w)]
    table = s.createDataFrame(rows, "system string, coef double, share double, z_mean double, z_dev double, intercept double")
    return table.crossJoin(F.broadcast(worst.select((F.col("worst") < 1e-4).alias("reproduced"), "n")))  # one row


def q_price_of_trained_labels(s, d):
    """Each arm's chosen fusion (apply-norm), fitted on all of the arm and applied once; the difference is the price of labels
    of the other arm."""
    chosen = {r.arm: r for r in q_one_se_fusion(s, d).where("norm = 'apply-norm'").collect()}  # two rows
    out = None
    for arm in ("hidden", "progress"):
        if arm in chosen:
            name = chosen[arm].candidate
            _, scored = fusion.transfer(part(s, d, arm), part(s, d, "eval"), {name: CANDIDATES[name]}, ("apply-norm",))
            rows = scored.withColumn("arm", F.lit(arm))
            out = rows if out is None else out.unionByName(rows)
    alone = part(s, d, "eval").select("y", F.col("A").alias("score"), F.lit("-").alias("arm"))
    e = metrics.eer(out.select("arm", "candidate", "y", "score").unionByName(alone.withColumn("candidate", F.lit("A"))), ["arm", "candidate"])
    all_ = Window.partitionBy(F.lit(0))  # three rows
    at = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("eer"))).over(all_)
    e = e.select("arm", "candidate", "eer", at("-").alias("one"), (at("hidden") - at("progress")).alias("price")).where("arm <> '-'")
    return e.select("arm", "candidate", F.round("eer", 9).alias("eer"), F.round(F.col("eer") - F.col("one"), 9).alias("delta"), F.round("price", 9).alias("price"))


def q_trained_seed_sweep(s, d):
    """How the choice among trained fusions depends on the seed and the number of folds."""
    cv = fusion.cross_validate(part(s, d, "progress"), CANDIDATES, SPLITS, ("fit-norm",)).where("weights = 'trained'")
    cv = cv.select("seed", "k", "candidate", "n_systems", F.round("cv_eer", 9).alias("cv_eer"), F.round("cv_eer_se", 9).alias("cv_eer_se"), "folds")
    group = Window.partitionBy("seed", "k")  # a row a candidate
    cv = cv.withColumn("b", F.min(F.struct("cv_eer", "candidate", "cv_eer_se")).over(group)).withColumn("threshold", F.round(F.col("b.cv_eer") + F.col("b.cv_eer_se"), 9))
    cv = cv.withColumn("in_band", F.col("cv_eer") <= F.col("threshold"))
    first = group.orderBy(F.col("in_band").desc(), "n_systems", "cv_eer", "candidate")
    return cv.select("seed", "k", "candidate", "n_systems", "cv_eer", "cv_eer_se", "folds", "threshold", F.round(F.col("threshold") - F.col("cv_eer"), 9).alias("headroom"), "in_band", (F.col("candidate") == F.col("b.candidate")).alias("is_best"), (F.row_number().over(first) == 1).alias("selected"))


#: Newton steps in SQL.
STEPS = 9
KEYS = "arm, split, fit, candidate, n_systems"
WIDE = "w AS (SELECT filename, speaker, y, part AS arm, value AS a, CAST(n_frames AS DOUBLE) AS b, value - n_frames / CAST(2 AS DOUBLE) AS c FROM base)"
CANDS = "cand AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {len(of)}, {', '.join(f'{float(x in of)}::DOUBLE' for x in SYSTEMS)})" for n, of in CANDIDATES.items()) + ") v(candidate, n_systems, m1, m2, m3))"


def dealt_sql(splits, arms) -> str:
    """g, f, t: the splits, each speaker's fold by split, and the trials with both."""
    rows = ", ".join(f"({i}, {seed}, {k})" for i, (seed, k) in enumerate(splits))
    of = ", ".join(f"'{a}'" for a in arms)
    key = "CAST('0x' || substr(md5(CAST(speaker AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), 1, 15) AS BIGINT)"
    tile = lambda k: f"WHEN {k} THEN ntile({k}) OVER (PARTITION BY arm, split ORDER BY {key}, speaker)"
    return f"""
g AS (SELECT * FROM (VALUES {rows}) v(split, seed, k)),
f AS (SELECT arm, speaker, split, CASE k {" ".join(tile(k) for k in sorted({k for _, k in splits}))} END AS fold FROM (SELECT DISTINCT arm, speaker FROM w WHERE arm IN ({of})) s CROSS JOIN g),
t AS (SELECT w.*, f.split, f.fold FROM w JOIN f ON f.arm = w.arm AND f.speaker = w.speaker)"""


def moments_sql(name: str, on: str) -> str:
    """The statistics of each fit's own trials, or of those that it is applied to."""
    stats = ", ".join(f"AVG({x}) AS m{x}, COALESCE(NULLIF(STDDEV_POP({x}), 0), 1) AS d{x}" for x in "abc")
    return f"{name} AS (SELECT t.arm, t.split, k.fold AS fit, {stats} FROM t JOIN (SELECT DISTINCT arm, split, fold FROM f) k ON k.arm = t.arm AND k.split = t.split AND t.fold {on} k.fold GROUP BY t.arm, t.split, k.fold)"


def newton_sql(steps: int = STEPS) -> list[str]:
    """beta: the penalised logistic weights b0..b3 of every fit in x (keys, y, z1..z3, m1..m3), by unrolled Newton steps; each solves
    its system by Cholesky's method. Systems outside of a candidate have a unit row."""
    out = [f"beta0 AS (SELECT {KEYS}, m1, m2, m3, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2, CAST(0 AS DOUBLE) AS b3 FROM x GROUP BY ALL)"]
    z = ["CAST(1 AS DOUBLE)", "z1", "z2", "z3"]
    for s in range(steps):
        p = "1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2 + b3 * z3)))"
        h = ", ".join(f"SUM(p * (1 - p) * {z[i]} * {z[j]}) AS r{i}{j}" for i in range(4) for j in range(i + 1))
        g = ", ".join(f"SUM((y - p) * {z[i]}) AS q{i}" for i in range(4))
        mask = ["1", "m1", "m2", "m3"]
        cells = [f"r{i}{j} * {mask[i]} * {mask[j]}" + (f" + {mask[i]} + (1 - {mask[i]})" if i == j and i else "") + f" AS h{i}{j}" for i in range(4) for j in range(i + 1)]
        grads = [f"{mask[i]} * (q{i}{f' - b{i}' if i else ''}) AS g{i}" for i in range(4)]
        chol = []
        for j in range(4):
            chol.append(f"sqrt(h{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(j))}) AS l{j}{j}")
            chol += [f"(h{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, 4)]
        forward = [f"(g{i}{''.join(f' - l{i}{k} * u{k}' for k in range(i))}) / l{i}{i} AS u{i}" for i in range(4)]
        back = [f"(u{i}{''.join(f' - l{k}{i} * d{k}' for k in range(i + 1, 4))}) / l{i}{i} AS d{i}" for i in (3, 2, 1, 0)]
        out.append(
            f"beta{s + 1} AS MATERIALIZED (SELECT {KEYS}, m1, m2, m3, b0 + d0 AS b0, b1 + d1 AS b1, b2 + d2 AS b2, b3 + d3 AS b3 FROM (SELECT *, {', '.join([*cells, *grads, *chol, *forward, *back])} FROM ("
            f"SELECT {KEYS}, m1, m2, m3, b0, b1, b2, b3, {h}, {g} FROM (SELECT x.y, z1, z2, z3, e.*, {p} AS p FROM x JOIN beta{s} e USING ({KEYS})) v GROUP BY ALL) u) q)"
        )
    return [*out, f"beta AS (SELECT * FROM beta{steps})"]


NORMED = ", ".join(f"({c} - m{c}) / d{c} AS z{i}" for i, c in enumerate("abc", 1))
MODELS = "models AS (SELECT *, 'trained' AS weights FROM beta UNION ALL SELECT * REPLACE (CAST(0 AS DOUBLE) AS b0, m1 / n_systems AS b1, m2 / n_systems AS b2, m3 / n_systems AS b3), 'equal' AS weights FROM beta WHERE n_systems > 1)"
SCORE = "ROUND(b0 + b1 * z1 + b2 * z2 + b3 * z3, 6) AS score"


def cv_sql(splits, arms, norms=fusion.NORMS, tandem: bool = True) -> list[str]:
    """cv: the errors of every candidate, norm and weighting, by arm and split."""
    held = " UNION ALL ".join(f"SELECT {KEYS}, weights, '{norm}' AS norm, y, {SCORE} FROM (SELECT t.*, {NORMED} FROM t JOIN {stats} ON {stats}.arm = t.arm AND {stats}.split = t.split AND {stats}.fit = t.fold) v JOIN models ON models.arm = v.arm AND models.split = v.split AND models.fit = v.fold".replace(f"SELECT {KEYS}", "SELECT models.arm, models.split, models.fit, candidate, n_systems") for norm, stats in (("fit-norm", "fs"), ("apply-norm", "aps")) if norm in norms)
    by = f"{KEYS}, norm, weights"
    group = "arm, split, candidate, n_systems, norm, weights"
    return [
        BASE, *([ASV] if tandem else []), WIDE, dealt_sql(splits, arms), moments_sql("fs", "<>"), moments_sql("aps", "="), CANDS,
        f"x AS MATERIALIZED (SELECT fs.arm, fs.split, fs.fit, y, candidate, n_systems, m1, m2, m3, {NORMED} FROM t JOIN fs ON fs.arm = t.arm AND fs.split = t.split AND fs.fit <> t.fold CROSS JOIN cand)",
        *newton_sql(), MODELS, f"scored AS ({held})", curve_sql("scored", by), eer_sql("curve", by), *([tdcf_sql("curve", by)] if tandem else []),
        f"cv AS (SELECT {group}, AVG(eer) AS cv_eer, STDDEV_SAMP(eer) / SQRT(COUNT(*)) AS cv_eer_se, COUNT(*) AS folds{', AVG(min_tdcf) AS cv_tdcf' if tandem else ''} FROM eer {f'JOIN tdcf USING ({by})' if tandem else ''} GROUP BY ALL)",
    ]


CV9 = "SELECT arm, candidate, n_systems, norm, weights, ROUND(cv_eer, 9) AS cv_eer, ROUND(cv_eer_se, 9) AS cv_eer_se, ROUND(cv_tdcf, 9) AS cv_tdcf, folds FROM cv"
CHOSEN = f"cv9 AS ({CV9}), lim AS (SELECT arm, norm, cv_eer + COALESCE(cv_eer_se, 0) AS top FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm, norm ORDER BY cv_eer, candidate) AS r FROM cv9 WHERE weights = 'trained') v WHERE r = 1), chosen AS (SELECT * FROM (SELECT cv9.*, top, ROW_NUMBER() OVER (PARTITION BY arm, norm ORDER BY n_systems, cv_eer, candidate) AS r FROM cv9 JOIN lim USING (arm, norm) WHERE weights = 'trained' AND cv_eer <= top) v WHERE r = 1)"


def whole_sql(arms, suffix: str = "") -> list[str]:
    """beta over all of each arm: one fit, numbered 0."""
    stats = lambda src: f"SELECT {', '.join(f'AVG({x}) AS m{x}, COALESCE(NULLIF(STDDEV_POP({x}), 0), 1) AS d{x}' for x in 'abc')} FROM {src}"
    of = ", ".join(f"'{a}'" for a in arms)
    return [
        f"ws AS (SELECT arm, {', '.join(f'AVG({x}) AS m{x}, COALESCE(NULLIF(STDDEV_POP({x}), 0), 1) AS d{x}' for x in 'abc')} FROM w WHERE arm IN ({of}) GROUP BY arm)",
        f"es AS ({stats('w')} WHERE arm = 'eval')",
        f"x AS MATERIALIZED (SELECT w.arm, 0 AS split, 0 AS fit, y, candidate, n_systems, m1, m2, m3, {NORMED} FROM w JOIN ws ON ws.arm = w.arm CROSS JOIN cand)",
        *newton_sql(),
        f"target AS (SELECT ws.arm, 'fit-norm' AS norm, filename, y, {NORMED} FROM w JOIN ws ON true WHERE w.arm = 'eval' UNION ALL SELECT ws.arm, 'apply-norm', filename, y, {NORMED.replace('ma)', 'es.ma)').replace('mb)', 'es.mb)').replace('mc)', 'es.mc)').replace('/ d', '/ es.d')} FROM w CROSS JOIN es JOIN ws ON true WHERE w.arm = 'eval')",
        f"scored AS (SELECT beta.arm, candidate, n_systems, norm, filename, y, {SCORE} FROM target JOIN beta ON beta.arm = target.arm)",
    ]


FIX = lambda c: f"printf('%.6f', ROUND({c}, 6) + CAST(0 AS DOUBLE))"
COEFS = "concat_ws(',', " + ", ".join(f"CASE WHEN m{i} = 1 THEN {FIX(f'b{i}')} END" for i in (1, 2, 3)) + ")"
Q = {
    "q_logistic_fusion_cv": (q_logistic_fusion_cv, with_(*cv_sql(SPLIT, ("progress", "hidden"))) + f" {CV9}"),
    "q_one_se_fusion": (q_one_se_fusion, with_(*cv_sql(SPLIT, ("progress", "hidden")), CHOSEN) + " SELECT arm, norm, candidate, n_systems, cv_eer, cv_eer_se, ROUND(top, 9) AS threshold FROM chosen"),
    "q_transfer_check": (
        q_transfer_check,
        with_(BASE, WIDE, CANDS, *whole_sql(("progress",)), curve_sql("scored", "candidate, n_systems, norm"), eer_sql("curve", "candidate, n_systems, norm"), "wide AS (SELECT candidate, n_systems, MAX(CASE WHEN norm = 'fit-norm' THEN eer END) AS f, MAX(CASE WHEN norm = 'apply-norm' THEN eer END) AS a FROM eer GROUP BY ALL)")
        + f" SELECT candidate, wide.n_systems, ROUND(f, 9) AS fit_norm, ROUND(a, 9) AS apply_norm, ROUND(a - f, 9) AS delta, {COEFS} AS coef, ROUND(b0, 6) + CAST(0 AS DOUBLE) AS intercept FROM wide JOIN beta USING (candidate)",
    ),
    "q_fusion_weights": (
        q_fusion_weights,
        with_(BASE, WIDE, CANDS, *whole_sql(("progress",)), "own AS (SELECT beta.*, ws.* EXCLUDE (arm) FROM beta JOIN ws ON ws.arm = beta.arm WHERE candidate = 'A+B')", "worst AS (SELECT MAX(ABS(b0 + b1 * (a - ma) / da + b2 * (b - mb) / db - CAST(score AS FLOAT))) < 1e-4 AS reproduced, COUNT(*) AS n FROM own CROSS JOIN (SELECT w.*, score FROM w JOIN scored USING (filename) WHERE w.arm = 'eval' AND candidate = 'A+B' AND norm = 'fit-norm') v)")
        + " UNION ALL ".join(f" SELECT '{x}' AS system, ROUND({b}, 6) AS coef, ROUND(ABS({b}) / (ABS(b1) + ABS(b2)), 6) AS share, ROUND({m}, 6) AS z_mean, ROUND({dev}, 6) AS z_dev, ROUND(b0, 6) AS intercept, reproduced, n FROM own CROSS JOIN worst" for x, b, m, dev in (("A", "b1", "ma", "da"), ("B", "b2", "mb", "db"))),
    ),
    "q_price_of_trained_labels": (
        q_price_of_trained_labels,
        f"WITH picked AS ({with_(*cv_sql(SPLIT, ('progress', 'hidden')), CHOSEN)} SELECT arm, candidate FROM chosen WHERE norm = 'apply-norm'), "
        + ", ".join(x.strip() for x in (BASE, WIDE, CANDS, *whole_sql(("progress", "hidden")), "mine AS (SELECT scored.* FROM scored JOIN picked USING (arm, candidate) WHERE norm = 'apply-norm' UNION ALL SELECT '-', 'A', 1, '-', filename, y, a FROM w WHERE arm = 'eval')", curve_sql("mine", "arm, candidate"), eer_sql("curve", "arm, candidate")))
        + " SELECT arm, candidate, ROUND(eer, 9) AS eer, ROUND(eer - (SELECT eer FROM eer WHERE arm = '-'), 9) AS delta, ROUND((SELECT eer FROM eer WHERE arm = 'hidden') - (SELECT eer FROM eer WHERE arm = 'progress'), 9) AS price FROM eer WHERE arm <> '-'",
    ),
    "q_trained_seed_sweep": (
        q_trained_seed_sweep,
        with_(*cv_sql(SPLITS, ("progress",), ("fit-norm",), tandem=False), "r AS (SELECT seed, k, candidate, n_systems, ROUND(cv_eer, 9) AS cv_eer, ROUND(cv_eer_se, 9) AS cv_eer_se, folds FROM cv JOIN g ON g.split = cv.split WHERE weights = 'trained')", "top AS (SELECT seed, k, candidate AS best, ROUND(cv_eer + cv_eer_se, 9) AS threshold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY seed, k ORDER BY cv_eer, candidate) AS n FROM r) v WHERE n = 1)")
        + " SELECT r.*, threshold, ROUND(threshold - cv_eer, 9) AS headroom, cv_eer <= threshold AS in_band, candidate = best AS is_best, ROW_NUMBER() OVER (PARTITION BY seed, k ORDER BY cv_eer <= threshold DESC, n_systems, cv_eer, candidate) = 1 AS selected FROM r JOIN top USING (seed, k)",
    ),
}
QUERIES = {k: v[0] for k, v in Q.items()}
ORACLE_SQL = {k: duckdb(v[1]) for k, v in Q.items()}
