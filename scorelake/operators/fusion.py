"""Score fusion (L01-L08, R11, R12): z-normalisation, logistic and equal weights, speaker-disjoint cross-validation, one-SE choice.

Many logistic fusions are fitted in one pass. A *fit* leaves out one fold of one split (fold 0: none), a *model* is a fit and a
candidate (a subset of the systems). Newton's method (iteratively reweighted least squares) needs, for each model, the sums X'WX,
X'(y - p) and the loss; every task adds these up for all models over its rows, and one aggregation a step adds the tasks'. What
reaches the driver in a step is (systems + 1)² + systems + 2 numbers a model, whatever the number of trials; it solves one small system a model.
A step that raises a model's loss is halved for that model alone.

Trials carry `x` (array of the systems' scores), `y`, and `held`: the fold, from 1, that they are in, by split. The penalty is that of
½|w|² + C·Σloss with the intercept free. A fit of one class or without rows has no weights; its scores are null and take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, ordering

NORMS = ("fit-norm", "apply-norm")
#: Newton steps at most, and the change of the weights at which they end.
STEPS, TOLERANCE = 50, 1e-10


def statistics(wide: DataFrame, systems: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Population mean and deviation per system; a deviation of zero counts as 1. One row reaches the driver."""
    row = wide.agg(*[F.avg(s).alias(f"m_{s}") for s in systems], *[F.stddev_pop(s).alias(f"d_{s}") for s in systems]).first()
    return {s: (row[f"m_{s}"] or 0.0, row[f"d_{s}"] or 1.0) for s in systems}


def znormed(wide: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return wide.select(*[c for c in wide.columns if c not in stats], *[((F.col(s) - m) / d).alias(s) for s, (m, d) in stats.items()])


def speaker_splits(trials: DataFrame, splits: Sequence[tuple[int, int]]) -> DataFrame:
    """speaker, held: the fold, from 1, of each speaker in each split (seed, number of folds). Speakers in the order of a seeded hash
    are dealt near-equally, the first folds one larger; the order is cut into slices, so no task holds all speakers."""
    cells = F.array(*[F.struct(F.lit(i).alias("split"), F.lit(seed).alias("seed"), F.lit(k).alias("k")) for i, (seed, k) in enumerate(splits)])
    each = trials.select("speaker").where("speaker is not null").distinct().select("speaker", F.explode(cells).alias("s")).select("speaker", "s.*")
    order = F.md5(F.concat(F.col("speaker").cast("string"), F.lit(":"), F.col("seed").cast("string")))
    key = F.conv(F.substring(order, 1, 15), 16, 10).cast("long")
    placed = ordering.numbered(each.withColumn("u", key), ["split"], "u", ["speaker"])
    small, more, at = F.floor(F.col("position_total") / F.col("k")), F.col("position_total") % F.col("k"), F.col("position") - 1
    long = more * (small + 1)
    fold = (F.when(at < long, F.floor(at / (small + 1))).otherwise(more + F.floor((at - long) / F.greatest(small, F.lit(1)))) + 1).cast("int")
    return placed.withColumn("fold", fold).groupBy("speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("split", "fold"))), lambda s: s["fold"]).alias("held"))


def speaker_folds(trials: DataFrame, k: int, seed: int) -> DataFrame:
    """Speaker, fold."""
    return speaker_splits(trials, [(seed, k)]).select("speaker", F.get("held", F.lit(0)).alias("fold"))


def trials_of(wide: DataFrame, systems: Sequence[str], splits: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """y, x, held of the trials that have all scores; without splits held is empty."""
    full = wide.where(F.array_size(F.filter(F.array(*[F.col(s).cast("double") for s in systems]), lambda v: v.isNotNull() & ~F.isnan(v))) == len(systems))
    cols = [F.col("y").cast("int"), F.array(*[F.col(s).cast("double") for s in systems]).alias("x")]
    if not splits:
        return full.select(*cols, F.expr("cast(array() as array<int>)").alias("held"))
    return full.join(ordering.measured(speaker_splits(wide, splits).cache()), "speaker").select(*cols, "held")


@dataclass
class Models:
    """fits (split, fold), the systems of each candidate, and for each fit: trials, mean and deviation of all systems; weights[fit,
    candidate] on normalised scores, the intercept first; steps taken."""

    fits: list[tuple[int, int]]
    candidates: dict[str, list[int]]
    n: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    weights: np.ndarray
    steps: int


def moments(trials: DataFrame, n_systems: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(split, fold) -> trials by class, mean and mean square deviation of each system over the fold; split -1, fold 0: all trials."""
    cells = F.concat(F.array(F.struct(F.lit(-1).alias("split"), F.lit(0).alias("fold"))), F.transform("held", lambda f, i: F.struct(i.alias("split"), f.alias("fold"))))
    each = trials.select("y", "x", F.explode(cells).alias("c"))
    one = [f(F.get("x", F.lit(i))).alias(f"{n}{i}") for n, f in (("m", F.avg), ("v", F.var_pop)) for i in range(n_systems)]
    rows = each.groupBy("c.split", "c.fold").agg(F.count("*").alias("n"), F.sum("y").alias("n1"), *one).collect()  # a row a fold
    return {(r.split, r.fold): (np.array([r.n - r.n1, r.n1], float), np.array([r[f"m{i}"] for i in range(n_systems)]), np.array([r[f"v{i}"] for i in range(n_systems)])) for r in rows}


def merged(parts: list, n_systems: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and mean square deviations of sets of trials taken together."""
    if not parts:
        return np.zeros(2), np.zeros(n_systems), np.zeros(n_systems)
    n = np.array([p[0].sum() for p in parts])[:, None]
    mean = (n * [p[1] for p in parts]).sum(0) / n.sum()
    return sum(p[0] for p in parts), mean, (n * (np.array([p[2] for p in parts]) + (np.array([p[1] for p in parts]) - mean) ** 2)).sum(0) / n.sum()


def sums(trials: DataFrame, fits, mean, dev, masks, weights) -> np.ndarray:
    """[fit, candidate]: loss, gradient and Hessian of the log-likelihood, summed over all trials of the fit."""
    n_fits, n_cands, d = weights.shape

    def run(batches):
        import pyarrow as pa

        total = np.zeros((n_fits, n_cands, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(0).to_numpy(zero_copy_only=False).astype(float)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d - 1)
            held = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for f, (split, fold) in enumerate(fits):
                use = slice(None) if fold == 0 else held[:, split] != fold
                z = np.concatenate([np.ones((len(y[use]), 1)), (x[use] - mean[f]) / dev[f]], 1)
                eta = z @ weights[f].T
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                total[f, :, 0] += (np.logaddexp(0, eta) - y[use, None] * eta).sum(0)
                total[f, :, 1 : 1 + d] += (y[use, None] - p).T @ z * masks
                for c in range(n_cands):
                    total[f, c, 1 + d :] += ((z * (p[:, c] * (1 - p[:, c]))[:, None]).T @ z * masks[c] * masks[c][:, None]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    out = np.zeros(n_fits * n_cands * (1 + d + d * d))
    for r in trials.select("y", "x", "held").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a model's numbers
        out[r.i] = r.v
    return out.reshape(n_fits, n_cands, -1)


def fit(trials: DataFrame, systems: Sequence[str], candidates: dict[str, Sequence[str]], fits: list[tuple[int, int]], c: float = 1.0) -> Models:
    """The logistic weights of every candidate on every fit. trials is scanned once a step: store or cache it."""
    d = len(systems) + 1
    places = {name: [list(systems).index(s) for s in of] for name, of in candidates.items()}
    by_fold = moments(trials, len(systems))
    held = [f for f in by_fold if f[0] >= 0]
    stats = [merged([by_fold[h] for h in held if h[0] == split and h[1] != fold] if fold else [v for k, v in by_fold.items() if k == (-1, 0)], len(systems)) for split, fold in fits]
    n, mean, dev = np.array([s[0] for s in stats]), np.array([s[1] for s in stats]), np.sqrt(np.array([s[2] for s in stats]))
    dev[dev == 0] = 1.0
    masks = np.array([[1.0] + [float(i in own) for i in range(d - 1)] for own in places.values()])
    penalty = np.concatenate([[0.0], np.full(d - 1, 1 / c)])
    usable = (n > 0).all(1)
    weights = np.where(usable[:, None, None], 0.0, np.nan) * np.ones((len(fits), len(places), d))
    step, best, last = np.zeros_like(weights), np.full(weights.shape[:2], np.inf), np.zeros_like(weights)
    for steps in range(1, STEPS + 1):
        now = weights + step
        got = sums(trials, fits, mean, dev, masks, np.nan_to_num(now))
        loss = got[..., 0] + (penalty * now**2).sum(-1) / 2
        worse = loss > best + 1e-9 * np.abs(best)
        gradient = got[..., 1 : 1 + d] - penalty * np.nan_to_num(now)
        hessian = got[..., 1 + d :].reshape(*weights.shape, d) + np.eye(d) * (penalty * masks + (1 - masks))[:, None, :]
        hessian[~usable] = np.eye(d)
        newton = np.linalg.solve(hessian, gradient[..., None])[..., 0]
        step = np.where(worse[..., None], step / 2, newton)
        weights = np.where(worse[..., None], weights, now)
        best = np.where(worse, best, loss)
        last = np.abs(step[usable]).max() if usable.any() else 0.0
        if last < TOLERANCE:
            break
    return Models(fits, places, n, mean, dev, np.where(usable[:, None, None], weights + step, np.nan), steps)


def applied(m: Models, systems: Sequence[str], apply: list | None = None, norms: Sequence[str] = NORMS, equal: bool = True) -> list[tuple]:
    """Rows (split, fold, candidate, n_systems, norm, weights, coef, intercept): every model as weights on the scores as they are.
    apply holds the mean and deviation of the set that each fit is applied to, which apply-norm takes."""
    rows = []
    for f, (split, fold) in enumerate(m.fits):
        for norm in norms:
            mean, dev = (m.mean[f], m.dev[f]) if norm == "fit-norm" else apply[f]
            for k, (name, own) in enumerate(m.candidates.items()):
                alike = np.zeros(len(systems) + 1)
                alike[1:][own] = 1 / len(own)
                for kind, w in (("trained", m.weights[f, k]), ("equal", alike)):
                    if kind == "trained" or (equal and len(own) > 1):  # the mean of one system is itself
                        rows.append((split, fold, name, len(own), norm, kind, (w[1:] / dev).tolist(), float(w[0] - (w[1:] * mean / dev).sum())))
    return rows


MODEL = "split int, fold int, candidate string, n_systems int, norm string, weights string, coef array<double>, intercept double"


def scores(trials: DataFrame, rows: list[tuple], digits: int = 6) -> DataFrame:
    """The trials with a model's columns and `score` added, a row for each model of the fold that a trial is in. There is a row a
    model on the driver; it is broadcast by that bound."""
    models = trials.sparkSession.createDataFrame([(*r[:6], [float(v) for v in r[6]], r[7]) for r in rows], MODEL)
    own = trials.select("*", F.posexplode("held").alias("split", "fold")) if any(r[1] for r in rows) else trials.select("*", F.lit(0).alias("split"), F.lit(0).alias("fold"))
    total = F.aggregate(F.zip_with("coef", "x", lambda w, v: w * v), F.col("intercept"), lambda a, b: a + b)
    out = own.join(F.broadcast(models), ["split", "fold"])
    return out.withColumn("score", F.round(F.when(~F.isnan(total), total), digits)).drop("coef", "intercept", "held", "x")


def cross_validate(wide: DataFrame, candidates: dict[str, Sequence[str]], splits: Sequence[tuple[int, int]] = ((42, 5),), norms: Sequence[str] = NORMS, coefficients: DataFrame | None = None) -> DataFrame:
    """Seed, k, candidate, n_systems, norm, weights, cv_eer, cv_eer_se, folds over speaker-disjoint folds of every split, and with the
    tandem cost's coefficients cv_tdcf; folds of one class are left out. All models of all splits are fitted together."""
    systems = list(dict.fromkeys(s for of in candidates.values() for s in of))
    trials = trials_of(wide, systems, splits).persist()
    try:
        fits = [(i, f) for i, (_, k) in enumerate(splits) for f in range(1, k + 1)]
        m = fit(trials, systems, candidates, fits)
        own = moments(trials, len(systems))
    finally:
        trials.unpersist()
    apply = []
    for f in fits:
        _, mean, var = own.get(f, merged([], len(systems)))
        apply.append((mean, np.where(var > 0, np.sqrt(var), 1.0)))
    scored = scores(trials, applied(m, systems, apply, norms))
    by = ["split", "candidate", "n_systems", "norm", "weights"]
    curve = metrics.error_curve(scored, [*by, "fold"])
    e = metrics.eer_of(curve, [*by, "fold"])
    values = [F.avg("eer").alias("cv_eer"), (F.stddev_samp("eer") / F.sqrt(F.count("eer"))).alias("cv_eer_se"), F.count("*").alias("folds")]
    if coefficients is not None:
        e = e.join(metrics.min_tdcf_of(curve, [*by, "fold"], coefficients), [*by, "fold"])
        values.append(F.avg("min_tdcf").alias("cv_tdcf"))
    grid = trials.sparkSession.createDataFrame([(i, s, k) for i, (s, k) in enumerate(splits)], "split int, seed int, k int")
    return e.groupBy(*by).agg(*values).join(F.broadcast(grid), "split").drop("split")  # a row a split


def transfer(fit_on: DataFrame, apply_to: DataFrame, candidates: dict[str, Sequence[str]], norms: Sequence[str] = NORMS, equal: bool = False) -> tuple[Models, DataFrame]:
    """The models fitted on all of one table, and the other table's trials with every model's score."""
    systems = list(dict.fromkeys(s for of in candidates.values() for s in of))
    trials, target = trials_of(fit_on, systems).persist(), trials_of(apply_to, systems)
    try:
        m = fit(trials, systems, candidates, [(0, 0)])
    finally:
        trials.unpersist()
    _, mean, var = moments(target, len(systems)).get((-1, 0), merged([], len(systems)))
    return m, scores(target, applied(m, systems, [(mean, np.where(var > 0, np.sqrt(var), 1.0))], norms, equal)).drop("split", "fold")


def one_se_choice(cv: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fewest systems, then least error, among those within a standard error of the best; by group. A group has a row a candidate."""
    group = [F.col(c) for c in by] or [F.lit(0)]
    limit = F.min_by(F.col("cv_eer") + F.coalesce("cv_eer_se", F.lit(0.0)), F.struct("cv_eer", "candidate")).over(Window.partitionBy(*group))
    order = Window.partitionBy(*group).orderBy("n_systems", "cv_eer", "weights", "candidate")
    return cv.withColumn("limit", limit).where("cv_eer <= limit").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
