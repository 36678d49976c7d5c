"""Fusion against a plain Newton fit of every model alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from scorelake.operators import fusion, metrics, ordering


def plain(z, y, c=1.0):
    """Penalised logistic weights of one model, intercept first."""
    x = np.concatenate([np.ones((len(y), 1)), z], 1)
    pen = np.concatenate([[0.0], np.full(z.shape[1], 1 / c)])
    loss = lambda b: (np.logaddexp(0, x @ b) - y * (x @ b)).sum() + (pen * b * b).sum() / 2
    b = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * b)
        while loss(b + step) > loss(b) + 1e-12:
            step = step / 2
            if np.abs(step).max() < 1e-14:
                return b
        b = b + step
    return b


@pytest.fixture(scope="module")
def wide(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 400)
    rows = [(i, i % 23, int(v), float(v + r.normal()), float(v * 2 + r.normal(0, 2)), float(r.normal())) for i, v in enumerate(y)]
    rows += [(1000, 3, 1, None, 1.0, 1.0), (1001, 4, 0, 1.0, float("nan"), 1.0), (1002, None, 0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "filename long, speaker long, y int, A double, B double, C double").cache()


def complete(wide):
    return [r for r in wide.collect() if None not in (r.A, r.B, r.C, r.speaker) and r.B == r.B]


CANDS = {"A": ["A"], "A+B": ["A", "B"], "A+B+C": ["A", "B", "C"]}


def test_all_models_equal_fits_made_alone(wide):
    splits = ((1, 3), (2, 4))
    trials = fusion.trials_of(wide, "ABC", splits).cache()
    fits = [(s, f) for s, (_, k) in enumerate(splits) for f in range(1, k + 1)] + [(0, 0)]
    m = fusion.fit(trials, "ABC", CANDS, fits)
    assert m.steps < 15
    rows = trials.collect()
    for i, (split, fold) in enumerate(fits):
        own = [r for r in rows if fold == 0 or r.held[split] != fold]
        x, y = np.array([r.x for r in own]), np.array([r.y for r in own])
        assert np.allclose(m.mean[i], x.mean(0)) and np.allclose(m.dev[i], x.std(0))
        for k, places in enumerate(m.candidates.values()):
            want = plain(((x - x.mean(0)) / x.std(0))[:, places], y)
            assert np.allclose(m.weights[i, k][[0, *[1 + p for p in places]]], want, atol=1e-8)
            assert all(m.weights[i, k][1 + p] == 0 for p in range(3) if p not in places)


def test_separable_scores_converge(spark):
    """Newton's first step overshoots on separable classes of very unequal size; halving brings every model home."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 0.01, 2000), r.normal(50, 0.01, 5)])
    y = (np.arange(2005) >= 2000).astype(int)
    df = spark.createDataFrame([(int(v), [float(a)], []) for v, a in zip(y, x)], "y int, x array<double>, held array<int>").cache()
    m = fusion.fit(df, "A", {"A": ["A"]}, [(0, 0)], c=100.0)
    assert np.allclose(m.weights[0, 0], plain((x[:, None] - x.mean()) / x.std(), y, 100.0), rtol=1e-6)


def test_folds_and_cross_validation(wide):
    folds = fusion.speaker_folds(wide, 5, 1).groupBy("fold").count().orderBy("fold").collect()
    assert [x["count"] for x in folds] == [5, 5, 5, 4, 4]
    cv = fusion.cross_validate(wide, {**CANDS, "C": ["C"]}, ((9, 3),))
    got = {(x.candidate, x.norm, x.weights): x for x in cv.collect()}
    assert len(got) == 2 * (4 + 2) and all(x.folds == 3 and x.seed == 9 and x.k == 3 for x in got.values())
    # one held-out fold by hand, under both norms
    fold = {r.speaker: r.fold for r in fusion.speaker_folds(wide, 3, 9).collect()}
    rows = complete(wide)
    spark = wide.sparkSession
    for norm in fusion.NORMS:
        eers = []
        for f in (1, 2, 3):
            fit, held = [r for r in rows if fold[r.speaker] != f], [r for r in rows if fold[r.speaker] == f]
            x, t = np.array([[r.A, r.B] for r in fit]), np.array([[r.A, r.B] for r in held])
            w = plain((x - x.mean(0)) / x.std(0), np.array([r.y for r in fit]))
            z = (t - x.mean(0)) / x.std(0) if norm == "fit-norm" else (t - t.mean(0)) / t.std(0)
            scored = spark.createDataFrame([(1, r.y, round(float(s), 6)) for r, s in zip(held, z @ w[1:] + w[0])], "g int, y int, score double")
            eers.append(metrics.eer(scored, ["g"]).first().eer)
        x = got["A+B", norm, "trained"]
        assert x.cv_eer == pytest.approx(np.mean(eers)) and x.cv_eer_se == pytest.approx(np.std(eers, ddof=1) / np.sqrt(3))


def test_fits_of_one_class_and_empty_tables(wide, spark):
    one = fusion.cross_validate(wide.where("y = 1"), CANDS, ((1, 3),))
    assert one.count() == 0
    m, scored = fusion.transfer(wide.where("y = 1"), wide, CANDS)
    assert np.isnan(m.weights).all() and scored.where("score is not null").count() == 0
    assert fusion.cross_validate(wide.where(F.lit(False)), CANDS, ((1, 3),)).count() == 0


def test_choice(spark):
    rows = [("a", 6, "w", 26.37, 0.64), ("b", 5, "w", 26.64, 0.6), ("c", 3, "w", 26.84, 0.6), ("d", 1, "w", 29.38, 0.6)]
    cv = spark.createDataFrame(rows, "candidate string, n_systems int, weights string, cv_eer double, cv_eer_se double")
    assert fusion.one_se_choice(cv).first().candidate == "c"
    both = cv.withColumn("g", F.lit(1)).unionByName(cv.where("candidate in ('b', 'd')").withColumn("g", F.lit(2)))
    assert {r.g: r.candidate for r in fusion.one_se_choice(both, ["g"]).collect()} == {1: "c", 2: "b"}


def test_broadcasts_are_measured(spark, monkeypatch):
    df = spark.range(100)
    assert "Hint" in ordering.measured(df)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", 100)
    assert "Hint" not in ordering.measured(df)._jdf.queryExecution().logical().toString()
