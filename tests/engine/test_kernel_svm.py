"""The cascade against a plain solver of the whole dual problem."""

import numpy as np
import pytest
from scorelake.operators import classical, kernel_svm, metrics


def dual(x, y, cap, gamma):
    """The whole dual by a primal-dual interior point method, with every pair of rows in one matrix."""
    k = np.exp(-gamma * ((x[:, None] - x) ** 2).sum(-1))
    q, n = k * y[:, None] * y, len(y)
    a, low, high, e = cap / 2, np.ones(n), np.ones(n), 0.0
    for _ in range(80):
        s = cap - a
        mu = 0.1 * (low @ a + high @ s) / (2 * n)
        if mu < 1e-10:
            break
        system = np.block([[q + np.diag(low / a + high / s), y[:, None]], [y[None], np.zeros((1, 1))]])
        step = np.linalg.solve(system, np.concatenate([1 - q @ a - e * y + mu / a - mu / s, [-y @ a]]))
        da = step[:-1]
        dl, du = mu / a - low - low / a * da, mu / s - high + high / s * da
        t = 1.0
        for v, d in ((a, da), (s, -da), (low, dl), (high, du)):
            if (d < 0).any():
                t = min(t, 0.99 * float((-v[d < 0] / d[d < 0]).min()))
        a, low, high, e = a + t * da, low + t * dl, high + t * du, e + t * step[-1]
    v, above, below = y - k @ (a * y), a > 1e-6 * cap, a < cap * (1 - 1e-6)
    if (above & below).any():
        return a, float(v[above & below].mean())
    up, low = np.where(y > 0, below, above), np.where(y > 0, above, below)
    return a, float((v[up].max() + v[low].min()) / 2)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(7)
    n = 260
    y = np.arange(n) % 3 == 0
    x = r.normal(0, 1, (n, 4)) * [1, 30, 1, 1] + np.where(y, 1.2, 0)[:, None] * [1, 30, 0, 0] + [0, 500, 0, 0]
    rows = [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "filename long, x array<double>, y int")
    return df.where("filename % 5 > 0").cache(), df.where("filename % 5 = 0").cache()


def plain(train, test, c, gamma):
    rows = train.orderBy("filename").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y * 2.0 - 1 for r in rows])
    mean, dev = x.mean(0), x.std(0)
    n1 = (y > 0).sum()
    cap = np.where(y > 0, c * len(y) / (2 * n1), c * len(y) / (2 * (len(y) - n1)))
    z = (x - mean) / dev
    a, b = dual(z, y, cap, gamma)
    out = test.orderBy("filename").collect()
    t = (np.array([r.x for r in out]) - mean) / dev
    return {r.filename: v for r, v in zip(out, np.exp(-gamma * ((t[:, None] - z) ** 2).sum(-1)) @ (a * y) + b)}


GRID = [(None, c, g) for c in (0.1, 1.0, 10.0, 100.0) for g in (0.001, 0.01, 0.1, 0.5)]


@pytest.mark.parametrize("block", [2048, 64])
def test_every_point_is_the_whole_problems_solution(data, monkeypatch, block):
    """In one block, and in a cascade of four."""
    train, test = data
    monkeypatch.setattr(kernel_svm, "BLOCK", block)
    monkeypatch.setattr(kernel_svm, "SLACK", 1e-4)
    monkeypatch.setattr(kernel_svm, "GAP", 1e-5)
    grid = kernel_svm.fit(train, GRID, classical.stored)
    got = {}
    for r in kernel_svm.scores(grid, test).collect():
        got.setdefault(r.point, {})[r.filename] = r.score
    assert len(got) == 16
    for i, (_, c, g) in enumerate(GRID):
        want = plain(train, test, c, g)
        assert got[i].keys() == want.keys() and max(abs(got[i][f] - want[f]) for f in want) < 1e-3, (c, g)


def test_points_trained_together_equal_single_fits_and_sweeps_resume(data, tmp_path):
    train, test = data
    points = [(60, 1.0, 0.01), (120, 10.0, 0.1), (None, 1.0, 0.01)]
    def scores(ps):
        grid = kernel_svm.fit(train, ps, classical.stored)
        return {(ps[r.point], r.filename): r.score for r in kernel_svm.scores(grid, test).collect()}

    together = scores(points)
    for p in points:
        alone = scores([p])
        assert all(abs(together[k] - v) < 1e-9 for k, v in alone.items()) and len(alone) == test.count()
    path = str(tmp_path / "sweep")
    one = classical.svm_sweep(train, test, path, (60,), (1.0,), (0.1,))
    assert one.count() == 1
    two = classical.svm_sweep(train, test, path, (60, None), (1.0, 10.0), (0.1,), batch=2)
    assert sorted((r.n_train, r.c) for r in two.collect()) == [(60, 1.0), (60, 10.0), (208, 1.0), (208, 10.0)]
    best = min(two.collect(), key=lambda r: (r.eer, r.c))
    refit = classical.refit_best(two, train, test)
    eer = metrics.eer(refit.selectExpr("1 as g", "y", "score"), ["g"]).first().eer
    assert refit.count() == test.count() and (best.n_train < 208 or eer == pytest.approx(best.eer))


def test_kernel_columns_on_demand_and_one_class(data, spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(40, 3))
    whole = kernel_svm.Kernel(x, 0.3)
    monkeypatch.setattr(kernel_svm, "BLOCK", 10)
    monkeypatch.setattr(kernel_svm, "CACHE_BYTES", 8 * 40 * 5)
    some = kernel_svm.Kernel(x, 0.3)
    assert some.whole is None and all(np.allclose(some[i], whole[i]) for i in [*range(40), 3, 39]) and len(some.kept) == 5
    train, test = data
    alone = classical.rbf_svm_scores(train.where("y = 1 and filename < 40"), test)
    assert {r.score for r in alone.collect()} == {1.0}


def test_too_many_support_vectors_are_refused(data, monkeypatch):
    monkeypatch.setattr(kernel_svm, "SUPPORT", 5)
    with pytest.raises(Exception, match="support vectors in one task"):
        kernel_svm.fit(data[0], [(None, 1.0, 0.1)], classical.stored)


def test_the_best_points_fit_is_not_made_twice(data, tmp_path, monkeypatch):
    train, test = data
    path, vectors = str(tmp_path / "sweep"), str(tmp_path / "vectors")
    sweep = classical.svm_sweep(train, test, path, (60, None), (1.0,), (0.01, 0.1), vectors=vectors)
    best = sweep.orderBy("eer", "c", "gamma").first()
    want = {r.filename: r.score for r in classical.rbf_svm_scores(train, test, best.c, best.gamma).collect()}
    monkeypatch.setattr(kernel_svm, "fit", lambda *a: pytest.fail("fitted again"))
    got = {r.filename: r.score for r in classical.refit_best(sweep, train, test, vectors).collect()}
    assert got.keys() == want.keys() and max(abs(got[f] - want[f]) for f in want) < 1e-6


def test_a_start_from_a_solution_makes_no_column_a_row(monkeypatch):
    """The slope at the start took a kernel column of each row that had weight, one at a time (q_svm_grid, q_rbf_svm)."""
    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, 3)), np.where(np.arange(60) % 2, 1.0, -1.0)
    cap = np.full(60, 1.0)
    want, b = kernel_svm.solve(kernel_svm.Kernel(x, 0.3), y, cap)
    monkeypatch.setattr(kernel_svm, "BLOCK", 10)
    monkeypatch.setattr(kernel_svm, "CACHE_BYTES", 32 * 60 * 7)  # blocks of seven rows
    kernel = kernel_svm.Kernel(x, 0.3)
    slope = -1 + y * (kernel.against(x) @ (want * y))
    assert np.allclose(kernel_svm.slopes(kernel, y, want), slope, atol=1e-12)
    got, again = kernel_svm.solve(kernel, y, cap, want, 2e-4)
    assert np.allclose(got, want) and again == pytest.approx(b) and (want > 0).sum() > 40 and not kernel.kept


def test_a_leap_settles_what_pairs_take_long_for(monkeypatch):
    """Labels without a pattern and a high C: pairs alone take tens of times as many steps (q_svm_grid, q_svm_sweep)."""
    r = np.random.default_rng(5)
    x, y = r.normal(size=(300, 8)), np.where(r.random(300) < 0.5, 1.0, -1.0)
    cap, steps = np.full(300, 100.0), []
    monkeypatch.setattr(kernel_svm.Kernel, "__getitem__", lambda self, i: steps.append(i) or self.whole[i])
    want, b = dual(x, y, cap, 0.06)
    for double, direct in ((2048, 2000), (10, 2000), (10, 20)):  # in double and single precision; by Newton's step and by iterations
        monkeypatch.setattr(kernel_svm, "DOUBLE", double)
        monkeypatch.setattr(kernel_svm, "DIRECT", direct)
        steps.clear()
        got, again = kernel_svm.solve(kernel_svm.Kernel(x, 0.06), y, cap, None, 1e-6)
        assert np.abs(got - want).max() < 1e-3 and again == pytest.approx(b, abs=1e-4) and abs(got @ y) < 1e-9
        assert len(steps) < 6000, (double, direct, len(steps))
