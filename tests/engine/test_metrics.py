"""Hand-computed cases of the detection metrics, and the properties that must hold for any data."""

import math
import random

import pytest
from scorelake.operators import metrics as m
from pyspark.sql import functions as F

COEF = (0.06713, 0.87337, 0.45276)


def trials(spark, bona, spoof, g="x"):
    return spark.createDataFrame([(g, 1, float(s)) for s in bona] + [(g, 0, float(s)) for s in spoof], "g string, y int, score double")


CASES = {
    "plain": ((0.9, 0.8, 0.6, 0.4), (0.7, 0.5, 0.3, 0.2, 0.1), 0.225, 0.6, 0.85, 0.477474081, 0.4),
    "ties": ((3, 3, 2, 1), (3, 2, 2, 1, 1, 1), 0.375, 2, 0.6875, 0.984539999, 2),
    "all tied": ((1, 1, 1), (1, 1), 0.5, 1, 0.5, 1.0, 1),
}


def test_hand_computed_cases(spark):
    t = None
    for name, (bona, spoof, *_) in CASES.items():
        part = trials(spark, bona, spoof, name)
        t = part if t is None else t.unionByName(part)
    t = t.unionByName(trials(spark, (1, 2), (), "one class"))
    coef = spark.createDataFrame([COEF], "c0 double, c1 double, c2 double")
    got = {r.g: r for r in m.system_table(t, ["g"], coef).collect()}
    assert set(got) == set(CASES)
    for name, (_, _, eer, thr, auc, tdcf, at) in CASES.items():
        r = got[name]
        assert (r.eer, r.threshold, r.roc_auc) == pytest.approx((eer, thr, auc))
        assert (r.min_tdcf, r.tdcf_threshold) == pytest.approx((tdcf, at), abs=1e-8)
    r = got["plain"]
    assert (r.tp, r.fn, r.fp, r.tn) == (3, 1, 1, 4)


def test_invariances(spark):
    r = random.Random(1)
    t = trials(spark, [r.gauss(1, 1) for _ in range(150)], [r.gauss(0, 1) for _ in range(200)])
    one = m.system_table(t, ["g"]).first()
    up = m.system_table(t.withColumn("score", F.exp("score")), ["g"]).first()
    assert (one.eer, one.roc_auc) == pytest.approx((up.eer, up.roc_auc))
    flip = m.auc_of(m.error_curve(t.withColumn("y", 1 - F.col("y")), ["g"]), ["g"]).first()
    assert flip.roc_auc == pytest.approx(1 - one.roc_auc)
    wide = m.eer(t.repartition(7), ["g"]).first()
    assert (wide.eer, wide.threshold) == (one.eer, one.threshold)
    dirty = t.unionByName(spark.createDataFrame([("x", 1, None), ("x", 0, math.nan)], t.schema))
    assert m.eer(dirty, ["g"]).first().eer == one.eer
    assert m.eer(t.where(F.lit(False)), ["g"]).count() == 0


def test_probit(spark):
    from statistics import NormalDist

    ps = [0.001, 0.02, 0.1, 0.5, 0.77, 0.98, 0.9999]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(m.probit(F.col("p")).alias("z")).collect()
    assert [r.z for r in rows[:7]] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)
    assert rows[7].z is None and rows[8].z is None


def test_counts_whose_products_pass_64_bits(spark):
    big = 5 * 10**9
    hist = spark.createDataFrame([("x", 2.0, 3 * big, big), ("x", 1.0, big, 3 * big)], "g string, score double, b long, s long")
    curve = m.curve_of(hist, ["g"])
    assert m.auc_of(curve, ["g"]).first().roc_auc == pytest.approx(0.75)
    assert m.eer_of(curve, ["g"]).first().eer == 0.25


def test_orders_do_not_depend_on_slices(spark, monkeypatch):
    from scorelake.operators import ordering as o

    r = random.Random(6)
    rows = [(r.choice("ab") if i % 9 else None, r.choice([None, *range(40)]), i, r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, i long, v long")
    place = lambda x: (x[1] is not None, x[1] or 0, x[2])
    for slices in (64, 3):
        monkeypatch.setattr(o.sliced, "__defaults__", (slices,))
        for up in (True, False):
            got = {x.i: (x.s, x.s_total, x.n) for x in o.running_sums(df, ["g"], "k", {"s": F.col("v"), "n": F.lit(1)}, up, ["i"]).collect()}
            for g in ("a", "b", None):
                own = sorted((x for x in rows if x[0] == g), key=place if up else lambda x: (x[1] is None, -(x[1] or 0), x[2]))
                total, whole = 0, sum(x[3] for x in own)
                for n, x in enumerate(own, 1):
                    total += x[3]
                    assert got[x[2]] == (total, whole, n)
        one = {x.i: x.position for x in o.numbered(df.where("k is not null"), [], "k", ["i"]).collect()}
        assert [i for i, _ in sorted(one.items(), key=lambda x: x[1])] == [x[2] for x in sorted((x for x in rows if x[1] is not None), key=lambda x: (x[1], x[2]))]
        q = {x.g: (x.lo, x.mid) for x in o.quantiles(df, ["g"], "k", {"lo": 0.1, "mid": 0.5}).collect()}
        import numpy as np

        for g in ("a", "b", None):
            own = [x[1] for x in rows if x[0] == g and x[1] is not None]
            assert q[g] == pytest.approx(tuple(np.quantile(own, [0.1, 0.5])))
