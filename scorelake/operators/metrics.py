"""Detection-metric aggregations (M01-M09, M13-M17, M20): every function takes trials with y (1 bonafide, 0 spoof) and score,
and the columns `by` that group them. Higher scores are more bonafide; a trial is accepted from the threshold on.

Curves come from the histogram of distinct scores, so tied scores are one threshold, sums run over distinct scores in slices
and counts stay integers until the last division; products of counts are decimals, which do not overflow. Groups of one class, null scores and NaN yield no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .ordering import measured, running_sums

#: Priors and costs of the tandem cost.
COST = {"p_spoof": 0.05, "p_tar": 0.9405, "p_non": 0.0095, "c_miss": 1.0, "c_fa": 10.0, "c_fa_spoof": 10.0}


def histogram(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, score, b, s: bonafide and spoof trials at each distinct score; map-side combined."""
    score = F.col("score").cast("double")
    rows = trials.select(*by, score.alias("score"), F.col("y").cast("long").alias("y")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.groupBy(*by, "score").agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("s"))


def curve_of(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """M01 from a histogram (by, score, b, s): by, score, b, s, tp, fp, nb, ns with the trials accepted at each score. Sums run
    within slices of a group's scores, so no task holds a whole group."""
    sums = running_sums(hist, by, "score", {"tp": F.col("b"), "fp": F.col("s")}, ascending=False)
    return sums.select(*by, "score", "b", "s", "tp", "fp", F.col("tp_total").alias("nb"), F.col("fp_total").alias("ns"))


def error_curve(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """The histogram, which is what is small, is made once and stored; everything else reads it."""
    return curve_of(stored(histogram(trials, by), "histogram"), by)


def exact(c: Column | str) -> Column:
    """A count whose products do not overflow."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def fnr() -> Column:
    return (F.col("nb") - F.col("tp")).cast("double") / F.col("nb")


def fpr() -> Column:
    return F.col("fp").cast("double") / F.col("ns")


def two_class(curve: DataFrame) -> DataFrame:
    return curve.where("nb > 0 and ns > 0")


def at_least(cost: Column, values: dict[str, Column]) -> Column:
    """Aggregate: score, tp, fp, nb, ns and values at the least cost, the higher score on ties."""
    packed = F.struct(F.col("score"), "tp", "fp", "nb", "ns", *[v.alias(k) for k, v in values.items()])
    return F.min_by(packed, F.struct(cost.alias("c"), (-F.col("score")).alias("s")))


def equal_errors() -> Column:
    """Aggregate: where FNR and FPR are closest, compared as integers."""
    gap = F.abs(exact(F.col("nb") - F.col("tp")) * exact("ns") - exact("fp") * exact("nb"))
    return at_least(gap, {"eer": (fnr() + fpr()) / 2})


def eer_of(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """By, threshold, tp, fp, nb, ns, eer: the mean of FNR and FPR where they are closest."""
    rows = two_class(curve).groupBy(*by).agg(equal_errors().alias("x"))
    return rows.select(*by, F.col("x.score").alias("threshold"), "x.tp", "x.fp", "x.nb", "x.ns", "x.eer")


def eer(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    return eer_of(error_curve(trials, by), by)


def area() -> Column:
    """Aggregate: the area under the curve with half credit for ties, from integer sums."""
    twice = F.sum(exact("b") * exact(2 * (F.col("ns") - F.col("fp")) + F.col("s")))
    pairs = exact(F.first("nb")) * exact(F.first("ns"))
    return twice.cast("double") / (2 * pairs.cast("double"))


def auc_of(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """By, roc_auc."""
    return two_class(curve).groupBy(*by).agg(area().alias("roc_auc"))


def at_threshold(points: DataFrame) -> DataFrame:
    """Confusion counts and their ratios, for rows with tp, fp, nb, ns at the threshold; 0 where undefined."""
    tp, fp, nb, ns = (F.col(c) for c in ("tp", "fp", "nb", "ns"))
    d = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return points.select(
        *[c for c in points.columns if c not in ("tp", "fp", "nb", "ns")],
        (nb + ns).alias("n_trials"), tp.alias("tp"), (nb - tp).alias("fn"), (ns - fp).alias("tn"), fp.alias("fp"),
        d(tp + ns - fp, nb + ns).alias("accuracy"), d(tp, tp + fp).alias("precision_bonafide"), d(tp, nb).alias("recall_bonafide"), d(2 * tp, nb + tp + fp).alias("f1_bonafide"),
    )


def asv_rates(asv: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The verifier's operating point from class (target, nontarget, spoof) and score: its EER threshold on targets
    against nontargets, and the three error rates there."""
    two = asv.where(F.col("class").isin("target", "nontarget")).select(*by, "score", (F.col("class") == "target").cast("int").alias("y"))
    one = two.withColumn("_g", F.lit(1)) if not by else two
    point = eer(one, [*by] or ["_g"]).select(*by, F.col("threshold").alias("asv_threshold"), F.col("eer").alias("asv_eer"))
    joined = asv.join(F.broadcast(point), list(by)) if by else asv.crossJoin(F.broadcast(point))  # one row, or one a group
    rate = lambda cls, ok: F.avg(F.when(F.col("class") == cls, ok.cast("double")))
    accept = F.col("score") >= F.col("asv_threshold")
    return joined.groupBy(*by, "asv_threshold", "asv_eer").agg(rate("target", ~accept).alias("p_miss"), rate("nontarget", accept).alias("p_fa"), rate("spoof", accept).alias("p_fa_spoof"))


def tdcf_coefficients(rates: DataFrame) -> DataFrame:
    """c0, c1, c2 and the floor c0 / (c0 + min(c1, c2)) of the verifier alone."""
    k = {n: F.lit(v) for n, v in COST.items()}
    c0 = k["p_tar"] * k["c_miss"] * F.col("p_miss") + k["p_non"] * k["c_fa"] * F.col("p_fa")
    c1 = k["p_tar"] * k["c_miss"] - c0
    c2 = k["c_fa_spoof"] * k["p_spoof"] * F.col("p_fa_spoof")
    out = rates.withColumn("c0", c0).withColumn("c1", c1).withColumn("c2", c2)
    return out.withColumn("asv_floor", F.col("c0") / (F.col("c0") + F.least("c1", "c2")))


def tandem_cost() -> Column:
    return (F.col("c0") + F.col("c1") * fnr() + F.col("c2") * fpr()) / (F.col("c0") + F.least("c1", "c2"))


def with_costs(curve: DataFrame, coefficients: DataFrame) -> DataFrame:
    return curve.crossJoin(F.broadcast(coefficients.select("c0", "c1", "c2")))  # one row


def min_tdcf_of(curve: DataFrame, by: Sequence[str], coefficients: DataFrame) -> DataFrame:
    """By, min_tdcf, tdcf_threshold; coefficients has one row."""
    rows = with_costs(two_class(curve), coefficients).groupBy(*by).agg(at_least(tandem_cost(), {"min_tdcf": tandem_cost()}).alias("x"))
    return rows.select(*by, "x.min_tdcf", F.col("x.score").alias("tdcf_threshold"))


def system_table(trials: DataFrame, by: Sequence[str], coefficients: DataFrame | None = None) -> DataFrame:
    """Everything about each group, in one aggregation of one curve."""
    curve, aggs = two_class(error_curve(trials, by)), [equal_errors().alias("x"), area().alias("roc_auc")]
    if coefficients is not None:
        curve = with_costs(curve, coefficients)
        aggs.append(at_least(tandem_cost(), {"min_tdcf": tandem_cost()}).alias("t"))
    rows = curve.groupBy(*by).agg(*aggs)
    cost = [] if coefficients is None else [F.col("t.min_tdcf").alias("min_tdcf"), F.col("t.score").alias("tdcf_threshold")]
    points = rows.select(*by, F.col("x.score").alias("threshold"), "x.tp", "x.fp", "x.nb", "x.ns", "x.eer", "roc_auc", *cost)
    return at_threshold(points)


def pooled_bonafide_eer(trials: DataFrame, by: Sequence[str], level: str) -> DataFrame:
    """All bonafide trials of a group against each level's spoof trials; only the bonafide histogram is repeated."""
    spoof = trials.where("y = 0").groupBy(*by, level, F.col("score").cast("double").alias("score")).agg(F.lit(0).cast("long").alias("b"), F.count("*").alias("s"))
    bona = trials.where("y = 1").groupBy(*by, F.col("score").cast("double").alias("score")).agg(F.count("*").alias("b"), F.lit(0).cast("long").alias("s"))
    levels = spoof.select(*by, level).distinct()
    hist = bona.join(levels, list(by)).select(*by, level, "score", "b", "s").unionByName(spoof).groupBy(*by, level, "score").agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
    return eer_of(curve_of(stored(hist, "histogram"), [*by, level]), [*by, level])


def far_at(trials: DataFrame, thresholds: DataFrame, by: Sequence[str], level: str) -> DataFrame:
    """The share of each level's spoof trials accepted at its group's threshold."""
    rows = trials.where("y = 0").join(measured(stored(thresholds.select(*by, "threshold"), "thresholds")), list(by))
    return rows.groupBy(*by, level).agg(F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("far"), F.count("*").alias("n_spoof"))


#: Fixed values of Acklam's rational approximation of the normal quantile: middle and tails, numerator and denominator.
ACKLAM = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572),
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416),
)


def probit(p: Column) -> Column:
    """The normal quantile, by Acklam's rational approximation (relative error under 1.15e-9)."""
    a, b, c, d = ACKLAM

    def poly(xs, x):
        out = F.lit(xs[0])
        for k in xs[1:]:
            out = out * x + F.lit(k)
        return out

    tail = lambda q: poly(c, q) / (poly(d, q) * q + 1)
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    low = tail(F.sqrt(-2 * F.ln(p)))
    high = -tail(F.sqrt(-2 * F.ln(1 - p)))
    return F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(p < 0.02425, low).when(p > 0.97575, high).otherwise(poly(a, r) * q / (poly(b, r) * r + 1))
