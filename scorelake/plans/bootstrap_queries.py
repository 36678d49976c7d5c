"""Queries over the bootstrap operator (R04-R10, N09), and SQL that draws the same weights with plain joins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import bootstrap as b
from ..operators import metrics as m
from ..operators import model
from .metric_queries import ASV, BASE, STRATA_OF, coefficients, curve_sql, eer_sql, strata, tdcf_sql, with_
from .sql import duckdb

#: Replicates of the queries; the operator takes any number, and bench.py times 2,000.
REPS, FEW = 200, 20
SYSTEMS = ("A", "B", "C")
PAIRS = (("A", "B"), ("A", "C"), ("B", "C"))
#: System C is a weighted sum of A and B: fused systems take no part in the ratio of widths.
FUSED = "C"


def evaluated(s, d):
    return model.trials(s, d).where("part = 'eval'")


def cost(s, d) -> list[float]:
    r = coefficients(s, d).select("c0", "c1", "c2").first()
    return [r.c0, r.c1, r.c2]


def replicates(s, d, unit="speaker", n=REPS):
    return b.replicate_metrics(evaluated(s, d), ["system"], n, unit, cost=cost(s, d))


def with_points(s, d, reps):
    """Intervals beside the values of unit weights."""
    curve = m.error_curve(evaluated(s, d), ["system"])
    points = m.eer_of(curve, ["system"]).select("system", F.round("eer", 9).alias("eer")).join(m.min_tdcf_of(curve, ["system"], coefficients(s, d)).select("system", F.round("min_tdcf", 9).alias("min_tdcf")), "system")
    return points.join(b.intervals(reps, ["system"]), "system")


def q_bootstrap_ci(s, d, unit):
    return with_points(s, d, replicates(s, d, unit))


def q_paired_diff(s, d):
    return b.paired(replicates(s, d), s.createDataFrame(list(PAIRS), "system string, control string"))


def ratio(a: str, b: str):
    """a / b as SQL has it: widths may be zero, where Spark's own division raises."""
    a, b = F.col(a), F.col(b)
    return F.when(b != 0, a / b).when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf")))


def q_ci_width_ratio(s, d):
    out = None
    for scheme, unit in (("clustered", "speaker"), ("trial", "trial")):
        w = b.intervals(replicates(s, d, unit), ["system"]).where(F.col("system") != FUSED).agg(F.avg("eer_ci_width").alias(f"{scheme}_eer"), F.avg("tdcf_ci_width").alias(f"{scheme}_tdcf"))
        out = w if out is None else out.crossJoin(w)  # one row each
    return out.select(F.round("clustered_eer", 7).alias("clustered_width"), F.round("trial_eer", 7).alias("trial_width"), F.round(ratio("clustered_eer", "trial_eer"), 4).alias("eer_ratio"), F.round(ratio("clustered_tdcf", "trial_tdcf"), 4).alias("tdcf_ratio"))


def q_ci_overlap(s, d):
    ci = b.intervals(replicates(s, d), ["system"])
    x, y = (ci.select(F.col("system").alias(k), F.col("eer_lo").alias(f"lo{k}"), F.col("eer_hi").alias(f"hi{k}")) for k in ("s1", "s2"))
    return x.join(y, F.col("s1") < F.col("s2")).select("s1", "s2", F.round(F.least("his1", "his2") - F.greatest("los1", "los2"), 8).alias("overlap"))  # a row a system


def q_stratum_paired_ci(s, d):
    """Every stratum and arm against arm A; speakers are drawn from all of the table, whatever their class."""
    t = strata(evaluated(s, d), 4)
    reps = b.replicate_metrics(t, ["stratum", "system"], REPS, stratified=False)
    pairs = s.createDataFrame([("B", "A"), ("C", "A")], "system string, control string")
    return b.paired(reps, pairs, ["stratum"]).select("stratum", "system", "control", F.col("eer_diff").alias("diff"), F.col("eer_lo").alias("lo"), F.col("eer_hi").alias("hi"), F.col("eer_excludes_zero").alias("excludes_zero"), "sign_consistency", "n_reps")


def draws(s, d, n=FEW):
    """The weights themselves, as a table: rep, y, speaker, w."""
    names, sizes = b.speakers(evaluated(s, d), True)
    return names.hint("merge").join(b.draw_table(s, n, sizes).withColumn("y", 1 - F.col("stratum")), ["y", "unit"]).select("rep", "y", "speaker", "w")


def q_bootstrap_naive_check(s, d):
    """Weighted replicates against rows repeated as often as drawn."""
    fast = replicates(s, d, n=FEW).select("system", "rep", F.col("eer").alias("fast"))
    repeated = evaluated(s, d).join(draws(s, d), ["y", "speaker"]).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    naive = m.eer(repeated, ["system", "rep"]).select("system", "rep", "eer")
    return fast.join(naive, ["system", "rep"]).agg((F.max(F.abs(F.col("fast") - F.col("eer"))) < 1e-12).alias("same"), F.count("*").alias("n"))


def clustered_sql(n: int, src: str = "ev", stratified: bool = True) -> str:
    by = "PARTITION BY y " if stratified else ""
    cols, salt, on = ("y, speaker", "(1 - s.y)", "s.y = h.y AND ") if stratified else ("speaker", "0", "")
    y = "s.y, " if stratified else ""
    return f"""
spk AS (SELECT {cols}, ROW_NUMBER() OVER ({by}ORDER BY speaker) - 1 AS k, COUNT(*) OVER ({by.strip()}) AS n FROM (SELECT DISTINCT {cols} FROM {src}) z),
hits AS (SELECT r.range AS rep, {y}CAST({b.mixed_sql('r.range', 's.k', salt)} AS BIGINT) % s.n AS k FROM range({n}) r CROSS JOIN spk s),
draws AS (SELECT h.rep, {'h.y, ' if stratified else ''}s.speaker, COUNT(*) AS w FROM hits h JOIN spk s ON {on}s.k = h.k GROUP BY ALL)"""


def weighted_sql(by: str, src: str = "ev", stratified: bool = True) -> str:
    keys = ", ".join(f"t.{c.strip()}" for c in by.split(","))
    y = "d.y = t.y AND " if stratified else ""
    return f"""
wt AS (SELECT d.rep, {keys}, t.score, t.y, CAST(d.w AS BIGINT) AS w FROM {src} t JOIN draws d ON {y}d.speaker = t.speaker), {running_sql(by)}"""


def running_sql(by: str) -> str:
    return f"""
wh AS (SELECT rep, {by}, score, SUM(CASE WHEN y = 1 THEN w ELSE 0 END) AS b, SUM(CASE WHEN y = 0 THEN w ELSE 0 END) AS s FROM wt GROUP BY ALL),
wc AS (SELECT rep, {by}, score, CAST(SUM(b) OVER (PARTITION BY rep, {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp, CAST(SUM(s) OVER (PARTITION BY rep, {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
  CAST(SUM(b) OVER (PARTITION BY rep, {by}) AS BIGINT) AS nb, CAST(SUM(s) OVER (PARTITION BY rep, {by}) AS BIGINT) AS ns FROM wh),
{eer_sql('wc', 'rep, ' + by, 'we')}"""


def poisson_sql(n: int) -> str:
    u = f"((CAST({b.mixed_sql('r.range', 't.filename', 77)} AS DOUBLE) + 0.5) / 4294967296)"
    w = " + ".join(f"CASE WHEN u >= CAST({float(p)!r} AS DOUBLE) THEN 1 ELSE 0 END" for p in b.POISSON[:14])
    return f"wt AS (SELECT rep, system, score, y, CAST({w} AS BIGINT) AS w FROM (SELECT r.range AS rep, t.system, t.score, t.y, {u} AS u FROM ev t CROSS JOIN range({n}) r) x), {running_sql('system')}"


EV = "ev AS (SELECT * FROM trials WHERE part = 'eval')"
POINTS = (curve_sql("ev", "system"), eer_sql("curve", "system"), tdcf_sql("curve", "system"))
SCHEME = {"clustered": clustered_sql(REPS) + "," + weighted_sql("system"), "trial": poisson_sql(REPS)}
BOTH = "rp AS (SELECT we.rep, we.system, we.eer, wd.min_tdcf FROM we JOIN wd ON wd.rep = we.rep AND wd.system = we.system)"


def ci_sql(scheme: str) -> tuple[str, ...]:
    q = lambda c, out: f"ROUND(quantile_cont({c}, 0.025), 9) AS {out}_lo, ROUND(quantile_cont({c}, 0.975), 9) AS {out}_hi, ROUND(quantile_cont({c}, 0.975) - quantile_cont({c}, 0.025), 9) AS {out}_ci_width"
    return (BASE, EV, ASV, SCHEME[scheme], tdcf_sql("wc", "rep, system", "wd"), BOTH, f"ci AS (SELECT system, {q('eer', 'eer')}, {q('min_tdcf', 'tdcf')} FROM rp GROUP BY system)")


def ci_query(scheme: str) -> str:
    return with_(*ci_sql(scheme), *POINTS) + " SELECT ci.*, ROUND(eer.eer, 9) AS eer, ROUND(tdcf.min_tdcf, 9) AS min_tdcf FROM ci JOIN eer ON eer.system = ci.system JOIN tdcf ON tdcf.system = ci.system"


def width_query() -> str:
    half = lambda scheme: f"(WITH {', '.join(p.strip() for p in ci_sql(scheme))} SELECT AVG(eer_ci_width) AS e, AVG(tdcf_ci_width) AS t FROM ci WHERE system <> '{FUSED}')"
    return f"SELECT ROUND(c.e, 7) AS clustered_width, ROUND(t.e, 7) AS trial_width, ROUND(c.e / t.e, 4) AS eer_ratio, ROUND(c.t / t.t, 4) AS tdcf_ratio FROM {half('clustered')} c CROSS JOIN {half('trial')} t"


def diff_sql(c: str, name: str) -> str:
    lo, hi = f"quantile_cont({c}, 0.025)", f"quantile_cont({c}, 0.975)"
    return f"ROUND(AVG({c}), 9) AS {name}_diff, ROUND({lo}, 9) AS {name}_lo, ROUND({hi}, 9) AS {name}_hi, {lo} > 0 OR {hi} < 0 AS {name}_excludes_zero"


SIGN = "ROUND(GREATEST(AVG(CAST(d < 0 AS INT)), AVG(CAST(d > 0 AS INT))), 9) AS sign_consistency, COUNT(*) AS n_reps"
PAIR_ROWS = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{y}')" for x, y in PAIRS) + ") v(system, control))"
NAIVE = "nt AS (SELECT d.rep, ev.system, ev.score, ev.y FROM ev JOIN draws d ON d.y = ev.y AND d.speaker = ev.speaker CROSS JOIN range(1, 65) x WHERE x.range <= d.w)"
STRATUM = STRATA_OF("eval")
Q = {
    "q_bootstrap_weights": (draws, with_(BASE, EV, clustered_sql(FEW)) + " SELECT CAST(rep AS INT) AS rep, y, speaker, w FROM draws"),
    "q_bootstrap_ci_clustered": (partial(q_bootstrap_ci, unit="speaker"), ci_query("clustered")),
    "q_bootstrap_ci_trial": (partial(q_bootstrap_ci, unit="trial"), ci_query("trial")),
    "q_ci_width_ratio": (q_ci_width_ratio, width_query()),
    "q_ci_overlap": (q_ci_overlap, with_(*ci_sql("clustered")) + " SELECT x.system AS s1, y.system AS s2, ROUND(LEAST(x.eer_hi, y.eer_hi) - GREATEST(x.eer_lo, y.eer_lo), 8) AS overlap FROM ci x JOIN ci y ON x.system < y.system"),
    "q_paired_diff": (
        q_paired_diff,
        with_(*ci_sql("clustered"), PAIR_ROWS, "df AS (SELECT p.system, p.control, x.eer - y.eer AS d, x.min_tdcf - y.min_tdcf AS t, x.eer AS ea, y.eer AS eb FROM pairs p JOIN rp x ON x.system = p.system JOIN rp y ON y.system = p.control AND y.rep = x.rep)")
        + f" SELECT system, control, {diff_sql('d', 'eer')}, {diff_sql('t', 'tdcf')}, ROUND(CORR(ea, eb), 6) AS corr_eer, {SIGN} FROM df GROUP BY system, control",
    ),
    "q_bootstrap_naive_check": (
        q_bootstrap_naive_check,
        with_(BASE, EV, clustered_sql(FEW), weighted_sql("system"), NAIVE, curve_sql("nt", "rep, system", "nc"), eer_sql("nc", "rep, system", "ne")) + " SELECT MAX(ABS(we.eer - ne.eer)) < 1e-12 AS same, COUNT(*) AS n FROM we JOIN ne ON we.rep = ne.rep AND we.system = ne.system",
    ),
    "q_stratum_paired_ci": (
        q_stratum_paired_ci,
        with_(BASE, STRATUM, clustered_sql(REPS, "st", False), weighted_sql("stratum, system", "st", False), "df AS (SELECT x.stratum, x.system, y.system AS control, x.eer - y.eer AS d FROM we x JOIN we y ON y.stratum = x.stratum AND y.rep = x.rep WHERE y.system = 'A' AND x.system <> 'A')")
        + " SELECT stratum, system, control, ROUND(AVG(d), 9) AS diff, ROUND(quantile_cont(d, 0.025), 9) AS lo, ROUND(quantile_cont(d, 0.975), 9) AS hi, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero, " + SIGN + " FROM df GROUP BY stratum, system, control",
    ),
}
QUERIES = {k: v[0] for k, v in Q.items()}
ORACLE_SQL = {k: duckdb(v[1]) for k, v in Q.items()}
