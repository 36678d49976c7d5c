"""Queries over the detection metrics (M01-M28) with the operators of scorelake.operators.metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import model
from .sql import duckdb

BASE = """
base AS (SELECT event_id AS filename, user_id AS speaker, event_type, CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS INT) AS y,
  CASE WHEN day(ts) <= 20 THEN 'eval' WHEN day(ts) <= 25 THEN 'progress' ELSE 'hidden' END AS part, {{K}} AS n_frames, CAST(hour(ts) AS INT) AS h, value FROM [events]),
trials AS (SELECT base.*, 'A' AS system, value AS score FROM base UNION ALL SELECT base.*, 'B' AS system, CAST(n_frames AS DOUBLE) AS score FROM base
  UNION ALL SELECT base.*, 'C' AS system, value - n_frames / CAST(2 AS DOUBLE) AS score FROM base)"""


def curve_sql(src: str, by: str, name: str = "curve") -> str:
    return f"""
{name}_hist AS (SELECT {by}, score, SUM(y) AS b, SUM(1 - y) AS s FROM {src} WHERE score IS NOT NULL GROUP BY {by}, score),
{name} AS (SELECT {by}, score, CAST(SUM(b) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
  CAST(SUM(s) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
  CAST(SUM(b) OVER (PARTITION BY {by}) AS BIGINT) AS nb, CAST(SUM(s) OVER (PARTITION BY {by}) AS BIGINT) AS ns FROM {name}_hist)"""


FNR, FPR = "(CAST(nb - tp AS DOUBLE) / nb)", "(CAST(fp AS DOUBLE) / ns)"


def eer_sql(curve: str, by: str, name: str = "eer") -> str:
    return f"""
{name} AS (SELECT {by}, score AS threshold, tp, fp, nb, ns, ({FNR} + {FPR}) / 2 AS eer FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY ABS((nb - tp) * ns - fp * nb), score DESC) AS rn
  FROM {curve} WHERE nb > 0 AND ns > 0) x WHERE rn = 1)"""


def auc_sql(curve: str, by: str, name: str = "auc") -> str:
    return f"""
{name} AS (SELECT {by}, CAST(SUM((tp - ltp) * (2 * (ns - fp) + fp - lfp)) AS DOUBLE) / CAST(2 * MIN(nb) * MIN(ns) AS DOUBLE) AS roc_auc FROM (
  SELECT *, COALESCE(LAG(tp) OVER (PARTITION BY {by} ORDER BY score DESC), 0) AS ltp, COALESCE(LAG(fp) OVER (PARTITION BY {by} ORDER BY score DESC), 0) AS lfp FROM {curve} WHERE nb > 0 AND ns > 0) x GROUP BY {by})"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE CAST(0 AS DOUBLE) END"


CONFUSION = f"nb + ns AS n_trials, tp, nb - tp AS fn, ns - fp AS tn, fp, {ratio('tp + ns - fp', 'nb + ns')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision_bonafide, {ratio('tp', 'nb')} AS recall_bonafide, {ratio('2 * tp', 'nb + tp + fp')} AS f1_bonafide"

ASV = f"""
asv AS (SELECT CASE event_type WHEN 'view' THEN 'target' WHEN 'click' THEN 'nontarget' WHEN 'error' THEN 'spoof' END AS class, value AS score FROM base WHERE part = 'eval' AND event_type IN ('view', 'click', 'error')),
asv_two AS (SELECT 1 AS g, score, CASE WHEN class = 'target' THEN 1 ELSE 0 END AS y FROM asv WHERE class IN ('target', 'nontarget')),
{curve_sql("asv_two", "g", "asv_curve")},
{eer_sql("asv_curve", "g", "asv_eer")},
rates AS (SELECT asv_eer.threshold AS asv_threshold, asv_eer.eer AS asv_eer, AVG(CASE WHEN class = 'target' THEN CAST(score < threshold AS INT) END) AS p_miss,
  AVG(CASE WHEN class = 'nontarget' THEN CAST(score >= threshold AS INT) END) AS p_fa, AVG(CASE WHEN class = 'spoof' THEN CAST(score >= threshold AS INT) END) AS p_fa_spoof FROM asv CROSS JOIN asv_eer GROUP BY 1, 2),
coef0 AS (SELECT *, CAST(0.9405 AS DOUBLE) * CAST(1 AS DOUBLE) * p_miss + CAST(0.0095 AS DOUBLE) * CAST(10 AS DOUBLE) * p_fa AS c0 FROM rates),
coef1 AS (SELECT *, CAST(0.9405 AS DOUBLE) * CAST(1 AS DOUBLE) - c0 AS c1, CAST(10 AS DOUBLE) * CAST(0.05 AS DOUBLE) * p_fa_spoof AS c2 FROM coef0),
coef AS (SELECT *, c0 / (c0 + LEAST(c1, c2)) AS asv_floor FROM coef1)"""


def tdcf_sql(curve: str, by: str, name: str = "tdcf") -> str:
    cost = f"(c0 + c1 * {FNR} + c2 * {FPR}) / (c0 + LEAST(c1, c2))"
    return f"""
{name} AS (SELECT {by}, cost AS min_tdcf, score AS tdcf_threshold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY cost, score DESC) AS rn FROM (
  SELECT {curve}.*, {cost} AS cost FROM {curve} CROSS JOIN coef WHERE nb > 0 AND ns > 0) y) x WHERE rn = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts)


def T(s: SparkSession, d: str) -> DataFrame:
    return model.trials(s, d)


def coefficients(s, d):
    return m.tdcf_coefficients(m.asv_rates(model.asv_trials(s, d)))


def q_system_table(s, d):
    return m.system_table(T(s, d).where("part = 'eval'"), ["system"], coefficients(s, d))


def q_within_group_eer(s, d):
    t = T(s, d).where("part = 'eval'").withColumn("hour_block", (F.col("h") / 6).cast("int").cast("string")).withColumn("user_class", F.expr("case when y = 1 then nullif(cast(speaker % 5 as string), '0') else cast(speaker % 5 as string) end"))
    long = t.unpivot(["system", "y", "score"], ["hour_block", "user_class"], "factor", "level").where("level is not null")
    e = m.eer(long, ["system", "factor", "level"])
    return e.select("system", "factor", "level", "eer", "threshold", F.col("nb").alias("n_bonafide"), F.col("ns").alias("n_spoof"))


def q_pooled_bonafide_eer(s, d):
    t = T(s, d).where("part = 'eval'").withColumn("level", F.when(F.col("y") == 0, F.concat(F.lit("d"), F.col("speaker") % 4)))
    return m.pooled_bonafide_eer(t, ["system"], "level").select("system", "level", "eer", "threshold", F.col("nb").alias("n_bonafide"), F.col("ns").alias("n_spoof"))


def q_far_at_global_threshold(s, d):
    t = T(s, d).where("part = 'eval'").withColumn("level", F.concat(F.lit("d"), F.col("speaker") % 4))
    return m.far_at(t, m.eer(t, ["system"]), ["system"], "level")


def q_short_clip_control(s, d):
    t = T(s, d).where("part = 'eval' and system <> 'B'")
    caps = s.createDataFrame([("all", 10**6), ("le25", 25), ("le50", 50), ("le75", 75)], "cap string, most int")
    rows = t.join(F.broadcast(caps), F.col("n_frames") <= F.col("most"))
    e = m.eer(rows, ["system", "cap"]).where("nb + ns > 100")
    wide = e.groupBy("system").pivot("cap", ["all", "le25", "le50", "le75"]).agg(F.first("eer").alias("eer"), F.first(F.col("nb") + F.col("ns")).alias("n"))
    return wide


def q_cue_control(s, d):
    w = model.wide_trials(s, d).withColumn("tiling", F.ceil(F.lit(400) / F.greatest(F.col("n_frames"), F.lit(1))).cast("double")).withColumn("frames", F.col("n_frames").cast("double")).withColumn("seconds", F.col("n_frames") * 0.016)
    cues = w.unpivot(["y", "part"], ["tiling", "frames", "seconds"], "cue", "score")
    both = cues.unionByName(cues.withColumn("part", F.lit("all")))
    means = both.groupBy("part", "cue").agg(F.round(F.avg(F.when(F.col("y") == 1, F.col("score"))), 9).alias("mean_bonafide"), F.round(F.avg(F.when(F.col("y") == 0, F.col("score"))), 9).alias("mean_spoof"))
    return m.eer(both, ["part", "cue"]).select("part", "cue", F.col("eer").alias("eer_as_score")).join(means, ["part", "cue"])


def q_prediction_verdict(s, d):
    pairs = s.createDataFrame([("P1", "A", "B", "lower"), ("P2", "C", "A", "lower"), ("P3", "B", "missing", "lower")], "prediction string, system string, control string, claim string")
    e = m.eer(T(s, d).where("part = 'eval'"), ["system"]).select("system", "eer")
    a, b = e.select("system", F.col("eer").alias("eer_system")), e.select(F.col("system").alias("control"), F.col("eer").alias("eer_control"))
    out = pairs.join(a, "system").join(b, "control").withColumn("delta_pp", 100 * (F.col("eer_system") - F.col("eer_control")))
    return out.select("prediction", "system", "control", "claim", "eer_system", "eer_control", "delta_pp", (F.col("delta_pp") < 0).alias("supported"))


def q_matched_subset_decomposition(s, d):
    sub = F.expr("case when part = 'eval' and speaker % 4 = 0 then 'eval_d4' when part = 'hidden' and n_frames >= 50 then 'hidden_notrim' when part = 'hidden' then 'hidden_trim' end")
    e = m.eer(T(s, d).withColumn("subset", sub).where("subset is not null"), ["system", "subset"])
    return e.groupBy("system").pivot("subset", ["eval_d4", "hidden_notrim", "hidden_trim"]).agg(F.first("eer"))


def strata(t: DataFrame, bins: int) -> DataFrame:
    """Right-closed quantile bins of n_frames over the trials, outer edges widened by 1."""
    edges = t.agg(F.percentile("n_frames", [i / bins for i in range(bins + 1)]).alias("e"))
    t = t.crossJoin(F.broadcast(edges))  # one row
    edge = F.transform("e", lambda x, i: F.when(i == 0, x - 1).when(i == bins, x + 1).otherwise(x))
    stratum = F.size(F.filter(edge, lambda x: x < F.col("n_frames"))) - 1
    return t.withColumn("stratum", stratum).drop("e")


def q_quantile_strata_eer(s, d):
    t = strata(T(s, d).where("part = 'progress'"), 4)
    e = m.eer(t, ["stratum", "system"])
    info = t.where("system = 'A'").groupBy("stratum").agg(F.median("n_frames").alias("median_frames"), F.count("*").alias("n_trials"), F.sum("y").alias("n_bonafide"))
    return e.select("stratum", "system", "eer").join(info, "stratum")


def q_strata_verdict(s, d):
    from pyspark.sql import Window

    e = m.eer(strata(T(s, d).where("part = 'progress'"), 4), ["stratum", "system"])
    win = e.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("eer", "system"))).where("r = 1").select("stratum", F.col("system").alias("winner"))
    w = Window.partitionBy(F.lit(0)).orderBy("stratum")  # one row per stratum
    steps = win.withColumn("rises", F.col("winner") >= F.coalesce(F.lag("winner").over(w), F.col("winner")))
    return steps.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("stratum", "winner"))), lambda x: x["winner"])).alias("winners"), F.when(F.countDistinct("winner") > 1, "MOVES").otherwise("FIXED").alias("verdict"), F.bool_and("rises").alias("monotone"))


def poly_sql(xs, x):
    out = f"CAST({xs[0]!r} AS DOUBLE)"
    for k in xs[1:]:
        out = f"({out}) * ({x}) + CAST({k!r} AS DOUBLE)"
    return out


def probit_sql(p: str) -> str:
    a, b, c, d = m.ACKLAM
    r = f"(({p}) - 0.5) * (({p}) - 0.5)"
    tail = lambda q: f"({poly_sql(c, q)}) / (({poly_sql(d, q)}) * ({q}) + 1)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 0.97575 THEN -({tail(f'sqrt(-2 * ln(1 - {p}))')}) ELSE ({poly_sql(a, r)}) * ({p} - 0.5) / (({poly_sql(b, r)}) * ({r}) + 1) END"


EV = "ev AS (SELECT * FROM trials WHERE part = 'eval')"
QUERIES = {
    "q_system_eer": (lambda s, d: m.at_threshold(m.eer(T(s, d).where("part = 'eval'"), ["system"])).select("system", "n_trials", "eer", "threshold"),
        with_(BASE, EV, curve_sql("ev", "system"), eer_sql("curve", "system")) + " SELECT system, nb + ns AS n_trials, eer, threshold FROM eer"),
    "q_system_table": (q_system_table, with_(BASE, EV, ASV, curve_sql("ev", "system"), eer_sql("curve", "system"), auc_sql("curve", "system"), tdcf_sql("curve", "system")) + f" SELECT system, threshold, eer, {CONFUSION}, roc_auc, min_tdcf, tdcf_threshold FROM eer JOIN auc USING (system) JOIN tdcf USING (system)"),
    "q_roc_points": (lambda s, d: m.error_curve(T(s, d).where("part = 'eval'"), ["system"]).select("system", "score", m.fnr().alias("fnr"), m.fpr().alias("fpr")),
        with_(BASE, EV, curve_sql("ev", "system")) + f" SELECT system, score, {FNR} AS fnr, {FPR} AS fpr FROM curve"),
    "q_auc": (lambda s, d: m.auc_of(m.error_curve(T(s, d), ["part", "system"]), ["part", "system"]), with_(BASE, curve_sql("trials", "part, system"), auc_sql("curve", "part, system")) + " SELECT part, system, roc_auc FROM auc"),
    "q_threshold_metrics": (lambda s, d: m.at_threshold(m.eer(T(s, d), ["part", "system"])), with_(BASE, curve_sql("trials", "part, system"), eer_sql("curve", "part, system")) + f" SELECT part, system, threshold, eer, {CONFUSION} FROM eer"),
    "q_asv_operating_point": (lambda s, d: m.asv_rates(model.asv_trials(s, d)), with_(BASE, ASV) + " SELECT * FROM rates"),
    "q_tdcf_coefficients": (lambda s, d: coefficients(s, d).select("c0", "c1", "c2"), with_(BASE, ASV) + " SELECT c0, c1, c2 FROM coef"),
    "q_asv_floor": (lambda s, d: coefficients(s, d).select("asv_floor"), with_(BASE, ASV) + " SELECT asv_floor FROM coef"),
    "q_min_tdcf": (lambda s, d: m.min_tdcf_of(m.error_curve(T(s, d), ["part", "system"]), ["part", "system"], coefficients(s, d)), with_(BASE, ASV, curve_sql("trials", "part, system"), tdcf_sql("curve", "part, system")) + " SELECT * FROM tdcf"),
    "q_other_partitions": (lambda s, d: m.at_threshold(m.eer(T(s, d).where("part <> 'eval'"), ["part", "system"])).select("part", "system", "eer", F.col("n_trials").alias("n")),
        with_(BASE, "o AS (SELECT * FROM trials WHERE part <> 'eval')", curve_sql("o", "part, system"), eer_sql("curve", "part, system")) + " SELECT part, system, eer, nb + ns AS n FROM eer"),
    "q_within_group_eer": (q_within_group_eer, with_(BASE, "f AS (SELECT system, y, score, 'hour_block' AS factor, CAST(CAST(FLOOR(h / 6) AS INT) AS VARCHAR) AS level FROM trials WHERE part = 'eval' UNION ALL SELECT system, y, score, 'user_class', CASE WHEN y = 1 THEN NULLIF(CAST(speaker % 5 AS VARCHAR), '0') ELSE CAST(speaker % 5 AS VARCHAR) END FROM trials WHERE part = 'eval')", "g AS (SELECT * FROM f WHERE level IS NOT NULL)", curve_sql("g", "system, factor, level"), eer_sql("curve", "system, factor, level")) + " SELECT system, factor, level, eer, threshold, nb AS n_bonafide, ns AS n_spoof FROM eer"),
    "q_pooled_bonafide_eer": (q_pooled_bonafide_eer, with_(BASE, EV, "lv AS (SELECT DISTINCT system, 'd' || CAST(speaker % 4 AS VARCHAR) AS level FROM ev WHERE y = 0)", "p AS (SELECT ev.system, lv.level, ev.y, ev.score FROM ev JOIN lv ON ev.system = lv.system WHERE ev.y = 1 OR lv.level = 'd' || CAST(ev.speaker % 4 AS VARCHAR))", curve_sql("p", "system, level"), eer_sql("curve", "system, level")) + " SELECT system, level, eer, threshold, nb AS n_bonafide, ns AS n_spoof FROM eer"),
    "q_far_at_global_threshold": (q_far_at_global_threshold, with_(BASE, EV, curve_sql("ev", "system"), eer_sql("curve", "system")) + " SELECT ev.system, 'd' || CAST(speaker % 4 AS VARCHAR) AS level, AVG(CAST(score >= threshold AS INT)) AS far, COUNT(*) AS n_spoof FROM ev JOIN eer ON ev.system = eer.system WHERE y = 0 GROUP BY 1, 2"),
    "q_short_clip_control": (q_short_clip_control, with_(BASE, "caps AS (SELECT * FROM (VALUES ('all', 1000000), ('le25', 25), ('le50', 50), ('le75', 75)) v(cap, most))", "c AS (SELECT system, y, score, cap FROM trials JOIN caps ON n_frames <= most WHERE part = 'eval' AND system <> 'B')", curve_sql("c", "system, cap"), eer_sql("curve", "system, cap"), "e AS (SELECT * FROM eer WHERE nb + ns > 100)") + " SELECT system, " + ", ".join(f"MAX(CASE WHEN cap = '{c}' THEN eer END) AS {c}_eer, MAX(CASE WHEN cap = '{c}' THEN nb + ns END) AS {c}_n" for c in ("all", "le25", "le50", "le75")) + " FROM e GROUP BY system"),
    "q_cue_control": (q_cue_control, with_(BASE, "w AS (SELECT y, part, CAST(CEIL(CAST(400 AS DOUBLE) / GREATEST(n_frames, 1)) AS DOUBLE) AS tiling, CAST(n_frames AS DOUBLE) AS frames, n_frames * CAST(0.016 AS DOUBLE) AS seconds FROM base)", "l AS (SELECT y, part, 'tiling' AS cue, tiling AS score FROM w UNION ALL SELECT y, part, 'frames', frames FROM w UNION ALL SELECT y, part, 'seconds', seconds FROM w)", "cues AS (SELECT * FROM l UNION ALL SELECT y, 'all', cue, score FROM l)", curve_sql("cues", "part, cue"), eer_sql("curve", "part, cue")) + " SELECT part, cue, eer AS eer_as_score, mean_bonafide, mean_spoof FROM eer JOIN (SELECT part, cue, ROUND(AVG(CASE WHEN y = 1 THEN score END), 9) AS mean_bonafide, ROUND(AVG(CASE WHEN y = 0 THEN score END), 9) AS mean_spoof FROM cues GROUP BY 1, 2) USING (part, cue)"),
    "q_prediction_verdict": (q_prediction_verdict, with_(BASE, EV, curve_sql("ev", "system"), eer_sql("curve", "system"), "pairs AS (SELECT * FROM (VALUES ('P1', 'A', 'B', 'lower'), ('P2', 'C', 'A', 'lower'), ('P3', 'B', 'missing', 'lower')) v(prediction, system, control, claim))") + " SELECT prediction, p.system, control, claim, a.eer AS eer_system, b.eer AS eer_control, 100 * (a.eer - b.eer) AS delta_pp, 100 * (a.eer - b.eer) < 0 AS supported FROM pairs p JOIN eer a ON a.system = p.system JOIN eer b ON b.system = p.control"),
    "q_matched_subset_decomposition": (q_matched_subset_decomposition, with_(BASE, "ss AS (SELECT *, CASE WHEN part = 'eval' AND speaker % 4 = 0 THEN 'eval_d4' WHEN part = 'hidden' AND n_frames >= 50 THEN 'hidden_notrim' WHEN part = 'hidden' THEN 'hidden_trim' END AS subset FROM trials)", "s2 AS (SELECT * FROM ss WHERE subset IS NOT NULL)", curve_sql("s2", "system, subset"), eer_sql("curve", "system, subset")) + " SELECT system, MAX(CASE WHEN subset = 'eval_d4' THEN eer END) AS eval_d4, MAX(CASE WHEN subset = 'hidden_notrim' THEN eer END) AS hidden_notrim, MAX(CASE WHEN subset = 'hidden_trim' THEN eer END) AS hidden_trim FROM eer GROUP BY system"),
}
def STRATA_OF(part: str) -> str:
    """Quarters of n_frames over a partition's trials."""
    return f"pr AS (SELECT * FROM trials WHERE part = '{part}'), ed AS (SELECT quantile_cont(n_frames, 0.25) AS q1, quantile_cont(n_frames, 0.5) AS q2, quantile_cont(n_frames, 0.75) AS q3 FROM pr), st AS (SELECT pr.*, CASE WHEN n_frames <= q1 THEN 0 WHEN n_frames <= q2 THEN 1 WHEN n_frames <= q3 THEN 2 ELSE 3 END AS stratum FROM pr CROSS JOIN ed)"

STRATA = STRATA_OF("progress")
QUERIES |= {
    "q_quantile_strata_eer": (q_quantile_strata_eer, with_(BASE, STRATA, curve_sql("st", "stratum, system"), eer_sql("curve", "stratum, system")) + " SELECT stratum, system, eer, median_frames, n_trials, n_bonafide FROM eer JOIN (SELECT stratum, CAST(MEDIAN(n_frames) AS DOUBLE) AS median_frames, COUNT(*) AS n_trials, CAST(SUM(y) AS BIGINT) AS n_bonafide FROM st WHERE system = 'A' GROUP BY 1) USING (stratum)"),
    "q_strata_verdict": (q_strata_verdict, with_(BASE, STRATA, curve_sql("st", "stratum, system"), eer_sql("curve", "stratum, system"), "win AS (SELECT stratum, system AS winner FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY eer, system) AS rk FROM eer) WHERE rk = 1)", "steps AS (SELECT *, winner >= COALESCE(LAG(winner) OVER (ORDER BY stratum), winner) AS rises FROM win)") + " SELECT STRING_AGG(winner, ',' ORDER BY stratum) AS winners, CASE WHEN COUNT(DISTINCT winner) > 1 THEN 'MOVES' ELSE 'FIXED' END AS verdict, BOOL_AND(rises) AS monotone FROM steps"),
}
ORACLE_SQL = {k: duckdb(v[1]) for k, v in QUERIES.items()}
QUERIES = {k: v[0] for k, v in QUERIES.items()}
