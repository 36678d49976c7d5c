"""Choosing and judging fusions: seeds, partners, prices, stored weights; assembly of many systems; views of one item
(J04, L07, L08, L23, L24, N02, N03, R12, M10, M12, M23, M27)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import model
from ..operators import ordering as o
from ..sources import files
from .metric_queries import ASV, BASE, CONFUSION, auc_sql, coefficients, curve_sql, eer_sql, tdcf_sql, with_
from .relational_queries import LOG, SWEEP
from .sql import duckdb

SYSTEMS = ("A", "B", "C")
CANDIDATES = ("A", "B", "C", "A+B", "A+C", "B+C", "A+B+C")
SEEDS, FOLDS = (1, 2, 3), (5, 10)


def normalised(s, d, fit: str) -> DataFrame:
    """Wide trials with every system's z-score by one partition's statistics (a row of them)."""
    w = model.wide_trials(s, d)
    st = w.where(F.col("part") == fit).agg(*[F.avg(x).alias(f"m{x}") for x in SYSTEMS], *[F.stddev_pop(x).alias(f"d{x}") for x in SYSTEMS])
    return w.crossJoin(F.broadcast(st)).select("filename", "speaker", "y", "part", *[((F.col(x) - F.col(f"m{x}")) / F.col(f"d{x}")).alias(x) for x in SYSTEMS])


def fusions(wide: DataFrame, candidates=CANDIDATES) -> DataFrame:
    """candidate, score: a row a trial and candidate, the mean of its systems' z-scores."""
    mean = lambda c: F.round(reduce(lambda a, b: a + b, [F.col(x) for x in c.split("+")]) / len(c.split("+")), 6)
    cells = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(len(c.split("+"))).alias("n_systems"), mean(c).alias("score")) for c in candidates])
    return wide.select("filename", "speaker", "y", "part", F.explode(cells).alias("c")).select("filename", "speaker", "y", "part", "c.*")


def q_seed_sweep(s, d):
    """The one-standard-error choice over seeds and numbers of folds."""
    z = normalised(s, d, "progress").where("part = 'progress'")
    grid = s.createDataFrame([(i, k) for i in SEEDS for k in FOLDS], "seed int, k int")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "speaker", "seed", "k")), 1, 8), 16, 10).cast("long")
    spk = o.numbered(z.select("speaker").distinct().crossJoin(F.broadcast(grid)).withColumn("u", u), ["seed", "k"], "u", ["speaker"])  # six rows a speaker
    small, more = F.floor(F.col("position_total") / F.col("k")), F.col("position_total") % F.col("k")
    at, long = F.col("position") - 1, more * (small + 1)
    folds = spk.withColumn("fold", F.when(at < long, F.floor(at / (small + 1))).otherwise(more + F.floor((at - long) / F.greatest(small, F.lit(1)))) + 1).select("speaker", "seed", "k", "fold")
    e = m.eer(fusions(z).join(folds, "speaker"), ["seed", "k", "candidate", "n_systems", "fold"])
    cv = e.groupBy("seed", "k", "candidate", "n_systems").agg(F.round(F.avg("eer"), 9).alias("cv_eer"), F.round(F.stddev_samp("eer") / F.sqrt(F.count("*")), 9).alias("se"), F.count("*").alias("n_folds"))
    best = cv.groupBy("seed", "k").agg(F.min_by(F.struct("candidate", "cv_eer", "se"), F.struct("cv_eer", "candidate")).alias("b"))
    rows = cv.join(best, ["seed", "k"]).withColumn("threshold", F.round(F.col("b.cv_eer") + F.col("b.se"), 9))
    rows = rows.withColumn("in_band", F.col("cv_eer") <= F.col("threshold")).withColumn("is_best", F.col("candidate") == F.col("b.candidate"))
    first = Window.partitionBy("seed", "k").orderBy(F.col("in_band").desc(), "n_systems", "cv_eer", "candidate")  # a row a candidate
    return rows.select("seed", "k", "candidate", "n_systems", "cv_eer", "se", "n_folds", "threshold", F.round(F.col("threshold") - F.col("cv_eer"), 9).alias("headroom"), "in_band", "is_best", (F.row_number().over(first) == 1).alias("selected"))


def q_partner_gain(s, d):
    """What each partner adds to system A, and its share of what all add."""
    e = m.eer(fusions(normalised(s, d, "progress").where("part = 'eval'")), ["candidate"]).select("candidate", "eer")
    own = e.where("candidate = 'A'").select(F.col("eer").alias("own"))
    least = e.where("candidate like 'A%'").agg(F.min("eer").alias("least"))
    rows = e.where("candidate like 'A+%'").crossJoin(F.broadcast(own)).crossJoin(F.broadcast(least))  # one row each
    return rows.select(F.substring("candidate", 3, 9).alias("partner"), F.round(F.col("own") - F.col("eer"), 9).alias("gain"), F.round((F.col("own") - F.col("eer")) / F.nullif(F.col("own") - F.col("least"), F.lit(0.0)), 6).alias("share"))


def q_price_of_labels(s, d):
    """One application to eval of a fusion fitted elsewhere, against the best single system; what fitting it without the
    target's labels costs."""
    out = None
    for fit in ("progress", "hidden"):
        rows = fusions(normalised(s, d, fit).where("part = 'eval'")).withColumn("fit", F.lit(fit))
        out = rows if out is None else out.unionByName(rows)
    e = m.eer(out, ["fit", "candidate", "n_systems"])
    one = e.groupBy("fit").agg(F.min(F.when(F.col("candidate") == "A+B+C", F.col("eer"))).alias("eer"), F.min(F.when(F.col("n_systems") == 1, F.col("eer"))).alias("best_single"))
    base = one.agg(F.min(F.when(F.col("fit") == "progress", F.col("eer"))).alias("b"))
    return one.crossJoin(F.broadcast(base)).select("fit", F.round("eer", 9).alias("eer"), F.round("best_single", 9).alias("best_single"), F.round(F.col("eer") - F.col("best_single"), 9).alias("delta"), F.round(F.col("eer") - F.col("b"), 9).alias("price"))  # one row


def q_reproduce_scores(s, d):
    """The weights of a stored fusion (system C) from its parts by least squares, and the scores they reproduce."""
    w = model.wide_trials(s, d)
    c = w.where("part = 'progress'").agg(*[F.covar_pop(a, b).alias(a + b) for a, b in ("AA", "AB", "BB", "AC", "BC")], *[F.avg(x).alias(f"m{x}") for x in SYSTEMS])
    det = F.col("AA") * F.col("BB") - F.col("AB") * F.col("AB")
    c = c.select("*", ((F.col("AC") * F.col("BB") - F.col("BC") * F.col("AB")) / det).alias("wa"), ((F.col("BC") * F.col("AA") - F.col("AC") * F.col("AB")) / det).alias("wb")).withColumn("b0", F.col("mC") - F.col("wa") * F.col("mA") - F.col("wb") * F.col("mB"))
    again = F.col("wa") * F.col("A") + F.col("wb") * F.col("B") + F.col("b0")
    rows = w.where("part = 'eval'").crossJoin(F.broadcast(c.select("wa", "wb", "b0")))  # one row
    return rows.agg(F.round(F.first("wa"), 6).alias("weight_a"), F.round(F.first("wb"), 6).alias("weight_b"), F.round(F.first("b0"), 6).alias("intercept"), (F.max(F.abs(again - F.col("C"))) < 1e-6).alias("reproduced"), F.round(F.corr("A", "B"), 6).alias("parts_corr"), F.count("*").alias("n"))


REGISTRY = (("A", "lcnn"), ("B", "classical"), ("C", "fusion"), ("Q", "baseline"), ("E", "posthoc"))


def q_score_assembly_nway(s, d):
    """Many systems' scores from several tables as one long table, joined once to every trial and registered system."""
    e = model.wide_trials(s, d)
    long = e.unpivot(["filename"], list(SYSTEMS), "system", "score")
    long = long.unionByName(model.read(s, d, "labels").select(F.col("doc_id").alias("filename"), F.lit("Q").alias("system"), F.col("quality").cast("double").alias("score")))
    long = long.unionByName(model.read(s, d, "embeddings").select(F.col("vec_id").alias("filename"), F.lit("E").alias("system"), F.col("label").cast("double").alias("score")))
    wanted = e.select("filename", "part", "y").crossJoin(F.broadcast(s.createDataFrame(list(REGISTRY), "system string, kind string")))  # a row a system
    return wanted.join(long, ["filename", "system"], "left").select("filename", "part", "y", "system", "kind", "score")


#: Systems and the view of an item that each takes: frames, normalisation.
VIEWS = (("S1", 32, "unit"), ("S2", 96, "unit"), ("S3", 32, "cmvn"), ("S4", 96, "unit"))


def q_multi_view(s, d):
    """Read, window, mask, normalise; every distinct view is made once and shared by the systems that take it."""
    e = model.read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    views = sorted({(t, norm) for _, t, norm in VIEWS})
    for t, norm in views:
        times = -(-t // 64)
        y = F.slice(F.flatten(F.array_repeat("x", times)), (64 * times - t) // 2 + 1, t)
        y = F.transform(y, lambda v, i: F.when(i % 16 < 2, F.lit(0.0)).otherwise(v))
        if norm == "cmvn":
            mean = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q) / t
            e = e.withColumn("_y", y).withColumn("_m", mean("_y")).withColumn("_d", F.sqrt(mean(F.transform("_y", lambda v: (v - F.col("_m")) * (v - F.col("_m"))))))
            y = F.transform("_y", lambda v: (v - F.col("_m")) / (F.col("_d") + 1e-5))
        else:
            y = F.transform(y, lambda v: v / 255)
        e = e.withColumn(f"v_{t}_{norm}", y)
    score = lambda view: F.aggregate(F.transform(view, lambda v, i: v * (i % 7 - 3)), F.lit(0.0), lambda a, b: a + b)
    e = e.select("vec_id", *[score(f"v_{t}_{n}").alias(f"s_{t}_{n}") for t, n in views])
    cells = F.array(*[F.struct(F.lit(name).alias("system"), F.round(f"s_{t}_{n}", 6).alias("score")) for name, t, n in VIEWS])
    return e.select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.*")


def view_sql(t: int, norm: str) -> str:
    times = -(-t // 64)
    lo = (64 * times - t) // 2
    y = f"list_transform((flatten(list_transform(range({times}), lambda r: x)))[{lo + 1}:{lo + t}], lambda v, i: CASE WHEN (i - 1) % 16 < 2 THEN CAST(0 AS DOUBLE) ELSE v END)"
    mean = f"list_sum({y}) / {t}"
    sd = f"sqrt(list_sum(list_transform({y}, lambda v: (v - {mean}) * (v - {mean}))) / {t})"
    out = f"list_transform({y}, lambda v: (v - {mean}) / ({sd} + 1e-5))" if norm == "cmvn" else f"list_transform({y}, lambda v: v / 255)"
    return f"ROUND(list_sum(list_transform({out}, lambda v, i: v * ((i - 1) % 7 - 3))), 6)"


def q_tdcf_validation(s, d):
    """The tandem costs that come from the scores against the published table, a file of four decimals: within 2e-4 each."""
    path = files.scratch(s, "published")
    costs = m.min_tdcf_of(m.error_curve(model.trials(s, d), ["part", "system"]), ["part", "system"], coefficients(s, d))
    costs.select("part", "system", F.format_number("min_tdcf", 4).alias("published")).write.option("header", True).csv(path)
    published = files.table(s, path, "part string, system string, published double")
    again = m.system_table(model.trials(s, d), ["part", "system"], coefficients(s, d))
    rows = published.join(again, ["part", "system"], "left").withColumn("ok", F.coalesce(F.abs(F.col("min_tdcf") - F.col("published")) < 2e-4, F.lit(False)))
    return rows.select("part", "system", "published", F.round("min_tdcf", 9).alias("computed"), "ok")


def q_posthoc_whitelist(s, d):
    """The full table of whitelisted systems and partitions, with the tandem cost."""
    allowed = s.createDataFrame([("A", "progress"), ("A", "hidden"), ("B", "progress"), ("C", "hidden")], "system string, part string")
    return m.system_table(model.trials(s, d).join(F.broadcast(allowed), ["system", "part"], "left_semi"), ["system", "part"], coefficients(s, d))


AXES = (("dose", 1, "A", "progress"), ("dose", 2, "B", "progress"), ("dose", 3, "C", "hidden"), ("window", 25, "A", "hidden"), ("window", 50, "B", "none"), ("window", 75, "D", "none"))


def q_axis_sweep(s, d):
    """Points of axes joined to two tables of error rates, the second where the first has none."""
    e = m.eer(model.trials(s, d), ["part", "system"]).select("part", "system", "eer")
    reg = s.createDataFrame(list(AXES), "axis string, point int, system string, part string")
    other = e.where("part = 'eval'").select("system", F.col("eer").alias("other"))
    out = reg.join(e, ["system", "part"], "left").join(other, "system", "left")
    return out.select("axis", "point", "system", F.coalesce("eer", "other").alias("eer"), F.when(F.col("eer").isNotNull(), "own").when(F.col("other").isNotNull(), "eval").alias("source"))


REG = lambda rows, cols: f"(SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) v({cols}))"
Z = lambda fit: f"st AS (SELECT system, AVG(score) AS mu, STDDEV_POP(score) AS sd FROM trials WHERE part = '{fit}' GROUP BY system), mem AS (SELECT c.candidate, len(string_split(c.candidate, '+')) AS n_systems, unnest(string_split(c.candidate, '+')) AS system FROM (SELECT unnest({list(CANDIDATES)}) AS candidate) c)"
FZ = lambda part, name="fz": f"{name} AS (SELECT mem.candidate, mem.n_systems, t.filename, t.speaker, t.y, ROUND(AVG((score - mu) / sd), 6) AS score FROM trials t JOIN st ON st.system = t.system JOIN mem ON mem.system = t.system WHERE part = '{part}' GROUP BY ALL)"
Q = {
    "q_seed_sweep": (
        q_seed_sweep,
        with_(
            BASE, Z("progress"), FZ("progress"), "grid AS (SELECT * FROM (VALUES (1), (2), (3)) a(seed) CROSS JOIN (VALUES (5), (10)) b(k))",
            "rk AS (SELECT speaker, seed, k, ROW_NUMBER() OVER (PARTITION BY seed, k ORDER BY {{U32:concat({{STR:speaker}}, ':', {{STR:seed}}, ':', {{STR:k}})}}, speaker) - 1 AS pos, COUNT(*) OVER (PARTITION BY seed, k) AS n FROM (SELECT DISTINCT speaker FROM fz) s CROSS JOIN grid)",
            "folds AS (SELECT speaker, seed, k, CASE WHEN pos < (n % k) * (n // k + 1) THEN pos // (n // k + 1) ELSE n % k + (pos - (n % k) * (n // k + 1)) // GREATEST(n // k, 1) END + 1 AS fold FROM rk)",
            "ff AS (SELECT seed, k, candidate, n_systems, fold, y, score FROM fz JOIN folds ON folds.speaker = fz.speaker)", curve_sql("ff", "seed, k, candidate, n_systems, fold"), eer_sql("curve", "seed, k, candidate, n_systems, fold"),
            "cv AS (SELECT seed, k, candidate, n_systems, ROUND(AVG(eer), 9) AS cv_eer, ROUND(STDDEV_SAMP(eer) / SQRT(COUNT(*)), 9) AS se, COUNT(*) AS n_folds FROM eer GROUP BY ALL)",
            "b AS (SELECT seed, k, candidate AS best, ROUND(cv_eer + se, 9) AS threshold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY seed, k ORDER BY cv_eer, candidate) AS r FROM cv) x WHERE r = 1)",
        )
        + " SELECT cv.*, CAST(n_systems AS INT) AS n_systems, threshold, ROUND(threshold - cv_eer, 9) AS headroom, cv_eer <= threshold AS in_band, candidate = best AS is_best, ROW_NUMBER() OVER (PARTITION BY cv.seed, cv.k ORDER BY cv_eer <= threshold DESC, n_systems, cv_eer, candidate) = 1 AS selected FROM cv JOIN b ON b.seed = cv.seed AND b.k = cv.k".replace("cv.*, CAST", "cv.* EXCLUDE (n_systems), CAST"),
    ),
    "q_partner_gain": (
        q_partner_gain,
        with_(BASE, Z("progress"), FZ("eval"), curve_sql("fz", "candidate"), eer_sql("curve", "candidate"), "o AS (SELECT MAX(CASE WHEN candidate = 'A' THEN eer END) AS own, MIN(CASE WHEN candidate LIKE 'A%' THEN eer END) AS least FROM eer)")
        + " SELECT substr(candidate, 3) AS partner, ROUND(own - eer, 9) AS gain, ROUND((own - eer) / NULLIF(own - least, 0), 6) AS share FROM eer CROSS JOIN o WHERE candidate LIKE 'A+%'",
    ),
    "q_price_of_labels": (
        q_price_of_labels,
        "WITH "
        + ", ".join(f"r_{fit} AS ({with_(BASE, Z(fit), FZ('eval'), curve_sql('fz', 'candidate, n_systems'), eer_sql('curve', 'candidate, n_systems'))} SELECT '{fit}' AS fit, MIN(CASE WHEN candidate = 'A+B+C' THEN eer END) AS eer, MIN(CASE WHEN n_systems = 1 THEN eer END) AS best_single FROM eer)" for fit in ("progress", "hidden"))
        + " SELECT fit, ROUND(eer, 9) AS eer, ROUND(best_single, 9) AS best_single, ROUND(eer - best_single, 9) AS delta, ROUND(eer - (SELECT eer FROM r_progress), 9) AS price FROM (SELECT * FROM r_progress UNION ALL SELECT * FROM r_hidden) x",
    ),
    "q_reproduce_scores": (
        q_reproduce_scores,
        with_(BASE, "w AS (SELECT part, value AS a, CAST(n_frames AS DOUBLE) AS b, value - n_frames / CAST(2 AS DOUBLE) AS c FROM base)", "k AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, AVG(a) AS ma, AVG(b) AS mb, AVG(c) AS mc FROM w WHERE part = 'progress')", "l AS (SELECT *, (ac * bb - bc * ab) / (aa * bb - ab * ab) AS wa, (bc * aa - ac * ab) / (aa * bb - ab * ab) AS wb FROM k)")
        + " SELECT ROUND(MAX(wa), 6) AS weight_a, ROUND(MAX(wb), 6) AS weight_b, ROUND(MAX(mc - wa * ma - wb * mb), 6) AS intercept, MAX(ABS(wa * a + wb * b + mc - wa * ma - wb * mb - c)) < 1e-6 AS reproduced, ROUND(CORR(a, b), 6) AS parts_corr, COUNT(*) AS n FROM w CROSS JOIN l WHERE part = 'eval'",
    ),
    "q_score_assembly_nway": (
        q_score_assembly_nway,
        with_(BASE, f"reg AS {REG(REGISTRY, 'system, kind')}", "l AS (SELECT filename, system, score FROM trials UNION ALL SELECT doc_id, 'Q', CAST(quality AS DOUBLE) FROM labels UNION ALL SELECT vec_id, 'E', CAST(label AS DOUBLE) FROM embeddings)")
        + " SELECT base.filename, part, y, reg.system, kind, l.score FROM base CROSS JOIN reg LEFT JOIN l ON l.filename = base.filename AND l.system = reg.system",
    ),
    "q_multi_view": (q_multi_view, "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) " + " UNION ALL ".join(f"SELECT vec_id, '{name}' AS system, {view_sql(t, norm)} AS score FROM e" for name, t, norm in VIEWS)),
    "q_tdcf_validation": (
        q_tdcf_validation,
        with_(BASE, ASV, curve_sql("trials", "part, system"), tdcf_sql("curve", "part, system")) + " SELECT part, system, CAST(printf('%.4f', min_tdcf) AS DOUBLE) AS published, ROUND(min_tdcf, 9) AS computed, ABS(min_tdcf - CAST(printf('%.4f', min_tdcf) AS DOUBLE)) < 2e-4 AS ok FROM tdcf",
    ),
    "q_posthoc_whitelist": (
        q_posthoc_whitelist,
        with_(BASE, ASV, "ok AS (SELECT * FROM trials WHERE (system, part) IN (('A', 'progress'), ('A', 'hidden'), ('B', 'progress'), ('C', 'hidden')))", curve_sql("ok", "system, part"), eer_sql("curve", "system, part"), auc_sql("curve", "system, part"), tdcf_sql("curve", "system, part"))
        + f" SELECT system, part, threshold, eer, {CONFUSION}, roc_auc, min_tdcf, tdcf_threshold FROM eer JOIN auc USING (system, part) JOIN tdcf USING (system, part)",
    ),
    "q_axis_sweep": (
        q_axis_sweep,
        with_(BASE, curve_sql("trials", "part, system"), eer_sql("curve", "part, system"), f"reg AS {REG(AXES, 'axis, point, system, part')}")
        + " SELECT axis, point, reg.system, COALESCE(a.eer, b.eer) AS eer, CASE WHEN a.eer IS NOT NULL THEN 'own' WHEN b.eer IS NOT NULL THEN 'eval' END AS source FROM reg LEFT JOIN eer a ON a.system = reg.system AND a.part = reg.part LEFT JOIN eer b ON b.system = reg.system AND b.part = 'eval'",
    ),
}


def swept(s, d):
    o_ = model.read(s, d, "orders")
    gamma = F.when(F.col("o_orderkey") % 4 == 0, "scale").when(F.col("o_orderkey") % 4 == 1, "0.01").when(F.col("o_orderkey") % 4 == 2, "0.1").otherwise("1")
    return o_.groupBy((F.col("o_custkey") % 4 + 1).cast("int").alias("n_train"), (F.col("o_orderkey") % 3).cast("int").alias("c"), gamma.alias("gamma")).agg(F.avg((F.col("o_totalprice") > 150000).cast("double")).alias("eer"))


def q_learning_curve(s, d):
    """The envelope by training size, and two kinds of models compared at equal sizes."""
    t = swept(s, d).withColumn("kind", F.when(F.col("gamma") == "scale", "svm").otherwise("rf"))
    env = t.groupBy("n_train").agg(F.round(F.min("eer"), 9).alias("best"), F.round(F.avg("eer"), 9).alias("mean"), F.round(F.max("eer"), 9).alias("worst"), F.count("*").alias("n"), F.min(F.when(F.col("kind") == "svm", F.col("eer"))).alias("_a"), F.min(F.when(F.col("kind") == "rf", F.col("eer"))).alias("_b"))
    return env.select("n_train", "best", "mean", "worst", "n", F.round("_a", 9).alias("svm"), F.round("_b", 9).alias("rf"), F.round(F.col("_a") - F.col("_b"), 9).alias("svm_minus_rf"))


def q_checkpoint_delta(s, d):
    """Pairs of each run's best and last epoch, the mean and median of their differences, and the pairs that are one epoch."""
    e = model.read(s, d, "events")
    run = F.col("user_id") % 7
    log = e.groupBy(run.alias("run"), F.dayofmonth("ts").alias("epoch")).agg(F.avg((F.col("value") > 30).cast("double")).alias("dev"))
    pairs = log.groupBy("run").agg(F.min_by(F.struct("epoch", "dev"), F.struct("dev", "epoch")).alias("b"), F.max(F.struct("epoch", "dev")).alias("l"))
    diff = pairs.select((F.col("l.dev") - F.col("b.dev")).alias("d"), (F.col("l.epoch") == F.col("b.epoch")).alias("same"))
    return diff.agg(F.round(F.avg("d"), 9).alias("mean"), F.round(F.median("d"), 9).alias("median"), F.round(F.max("d"), 9).alias("most"), F.count(F.when(F.col("same"), 1)).alias("n_same"), F.bool_and(~F.col("same") | (F.col("d") == 0)).alias("control"), F.count("*").alias("n"))


Q["q_learning_curve"] = (
    q_learning_curve,
    with_(SWEEP.replace("[orders]", "orders"), "k AS (SELECT *, CASE WHEN gamma = 'scale' THEN 'svm' ELSE 'rf' END AS kind FROM sweep)")
    + " SELECT n_train, ROUND(MIN(eer), 9) AS best, ROUND(AVG(eer), 9) AS mean, ROUND(MAX(eer), 9) AS worst, COUNT(*) AS n, ROUND(MIN(CASE WHEN kind = 'svm' THEN eer END), 9) AS svm, ROUND(MIN(CASE WHEN kind = 'rf' THEN eer END), 9) AS rf, ROUND(MIN(CASE WHEN kind = 'svm' THEN eer END) - MIN(CASE WHEN kind = 'rf' THEN eer END), 9) AS svm_minus_rf FROM k GROUP BY n_train",
)
Q["q_checkpoint_delta"] = (
    q_checkpoint_delta,
    "WITH g AS (SELECT user_id % 7 AS run, day(ts) AS epoch, AVG(CASE WHEN value > 30 THEN CAST(1 AS DOUBLE) WHEN value IS NOT NULL THEN CAST(0 AS DOUBLE) END) AS dev FROM events GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY dev, epoch) AS r FROM g) x WHERE r = 1), l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY epoch DESC) AS r FROM g) x WHERE r = 1), p AS (SELECT l.dev - b.dev AS d, l.epoch = b.epoch AS same FROM b JOIN l ON l.run = b.run) SELECT ROUND(AVG(d), 9) AS mean, ROUND(MEDIAN(d), 9) AS median, ROUND(MAX(d), 9) AS most, COUNT(CASE WHEN same THEN 1 END) AS n_same, BOOL_AND(NOT same OR d = 0) AS control, COUNT(*) AS n FROM p",
)
QUERIES = {k: v[0] for k, v in Q.items()}
ORACLE_SQL = {k: duckdb(v[1]) for k, v in Q.items()}
