"""Queries over the operators of scorelake.operators.ordering: no window holds a table or a large group. Their SQL, for the other
engine only, is written with plain windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import model
from ..operators import ordering as o
from .metric_queries import BASE, FNR, FPR, curve_sql, probit_sql, with_
from .sql import duckdb

EV = "ev AS (SELECT * FROM trials WHERE part = 'eval')"


def base(s, d):
    return model.wide_trials(s, d)


def evaluated(s, d):
    return model.trials(s, d).where("part = 'eval'")


def u32(*parts):
    """32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def q_quantiles(s, d):
    return o.quantiles(evaluated(s, d), ["system"], "score", {"lo": 0.025, "mid": 0.5, "hi": 0.975})


def q_spearman_matrix(s, d):
    ranks = o.ranked(evaluated(s, d).select("filename", "system", "score"), ["system"], "score")
    wide = ranks.groupBy("filename").pivot("system", ["A", "B", "C"]).agg(F.first("avg_rank"))
    pairs = [("A", "B"), ("A", "C"), ("B", "C")]
    one = wide.agg(*[F.corr(a, b).alias(f"{a}{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"), F.round(f"{a}{b}", 8).alias("rho")) for a, b in pairs])).alias("x")).select("x.*")


def offsets(s, d):
    docs = model.read(s, d, "documents").select("doc_id", "n_chars")
    return o.running_sums(docs, [], "doc_id", {"upto": F.col("n_chars")}).withColumn("offset_", (F.col("upto") - F.col("n_chars")).cast("long"))


def q_avg_rank(s, d):
    return o.ranked(evaluated(s, d).select("filename", "system", "score"), ["system"], "score").select("filename", "system", "avg_rank")


def q_rank_inversions(s, d):
    docs = model.read(s, d, "documents").select("doc_id", "n_chars", (F.char_length("text") + F.col("doc_id") % 2).alias("other"))
    both = o.numbered(o.numbered(docs, [], "n_chars", ["doc_id"], name="ra"), [], "other", ["doc_id"], name="rb")
    return both.agg(F.count(F.when(F.col("ra") != F.col("rb"), 1)).alias("moved"), F.max(F.abs(F.col("ra") - F.col("rb"))).cast("long").alias("farthest"))


def q_tie_ends(s, d):
    counts = evaluated(s, d).groupBy("system", "score").agg(F.count("*").alias("ties"))
    return o.running_sums(counts, ["system"], "score", {"last_position": F.col("ties")}, ascending=False).select("system", "score", "ties", F.col("last_position").cast("long").alias("last_position"))


def q_group_split(s, d):
    e = model.read(s, d, "events").select("event_id", "user_id")
    users = o.numbered(e.select("user_id").distinct().withColumn("u", u32(F.col("user_id"), ":42")), [], "u", ["user_id"])
    split = users.select("user_id", F.when(F.col("position") <= F.floor(0.75 * F.col("position_total")), "train").otherwise("dev").alias("split"))
    return e.join(split, "user_id").select("event_id", "split")


def q_stratified_subsample(s, d):
    rows = base(s, d).select("filename", "y", u32(F.col("filename"), ":s2000").alias("u"))
    found = o.numbered(rows, ["y"], "u", ["filename"])
    n = rows.agg(F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(n)).where(F.col("position") <= F.round(2000 * F.col("position_total").cast("double") / F.col("n"))).select("filename", "y")  # n is one row


def q_label_sample(s, d):
    rows = base(s, d).select("filename", "y", u32(F.col("filename"), ":lab").alias("u"))
    return o.numbered(rows, ["y"], "u", ["filename"]).where("position <= 150").select("filename", "y")


def q_speaker_folds(s, d):
    users = o.numbered(model.read(s, d, "events").select("user_id").distinct().withColumn("u", u32(F.col("user_id"), ":fold")), [], "u", ["user_id"])
    small, more = F.floor(F.col("position_total") / 5), F.col("position_total") % 5  # the first folds have one more
    long = more * (small + 1)
    at = F.col("position") - 1
    fold = F.when(at < long, F.floor(at / (small + 1))).otherwise(more + F.floor((at - long) / F.greatest(small, F.lit(1)))) + 1
    return users.select("user_id", fold.cast("int").alias("fold"))


def q_det_points(s, d):
    c = m.two_class(m.error_curve(evaluated(s, d), ["system"])).where("nb > tp and tp > 0 and ns > fp and fp > 0")
    return c.select("system", "score", F.round(m.probit(m.fpr()), 9).alias("x"), F.round(m.probit(m.fnr()), 9).alias("y"))


Q = {
    "q_quantiles": (q_quantiles, with_(BASE, EV) + " SELECT system, quantile_cont(score, 0.025) AS lo, quantile_cont(score, 0.5) AS mid, quantile_cont(score, 0.975) AS hi FROM ev GROUP BY system"),
    "q_spearman_matrix": (
        q_spearman_matrix,
        with_(BASE, EV, "r AS (SELECT filename, system, RANK() OVER (PARTITION BY system ORDER BY score) + (COUNT(*) OVER (PARTITION BY system, score) - 1) / CAST(2 AS DOUBLE) AS rk FROM ev)")
        + " SELECT a.system AS s1, b.system AS s2, ROUND(CORR(a.rk, b.rk), 8) AS rho FROM r a JOIN r b ON a.filename = b.filename WHERE a.system < b.system GROUP BY 1, 2",
    ),
    "q_running_offset": (lambda s, d: offsets(s, d).select("doc_id", "n_chars", "offset_"), "SELECT doc_id, n_chars, CAST(SUM(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS BIGINT) AS offset_ FROM documents"),
    "q_resume_point": (lambda s, d: offsets(s, d).where("offset_ <= 100000").agg(F.max("doc_id").alias("resume_at")), "WITH o AS (SELECT doc_id, SUM(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS off FROM documents) SELECT MAX(doc_id) AS resume_at FROM o WHERE off <= 100000"),
    "q_avg_rank": (q_avg_rank, with_(BASE, EV) + " SELECT filename, system, RANK() OVER (PARTITION BY system ORDER BY score) + (COUNT(*) OVER (PARTITION BY system, score) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM ev"),
    "q_rank_inversions": (
        q_rank_inversions,
        "WITH r AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY n_chars, doc_id) AS ra, ROW_NUMBER() OVER (ORDER BY length(text) + doc_id % 2, doc_id) AS rb FROM documents) SELECT COUNT(CASE WHEN ra <> rb THEN 1 END) AS moved, CAST(MAX(ABS(ra - rb)) AS BIGINT) AS farthest FROM r",
    ),
    "q_tie_ends": (q_tie_ends, with_(BASE, EV) + " SELECT system, score, COUNT(*) AS ties, CAST(SUM(COUNT(*)) OVER (PARTITION BY system ORDER BY score DESC) AS BIGINT) AS last_position FROM ev GROUP BY system, score"),
    "q_chunk_ids": (
        lambda s, d: o.numbered(model.read(s, d, "events").select("event_id"), [], "event_id").select("event_id", F.floor((F.col("position") - 1) / 4000).cast("long").alias("chunk")),
        "SELECT event_id, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY event_id) - 1) / CAST(4000 AS DOUBLE)) AS BIGINT) AS chunk FROM events",
    ),
    "q_group_split": (
        q_group_split,
        "WITH g AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY {{U32:concat({{STR:user_id}}, ':42')}}, user_id) AS r, COUNT(*) OVER () AS n FROM g) SELECT e.event_id, CASE WHEN r.r <= FLOOR(0.75 * r.n) THEN 'train' ELSE 'dev' END AS split FROM events e JOIN r ON e.user_id = r.user_id",
    ),
    "q_stratified_subsample": (
        q_stratified_subsample,
        with_(BASE, "r AS (SELECT filename, y, ROW_NUMBER() OVER (PARTITION BY y ORDER BY {{U32:concat({{STR:filename}}, ':s2000')}}, filename) AS r, COUNT(*) OVER (PARTITION BY y) AS ny, COUNT(*) OVER () AS n FROM base)") + " SELECT filename, y FROM r WHERE r <= ROUND(2000 * CAST(ny AS DOUBLE) / n)",
    ),
    "q_label_sample": (q_label_sample, with_(BASE, "r AS (SELECT filename, y, ROW_NUMBER() OVER (PARTITION BY y ORDER BY {{U32:concat({{STR:filename}}, ':lab')}}, filename) AS r FROM base)") + " SELECT filename, y FROM r WHERE r <= 150"),
    "q_speaker_folds": (q_speaker_folds, "WITH g AS (SELECT DISTINCT user_id FROM events) SELECT user_id, CAST(NTILE(5) OVER (ORDER BY {{U32:concat({{STR:user_id}}, ':fold')}}, user_id) AS INT) AS fold FROM g"),
    "q_det_points": (q_det_points, with_(BASE, EV, curve_sql("ev", "system")) + f" SELECT system, score, ROUND({probit_sql(FPR)}, 9) AS x, ROUND({probit_sql(FNR)}, 9) AS y FROM curve WHERE nb > tp AND tp > 0 AND ns > fp AND fp > 0"),
}
QUERIES = {k: v[0] for k, v in Q.items()}
ORACLE_SQL = {k: duckdb(v[1]) for k, v in Q.items()}
