"""Relational, window, set, sampling, inference, fusion, array and narrative operators as queries: one SQL text for Spark and for
the oracle (scorelake.plans.sql). The operator IDs of the survey stand beside each query."""

from __future__ import annotations

from .metric_queries import BASE, curve_sql, eer_sql, with_
from .sql import duckdb, spark

EV = "ev AS (SELECT * FROM trials WHERE part = 'eval')"
EER = (curve_sql("ev", "system"), eer_sql("curve", "system"))
#: A small sweep table: sizes, C, gamma and error rates, from order priorities and clerks' buckets.
SWEEP = """sweep AS (SELECT CAST(o_custkey % 4 + 1 AS INT) AS n_train, CAST(o_orderkey % 3 AS INT) AS c, CASE o_orderkey % 4 WHEN 0 THEN 'scale' WHEN 1 THEN '0.01' WHEN 2 THEN '0.1' ELSE '1' END AS gamma,
  AVG(CAST(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS DOUBLE)) AS eer FROM [orders] GROUP BY 1, 2, 3)"""
#: A training log: one row per day with a development error rate.
LOG = "log AS (SELECT CAST(day(ts) AS INT) AS epoch, AVG(CAST(y AS DOUBLE)) AS train_eer, AVG(CASE WHEN value > 30 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS dev_eer FROM (SELECT ts, value, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS y FROM [events]) e GROUP BY 1)"
EMB = "emb AS (SELECT vec_id, label, embedding AS x FROM [embeddings])"


def unit(x: str) -> str:
    """A uniform draw in [0, 1) from a string, the same in both engines."""
    return f"({{{{U32:{x}}}}} / CAST(4294967296 AS DOUBLE))"


TEXT = {
    # aggregations
    "q_class_balance": "SELECT event_type, COUNT(*) AS n FROM [events] GROUP BY event_type",
    "q_attack_distribution": with_(BASE) + " SELECT part, event_type, COUNT(*) AS n, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY part), 9) AS share FROM base GROUP BY part, event_type",
    "q_nunique_speakers": with_(BASE) + " SELECT part, COUNT(DISTINCT speaker) AS n_speakers FROM base GROUP BY part",
    "q_gender_pivot": with_(BASE) + " SELECT part, " + ", ".join(f"COUNT(CASE WHEN event_type = '{e}' THEN 1 END) AS n_{e}" for e in ("view", "click", "purchase", "signup", "error")) + " FROM base GROUP BY part",
    "q_melt_counts": with_(BASE, "c AS (SELECT part, COUNT(CASE WHEN y = 1 THEN 1 END) AS bonafide, COUNT(CASE WHEN y = 0 THEN 1 END) AS spoof FROM base GROUP BY part)") + " SELECT part, 'bonafide' AS label, bonafide AS n FROM c UNION ALL SELECT part, 'spoof' AS label, spoof AS n FROM c",
    "q_describe_duration": with_(BASE) + " SELECT y, COUNT(*) AS n, ROUND(AVG(n_frames), 9) AS mean, CAST({{PCT:n_frames|0.5}} AS DOUBLE) AS p50, MIN(n_frames) AS lo, MAX(n_frames) AS hi FROM base GROUP BY y",
    "q_class_ratio": with_(BASE) + " SELECT part, ROUND(CAST(SUM(1 - y) AS DOUBLE) / SUM(y), 9) AS spoof_per_bonafide FROM base GROUP BY part",
    "q_fold_se": with_(BASE, "f AS (SELECT system, speaker % 5 AS fold, AVG(score) AS v FROM trials GROUP BY 1, 2)") + " SELECT system, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v) / SQRT(COUNT(v)), 6) AS se, ROUND(STDDEV_POP(v), 6) AS sd_pop FROM f GROUP BY system",
    "q_best_per_size": with_(SWEEP) + " SELECT n_train, c, gamma, eer FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_train ORDER BY eer, c, gamma) AS r FROM sweep) x WHERE r = 1",
    "q_sweep_pivot": with_(SWEEP) + " SELECT c, " + ", ".join(f"ROUND(AVG(CASE WHEN gamma = '{g}' THEN eer END), 9) AS g_{n}" for g, n in (("scale", "scale"), ("0.01", "001"), ("0.1", "01"), ("1", "1"))) + " FROM sweep GROUP BY c",
    "q_edge_warnings": with_(SWEEP, "w AS (SELECT *, ROW_NUMBER() OVER (ORDER BY eer, n_train, c, gamma) AS r FROM sweep)", "g AS (SELECT MIN(c) AS lo, MAX(c) AS hi FROM sweep)") + " SELECT n_train, c, gamma, c = lo AS at_low_edge, c = hi AS at_high_edge FROM w CROSS JOIN g WHERE r = 1",
    "q_work_order": with_(SWEEP) + " SELECT n_train, c, gamma, CAST(ROW_NUMBER() OVER (ORDER BY n_train, CASE WHEN gamma IN ('0.1', '1') THEN 1 ELSE 0 END, gamma, c) AS BIGINT) AS position FROM sweep",
    "q_generalisation_gap": with_(LOG) + " SELECT epoch, ROUND(train_eer - dev_eer, 9) AS gap, dev_eer = MIN(dev_eer) OVER () AS is_best FROM log",
    "q_early_stop": with_(LOG, "b AS (SELECT epoch, dev_eer, MIN(dev_eer) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM log)", "m AS (SELECT *, MAX(CASE WHEN dev_eer = best THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_epoch FROM b)") + " SELECT epoch, ROUND(best, 9) AS best, epoch - best_epoch AS since_best, epoch - best_epoch >= 8 AS stop FROM m",
    "q_rank_agreement": with_(BASE, curve_sql("trials", "part, system"), eer_sql("curve", "part, system"), "x AS (SELECT d.system, d.eer AS dev, t.eer AS tgt FROM eer d JOIN eer t ON d.system = t.system WHERE d.part = 'progress' AND t.part = 'eval')", "rk AS (SELECT system, CAST(RANK() OVER (ORDER BY dev) AS DOUBLE) AS rd, CAST(RANK() OVER (ORDER BY tgt) AS DOUBLE) AS rt FROM x)") + " SELECT ROUND(CORR(rd, rt), 8) AS rho, COUNT(*) AS n FROM rk",
    "q_loglinear_trend": with_(BASE) + " SELECT part, ROUND(REGR_SLOPE(value, LOG10(n_frames + 1)), 6) AS slope, ROUND(REGR_INTERCEPT(value, LOG10(n_frames + 1)), 6) AS intercept FROM base GROUP BY part",
    "q_weight_share": with_(BASE, "c AS (SELECT speaker % 5 AS fold, system, AVG(CASE WHEN y = 1 THEN score END) - AVG(CASE WHEN y = 0 THEN score END) AS coef FROM trials GROUP BY 1, 2)") + " SELECT fold, system, ROUND(coef / SUM(ABS(coef)) OVER (PARTITION BY fold), 6) AS share FROM c",
    "q_selection_frequency": with_(SWEEP, "b AS (SELECT n_train, c, ROW_NUMBER() OVER (PARTITION BY n_train, gamma ORDER BY eer, c) AS r FROM sweep)") + " SELECT c, COUNT(CASE WHEN r = 1 THEN 1 END) AS selected, COUNT(*) AS candidates FROM b GROUP BY c",
    # joins
    "q_score_assembly_left": with_("a AS (SELECT doc_id, n_chars FROM [documents])", "b AS (SELECT doc_id, quality, toxic FROM [labels])") + " SELECT a.doc_id, n_chars, quality, toxic FROM a LEFT JOIN b ON a.doc_id = b.doc_id",
    "q_inner_equi": "SELECT d.doc_id, d.lang, l.quality FROM [documents] d JOIN [labels] l ON d.doc_id = l.doc_id",
    "q_outer_merge": with_("a AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS s1 FROM [documents])", "b AS (SELECT doc_id, CAST(quality AS DOUBLE) AS s2 FROM [labels])") + " SELECT COALESCE(a.doc_id, b.doc_id) AS doc_id, s1, s2 FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id",
    "q_dictionary_lookup": "SELECT e.event_id, COALESCE(c.c_mktsegment, 'unknown') AS segment FROM [events] e LEFT JOIN [customer] c ON e.user_id = c.c_custkey",
    "q_reindex_align": "SELECT o.vec_id, l.toxic FROM [embeddings] o LEFT JOIN [labels] l ON o.vec_id = l.doc_id",
    "q_semi": "SELECT doc_id, source FROM [documents] d WHERE EXISTS (SELECT 1 FROM [labels] l WHERE l.doc_id = d.doc_id AND l.toxic = 1)",
    "q_anti_missing": "SELECT doc_id FROM [documents] d WHERE NOT EXISTS (SELECT 1 FROM [labels] l WHERE l.doc_id = d.doc_id)",
    "q_self_compare": with_(BASE, "r1 AS (SELECT speaker, AVG(value) AS v FROM base GROUP BY 1)", "r2 AS (SELECT speaker, SUM(value) / COUNT(*) AS v FROM base GROUP BY 1)") + " SELECT MAX(ABS(a.v - b.v)) < 1e-9 AS same, COUNT(*) AS n FROM r1 a JOIN r2 b ON a.speaker = b.speaker",
    "q_both_class_speakers": with_(BASE, "g AS (SELECT speaker FROM base WHERE part = 'hidden' GROUP BY speaker HAVING MAX(y) = 1 AND MIN(y) = 0)", "p AS (SELECT b.speaker, b.filename, b.y, ROW_NUMBER() OVER (PARTITION BY b.speaker, b.y ORDER BY b.filename) AS r FROM base b JOIN g ON b.speaker = g.speaker WHERE part = 'hidden')") + " SELECT speaker, MAX(CASE WHEN y = 1 THEN filename END) AS bonafide, MAX(CASE WHEN y = 0 THEN filename END) AS spoof FROM p WHERE r = 1 GROUP BY speaker",
    "q_coverage_gate": with_("s AS (SELECT d.doc_id, 'n_chars' AS system, CAST(n_chars AS DOUBLE) AS score FROM [documents] d UNION ALL SELECT d.doc_id, 'quality', CAST(l.quality AS DOUBLE) FROM [documents] d LEFT JOIN [labels] l ON d.doc_id = l.doc_id)") + " SELECT system, COUNT(*) AS n FROM s GROUP BY system HAVING COUNT(score) = COUNT(*)",
    "q_config_product": with_("a AS (SELECT DISTINCT o_orderpriority AS p FROM [orders])", "b AS (SELECT DISTINCT r_name AS r FROM [region])") + " SELECT p, r FROM a CROSS JOIN b",
    # P: predicates
    "q_sentinel_exclusion": with_(BASE, "s AS (SELECT part, NULLIF(CASE WHEN y = 1 THEN '-' ELSE event_type END, '-') AS level FROM base)") + " SELECT part, level, COUNT(*) AS n FROM s WHERE level IS NOT NULL GROUP BY part, level",
    "q_prefix_predicate": "SELECT p_brand, COUNT(*) AS n FROM [part] WHERE p_name LIKE 'p%' OR p_type LIKE 'E%' GROUP BY p_brand",
    "q_support_guard": with_(BASE) + " SELECT h, COUNT(*) AS n FROM base WHERE n_frames <= 25 GROUP BY h HAVING COUNT(*) > 50 AND SUM(y) > 0 AND SUM(1 - y) > 0",
    "q_first_n": "SELECT event_id, user_id FROM [events] ORDER BY event_id LIMIT 100",
    # sets
    "q_union_enriched": "SELECT doc_id AS id, source, 'documents' AS origin FROM [documents] UNION ALL SELECT page_id AS id, CAST(NULL AS {{TXT}}) AS source, 'pages' AS origin FROM [pages]",
    "q_leakage_intersect": with_(BASE) + " SELECT COUNT(*) AS n_shared FROM (SELECT speaker FROM base WHERE part = 'eval' INTERSECT SELECT speaker FROM base WHERE part = 'hidden') x",
    "q_missing_except": "SELECT c_custkey FROM [customer] EXCEPT SELECT o_custkey AS c_custkey FROM [orders] WHERE o_orderpriority = '1-URGENT'",
    "q_distinct_splits": with_(BASE) + " SELECT DISTINCT part, y FROM base",
    "q_first_seen_codes": with_("f AS (SELECT event_type, MIN(event_id) AS pos FROM [events] GROUP BY event_type)") + " SELECT event_type, CAST(ROW_NUMBER() OVER (ORDER BY pos) - 1 AS BIGINT) AS code FROM f",
    # Windows and sorts
    "q_group_mean": "SELECT source, ROUND(AVG(n_chars), 9) AS mean_chars, COUNT(*) AS n FROM [documents] GROUP BY source",
    "q_adjacent_change": with_("w AS (SELECT CAST(day(ts) AS INT) AS d, COUNT(*) AS n FROM [events] GROUP BY 1)") + " SELECT d, n, n >= COALESCE(LAG(n) OVER (ORDER BY d), n) AS rises FROM w",
    "q_topk": "SELECT o_orderkey, o_totalprice FROM [orders] ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "q_one_se_select": with_(BASE, "f AS (SELECT system, speaker % 5 AS fold, AVG(score) AS v FROM trials GROUP BY 1, 2)", "cv AS (SELECT system, CASE system WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END AS n_systems, AVG(v) AS cv_eer, STDDEV_SAMP(v) / SQRT(COUNT(v)) AS se FROM f GROUP BY system)", "b AS (SELECT cv_eer + se AS lim FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY cv_eer, system) AS r FROM cv) x WHERE r = 1)", "c AS (SELECT cv.*, ROW_NUMBER() OVER (ORDER BY n_systems, cv_eer) AS r FROM cv CROSS JOIN b WHERE cv_eer <= lim)") + " SELECT system, n_systems, ROUND(cv_eer, 6) AS cv_eer FROM c WHERE r = 1",
    # R: sampling, resampling
    "q_frame_quota": with_("t AS (SELECT l_orderkey, l_linenumber, l_partkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {{U32:concat({{STR:l_orderkey}}, ':', {{STR:l_linenumber}}, ':', {{STR:l_partkey}})}}, l_linenumber, l_partkey, l_suppkey) AS r FROM [lineitem])") + " SELECT l_orderkey, COUNT(*) AS kept, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM t WHERE r <= 4 GROUP BY l_orderkey",
    "q_quota_realised": with_("t AS (SELECT l_orderkey, CAST(LEAST(COUNT(*), 4) AS BIGINT) AS kept FROM [lineitem] GROUP BY 1)") + " SELECT ROUND(CAST(SUM(kept) AS DOUBLE) / (COUNT(*) * 4), 9) AS realised FROM t",
    "q_dose_sample": "SELECT doc_id, CASE WHEN " + unit("concat({{STR:doc_id}}, ':dose')") + " < 0.4 THEN 'clean' ELSE concat('aug', {{STR:CAST(FLOOR(3 * " + unit("concat({{STR:doc_id}}, ':copy')") + ") AS INT) + 1}}) END AS copy_ FROM [documents]",
    "q_random_check": "SELECT doc_id FROM [documents] ORDER BY {{U32:concat({{STR:doc_id}}, ':check')}}, doc_id LIMIT 200",
}

TEXT |= {
    # L: fusion
    "q_znorm": with_(BASE, "st AS (SELECT system, AVG(score) AS mu, CASE WHEN STDDEV_POP(score) = 0 THEN CAST(1 AS DOUBLE) ELSE STDDEV_POP(score) END AS sd FROM trials WHERE part = 'progress' GROUP BY system)") + " SELECT filename, t.system, ROUND((score - mu) / sd, 6) AS z FROM trials t JOIN st ON st.system = t.system WHERE part = 'eval'",
    "q_equal_fusion": with_(BASE, "st AS (SELECT system, AVG(score) AS mu, STDDEV_POP(score) AS sd FROM trials WHERE part = 'progress' GROUP BY system)", "fz AS (SELECT filename, y, 1 AS g, ROUND(AVG((score - mu) / sd), 6) AS score FROM trials t JOIN st ON st.system = t.system WHERE part = 'eval' AND t.system <> 'C' GROUP BY filename, y)", curve_sql("fz", "g"), eer_sql("curve", "g")) + " SELECT eer, threshold, nb + ns AS n FROM eer",
    "q_fitnorm_vs_applynorm": with_(BASE, "st AS (SELECT part, system, AVG(score) AS mu, STDDEV_POP(score) AS sd FROM trials GROUP BY 1, 2)", "fz AS (SELECT CASE st.part WHEN 'progress' THEN 'fit' ELSE 'apply' END AS norm, filename, y, ROUND(AVG((score - mu) / sd), 6) AS score FROM trials t JOIN st ON st.system = t.system AND st.part IN ('progress', 'eval') WHERE t.part = 'eval' GROUP BY 1, 2, 3)", curve_sql("fz", "norm"), eer_sql("curve", "norm")) + " SELECT norm, eer, threshold FROM eer",
    "q_topk_mean_fusion": with_(BASE, EV, *EER, "top AS (SELECT system FROM (SELECT system, ROW_NUMBER() OVER (ORDER BY eer, system) AS r FROM eer) x WHERE r <= 2)", "st AS (SELECT system, AVG(score) AS mu, STDDEV_POP(score) AS sd FROM ev GROUP BY system)", "fz AS (SELECT 1 AS g, filename, y, ROUND(AVG((score - mu) / sd), 6) AS score FROM ev JOIN st ON st.system = ev.system WHERE ev.system IN (SELECT system FROM top) GROUP BY filename, y)", curve_sql("fz", "g", "fc"), eer_sql("fc", "g", "fe")) + " SELECT eer, threshold FROM fe",
    # N: narrative analyses
    "q_rescue_ratio": with_(BASE, EV, *EER, "ok AS (SELECT ev.filename, ev.system, CASE WHEN (score >= threshold AND y = 1) OR (score < threshold AND y = 0) THEN 1 ELSE 0 END AS good FROM ev JOIN eer ON eer.system = ev.system)") + " SELECT a.system AS s1, b.system AS s2, ROUND(AVG(CASE WHEN a.good = 0 THEN CAST(b.good AS DOUBLE) END), 9) AS rescue, ROUND(AVG(CASE WHEN a.good = 0 THEN CAST(b.good AS DOUBLE) END) / (1 - MAX(e.eer)), 9) AS ratio FROM ok a JOIN ok b ON a.filename = b.filename AND a.system <> b.system JOIN eer e ON e.system = b.system GROUP BY 1, 2",
    "q_padding_fraction": with_(BASE, "ts AS (SELECT 20 * (r_regionkey + 1) AS t FROM [region])") + " SELECT t, ROUND(AVG(CASE WHEN y = 1 THEN CASE WHEN n_frames < t THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END), 9) AS bonafide, ROUND(AVG(CASE WHEN y = 0 THEN CASE WHEN n_frames < t THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END), 9) AS spoof FROM base CROSS JOIN ts GROUP BY t",
    "q_class_separation": with_(BASE) + " SELECT system, ROUND(ABS(AVG(CASE WHEN y = 1 THEN score END) - AVG(CASE WHEN y = 0 THEN score END)) / SQRT((VAR_SAMP(CASE WHEN y = 1 THEN score END) * (SUM(y) - 1) + VAR_SAMP(CASE WHEN y = 0 THEN score END) * (SUM(1 - y) - 1)) / (COUNT(*) - 2)), 6) AS separation FROM trials GROUP BY system",
    "q_scale_drift": with_(BASE, "st AS (SELECT part, system, AVG(score) AS mu, STDDEV_POP(score) AS sd FROM trials GROUP BY 1, 2)") + " SELECT a.system, b.part, ROUND(b.mu - a.mu, 6) AS shift, ROUND(b.sd / a.sd, 6) AS sd_ratio FROM st a JOIN st b ON a.system = b.system WHERE a.part = 'eval' AND b.part <> 'eval'",
    "q_level_groups": with_(BASE, EV, curve_sql("ev", "system, h"), eer_sql("curve", "system, h")) + " SELECT system, CASE WHEN h < 8 THEN 'night' WHEN h < 16 THEN 'day' ELSE 'evening' END AS grp, ROUND(AVG(eer), 9) AS mean, ROUND(MAX(eer) - MIN(eer), 9) AS spread FROM eer GROUP BY 1, 2",
    "q_mechanical_share": with_(BASE, "sc AS (SELECT 'all' AS arm, * FROM trials WHERE part = 'progress' UNION ALL SELECT 'short' AS arm, * FROM trials WHERE part = 'progress' AND n_frames <= 50 UNION ALL SELECT 'target' AS arm, * FROM trials WHERE part = 'eval')", curve_sql("sc", "arm, system"), eer_sql("curve", "arm, system")) + " SELECT a.system, ROUND(CASE WHEN t.eer = a.eer THEN NULL ELSE (s.eer - a.eer) / (t.eer - a.eer) END, 6) AS share FROM eer a JOIN eer s ON s.system = a.system JOIN eer t ON t.system = a.system WHERE a.arm = 'all' AND s.arm = 'short' AND t.arm = 'target'",
    "q_parabola_vertex": with_(SWEEP, "m AS (SELECT c, AVG(eer) AS e FROM sweep GROUP BY c)", "p AS (SELECT CAST(c AS DOUBLE) AS x2, e AS y2, LAG(CAST(c AS DOUBLE)) OVER (ORDER BY c) AS x1, LAG(e) OVER (ORDER BY c) AS y1, LEAD(CAST(c AS DOUBLE)) OVER (ORDER BY c) AS x3, LEAD(e) OVER (ORDER BY c) AS y3 FROM m)") + " SELECT ROUND(x2 - 0.5 * ((x2 - x1) * (x2 - x1) * (y2 - y3) - (x2 - x3) * (x2 - x3) * (y2 - y1)) / NULLIF((x2 - x1) * (y2 - y3) - (x2 - x3) * (y2 - y1), 0), 4) AS vertex FROM p WHERE x1 IS NOT NULL AND x3 IS NOT NULL",
    # S, K, F, G: parsing, writing, completeness
    "q_path_lookup": with_("f AS (SELECT page_id, url, {{AT:split(url, '/')|3}} AS lang FROM [pages])") + " SELECT page_id, lang, regexp_replace(url, '^.*/', '') AS stem FROM f",
    "q_zero_padded": "SELECT c_custkey, {{PAD:c_custkey}} AS code FROM [customer]",
    "q_failure_split": with_("e AS (SELECT event_id, CASE WHEN value > 200 THEN 'too large' WHEN value < 0.5 THEN 'too small' END AS error FROM [events])") + " SELECT error IS NULL AS ok, COALESCE(error, '-') AS reason, COUNT(*) AS n FROM e GROUP BY 1, 2",
    "q_completeness": with_("c AS (SELECT CAST(FLOOR(event_id / CAST(4000 AS DOUBLE)) AS BIGINT) AS chunk, COUNT(*) AS n FROM [events] GROUP BY 1)", "t AS (SELECT COUNT(*) AS total FROM [events])") + " SELECT chunk, n, n = LEAST(4000, total - 4000 * chunk) AS complete FROM c CROSS JOIN t",
    "q_circuit_breaker": "SELECT COUNT(CASE WHEN value > 200 THEN 1 END) AS failures, COUNT(CASE WHEN value > 200 THEN 1 END) > GREATEST(5, 0.01 * COUNT(*)) AS abort FROM [events]",
    "q_resume_anti": "SELECT e.event_id FROM [events] e LEFT JOIN [labels] l ON l.doc_id = e.event_id WHERE l.doc_id IS NULL",
    "q_fallback_clean": "SELECT d.doc_id, COALESCE(l.toxic, 0) AS toxic, l.toxic IS NULL AS fell_back FROM [documents] d LEFT JOIN [labels] l ON l.doc_id = d.doc_id",
    "q_legacy_union": with_(SWEEP) + " SELECT n_train, c, gamma, eer FROM sweep UNION ALL SELECT 50000 AS n_train, CAST(r_regionkey AS INT) AS c, 'legacy' AS gamma, CAST(0.5 AS DOUBLE) AS eer FROM [region]",
    "q_class_weights": with_(BASE) + " SELECT y, ROUND(CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / (2 * COUNT(*)), 9) AS weight FROM base GROUP BY y",
    "q_tiling_factor": with_(BASE) + " SELECT filename, CAST(CEIL(CAST(400 AS DOUBLE) / GREATEST(n_frames, 1)) AS BIGINT) AS tiles, n_frames * CAST(0.016 AS DOUBLE) AS seconds FROM base",
}
TEXT["q_leaderboard_rank"] = with_(BASE, curve_sql("trials", "part, system"), eer_sql("curve", "part, system")) + " SELECT a.system, COUNT(CASE WHEN b.eer < a.eer THEN 1 END) + 1 AS place, COUNT(*) + 1 AS of_ FROM eer a CROSS JOIN eer b WHERE a.part = 'eval' AND b.part <> 'eval' GROUP BY a.system"

QUERIES = {k: spark(v) for k, v in TEXT.items()}
ORACLE_SQL = {k: duckdb(v) for k, v in TEXT.items()}
