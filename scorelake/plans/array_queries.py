"""Array and mixture operators (D02, D04-D11, D14, D17-D19, L15-L17, W03) as one SQL text for both engines. Vectors come from embeddings."""

from __future__ import annotations

from .metric_queries import with_
from .sql import duckdb, spark

V = "vecs AS (SELECT vec_id, label, {{MAP:embedding|v|cast(v as double)}} AS x FROM [embeddings])"
FRAMES = "frames AS (SELECT vec_id, label, n, {{AT:x|n}} AS v FROM (SELECT vec_id, label, x, {{EXPL:{{SEQ:64}}}} AS n FROM vecs) z)"


def listed(expr: str, n: int, *before: str) -> str:
    """Rows (vec_id, i, v) of an array expression of n entries, rounded."""
    return with_(V, *before, f"y AS (SELECT vec_id, {expr} AS a FROM {'st' if before else 'vecs'})", f"z AS (SELECT vec_id, a, {{{{EXPL:{{{{SEQ:{n}}}}}}}}} AS i FROM y)") + " SELECT vec_id, CAST(i AS INT) AS i, ROUND({{AT:a|i}}, 6) + CAST(0 AS DOUBLE) AS v FROM z"


STATS = "st0 AS (SELECT vec_id, x, {{SUM:x}} / 64 AS mu FROM vecs), st AS (SELECT vec_id, x, mu, SQRT({{SUM:{{MAP:x|v|(v - mu) * (v - mu)}}}} / 64) AS sd FROM st0)"
#: Parts of vectors of 20 to 64 entries, and how often each has to be repeated to reach 48.
PARTS = "pt AS (SELECT vec_id, {{CUT:x|0|CAST(20 + vec_id % 45 AS INT)}} AS y, CAST(20 + vec_id % 45 AS INT) AS len_ FROM vecs), st AS (SELECT vec_id, y, len_, CAST(CEIL(CAST(48 AS DOUBLE) / len_) AS INT) AS times FROM pt)"
#: Two masks of bins and two of frames, of up to 2 of 8 each.
MASKS = ", ".join(f"{{{{U32:concat({{{{STR:vec_id}}}}, ':{a}0')}}}} % 7 AS {a}0, {{{{U32:concat({{{{STR:vec_id}}}}, ':{a}w')}}}} % 3 AS {a}w" for a in ("fa", "fb", "ta", "tb"))
#: A mixture of four diagonal components around the first four vectors, and its densities.
MIX = f"""{FRAMES}, comp AS (SELECT vec_id AS k, n, v AS m FROM frames WHERE vec_id < 4),
lp AS (SELECT f.vec_id, c.k, LN(CAST(0.25 AS DOUBLE)) - 32 * LN(2 * PI() * CAST(0.05 AS DOUBLE)) - SUM((f.v - c.m) * (f.v - c.m)) / (2 * CAST(0.05 AS DOUBLE)) AS l FROM frames f JOIN comp c ON f.n = c.n GROUP BY f.vec_id, c.k),
mx AS (SELECT vec_id, MAX(l) AS top FROM lp GROUP BY vec_id),
ll AS (SELECT lp.vec_id, MAX(top) + LN(SUM(EXP(l - top))) AS ll FROM lp JOIN mx ON mx.vec_id = lp.vec_id GROUP BY lp.vec_id)"""
TEXT = {
    "q_tile_crop": listed("{{CUT:{{TILE:x|2}}|14|100}}", 100),
    "q_centre_crop": listed("{{CUT:x|16|32}}", 32),
    "q_unit_norm": listed("{{MAP:x|v|v / 255}}", 64),
    "q_cmvn": listed("{{MAP:x|v|(v - mu) / (sd + 1e-5)}}", 64, STATS),
    "q_quantise": listed("{{MAP:x|v|LEAST(GREATEST({{RINT:(v * 100 - 40 + 80) / 80 * 255}}, cast(0 as double)), cast(255 as double))}}", 64),
    "q_dequantise": listed("{{MAP:x|v|LEAST(GREATEST({{RINT:(v * 100 - 40 + 80) / 80 * 255}}, cast(0 as double)), cast(255 as double)) / 255 * 80 - 80}}", 64),
    "q_pad_truncate": listed("{{CUT:{{CAT:y|{{ZEROS:48}}}}|0|48}}", 48, PARTS),
    "q_fit_length": listed("{{CUT:{{TILE:y|CAST(times AS INT)}}|CAST((len_ * times - 48 - (len_ * times - 48) % 2) / 2 AS INT)|48}}", 48, PARTS),
    "q_random_crop": listed("{{CUT:{{TILE:y|CAST(times AS INT)}}|CAST({{U32:concat({{STR:vec_id}}, ':crop')}} % (len_ * times - 47) AS INT)|48}}", 48, PARTS),
    "q_display_zscore": listed("{{MAP:x|v|(v - mu) / (sd + 1e-8)}}", 64, STATS),
    "q_soft_clip": listed("{{MAP:x|v|(EXP(6 * v) - 1) / (EXP(6 * v) + 1)}}", 64),
    "q_hard_clip": listed("{{MAP:x|v|LEAST(GREATEST(v, cast(-0.1 as double)), cast(0.1 as double))}}", 64),
    "q_specaugment_mask": with_(V, FRAMES, f"m AS (SELECT vec_id, {MASKS} FROM vecs)") + " SELECT f.vec_id, CAST(n AS INT) AS i, ROUND(CASE WHEN " + " OR ".join(f"({axis} >= {a}0 AND {axis} < {a}0 + {a}w)" for axis, a in (("n % 8", "fa"), ("n % 8", "fb"), ("(n - n % 8) / 8", "ta"), ("(n - n % 8) / 8", "tb"))) + " THEN cast(0 as double) ELSE v END, 6) AS v FROM frames f JOIN m ON m.vec_id = f.vec_id",
    "q_dct2": with_(V, FRAMES, "ks AS (SELECT DISTINCT n AS k FROM frames WHERE n < 20)") + " SELECT vec_id, CAST(k AS INT) AS k, ROUND(SUM(v * COS(PI() / 64 * (n + 0.5) * k)) * CASE WHEN k = 0 THEN SQRT(CAST(1 AS DOUBLE) / 64) ELSE SQRT(CAST(2 AS DOUBLE) / 64) END, 6) AS c FROM frames CROSS JOIN ks GROUP BY vec_id, k",
    "q_deltas": with_(V, FRAMES, "w AS (SELECT vec_id, n, v, FIRST_VALUE(v) OVER (PARTITION BY vec_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v0, LAST_VALUE(v) OVER (PARTITION BY vec_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v9, " + ", ".join(f"LAG(v, {k}) OVER (PARTITION BY vec_id ORDER BY n) AS b{k}, LEAD(v, {k}) OVER (PARTITION BY vec_id ORDER BY n) AS a{k}" for k in (1, 2, 3, 4)) + " FROM frames)") + " SELECT vec_id, CAST(n AS INT) AS i, ROUND((" + " + ".join(f"{k} * (COALESCE(a{k}, v9) - COALESCE(b{k}, v0))" for k in (1, 2, 3, 4)) + ") / 60, 6) + CAST(0 AS DOUBLE) AS d FROM w",
    # the vectors' squares as 64 bins of power up to 8 kHz, through 20 triangles of equal width
    "q_linear_filterbank": with_(V, FRAMES, "hz AS (SELECT vec_id, n, v * v AS power, n * CAST(8000 AS DOUBLE) / 63 AS hz FROM frames)", "banks AS (SELECT DISTINCT n AS m, (n + 1) * CAST(8000 AS DOUBLE) / 21 AS mid, CAST(8000 AS DOUBLE) / 21 AS wid FROM frames WHERE n < 20)")
    + " SELECT vec_id, CAST(m AS INT) AS m, COUNT(*) AS bins, ROUND(SUM((1 - ABS(hz - mid) / wid) * power), 6) AS energy FROM hz JOIN banks ON hz > mid - wid AND hz < mid + wid GROUP BY vec_id, m",
    "q_frame_explode": with_(V, FRAMES) + " SELECT vec_id, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_POP(v), 6) AS sd FROM frames GROUP BY vec_id",
    "q_gmm_logdensity": with_(V, MIX) + " SELECT vec_id, ROUND(ll, 5) AS ll FROM ll",
    "q_gmm_em_step": with_(V, MIX, "g AS (SELECT lp.vec_id, lp.k, EXP(l - ll) AS r FROM lp JOIN ll ON ll.vec_id = lp.vec_id)", "s AS (SELECT g.k, f.n, SUM(r) AS nk, SUM(r * v) AS sk, SUM(r * v * v) AS tk FROM g JOIN frames f ON f.vec_id = g.vec_id GROUP BY g.k, f.n)") + " SELECT k, CAST(n AS INT) AS n, ROUND(nk, 5) AS nk, ROUND(sk / nk, 6) AS mean, ROUND(GREATEST(tk / nk - (sk / nk) * (sk / nk), cast(0 as double)) + 1e-6, 6) AS var FROM s",
}

QUERIES = {k: spark(v) for k, v in TEXT.items()}
ORACLE_SQL = {k: duckdb(v) for k, v in TEXT.items()}
