"""Queries against the oracle SQL, sources and sinks, models and resumable batches."""

import duckdb
import numpy as np
import pytest
from scorelake.operators import dsp, mixtures
from scorelake.plans import registry
from scorelake.plans.sql import TABLES
from scorelake.sources import text
from scorelake.streaming import batches
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_match_the_oracle(spark, con, name):
    df, rel = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
    assert normal([tuple(r[c] for c in cols) for r in df.collect()]) == normal(want)


def test_every_oracle_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.ORACLE_SQL) > 120


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "enrol.txt").write_text("PA_0073_aaa PA_D_A000001,PA_D_A000002\n\nPA_0074_bbb f3\n")
    rows = text.enrolment(spark, str(tmp_path / "enrol.txt")).collect()
    assert [(r.speaker_id, r.env_id, r.filename) for r in rows] == [("PA_0073", "aaa", "PA_D_A000001"), ("PA_0073", "aaa", "PA_D_A000002"), ("PA_0074", "bbb", "f3")]
    (tmp_path / "s.txt").write_text("a 1.5  \nb\t-2\n\n")
    scores = text.scores(spark, str(tmp_path / "s.txt"))
    text.write_scores(scores, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a 1.500000", "b -2.000000"]
    (tmp_path / "twice.txt").write_text("a 1\na 2\n")
    with pytest.raises(ValueError):
        text.scores(spark, str(tmp_path / "twice.txt"))
    (tmp_path / "l.txt").write_text("x\ny\n")
    (tmp_path / "r.txt").write_text("1\n2\n")
    assert sorted((r.left, r.right) for r in text.zipped(spark, str(tmp_path / "l.txt"), str(tmp_path / "r.txt")).collect()) == [("x", "1"), ("y", "2")]
    for d in ("p1", "p2"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.wav").write_text("RIFF")
    found = text.paths(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert found.first().path.endswith("p2/f.wav")
    with pytest.raises(FileNotFoundError):
        text.with_paths(spark.createDataFrame([("g",)], "filename string"), found)


def test_resumable_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).withColumnRenamed("id", "filename").repartition(4).write.parquet(src)
    score = lambda df: df.withColumn("score", F.col("filename") * 2.0).withColumn("error", F.when(F.col("filename") == 7, "bad"))
    args = (spark, src, "filename long", score, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert batches.run_available(*args, files_per_batch=2) == 99
    assert batches.run_available(*args) == 0
    spark.range(100, 110).withColumnRenamed("id", "filename").write.mode("append").parquet(src)
    assert batches.run_available(*args) == 10
    done = spark.read.parquet(str(tmp_path / "out/scored"))
    assert done.count() == 109 and [r.filename for r in batches.missing(spark.read.parquet(src), done).collect()] == [7]
    worse = lambda df: df.withColumn("error", F.lit("bad"))
    with pytest.raises(Exception, match="failed"):
        batches.run_available(spark, src, "filename long", worse, str(tmp_path / "o2"), str(tmp_path / "c2"))


def test_mixture_is_exact_and_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(-2, 1, (150, 3)), r.normal(2, 0.5, (150, 3))])
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>")
    a, ha = mixtures.fit(df.repartition(1), 2, 20)
    b, hb = mixtures.fit(df.repartition(5), 2, 20)
    assert np.allclose(a.means, b.means) and np.allclose(ha, hb) and all(q >= p - 1e-9 for p, q in zip(ha, ha[1:]))
    assert sorted(a.means[:, 0].round()) == [-2, 2]
    direct = np.log(sum(w * np.exp(-0.5 * ((x - m) ** 2 / v + np.log(2 * np.pi * v)).sum(1)) for w, m, v in zip(a.weights, a.means, a.variances)))
    assert np.allclose(a.log_density(x), direct)


def test_kernels(spark):
    d = dsp.dct(4, 4) @ np.array([1.0, 2, 3, 4])
    assert np.allclose(d, [5, -2.2304425, 0, -0.15851267])
    t = np.sin(2 * np.pi * 440 * np.arange(8000) / dsp.RATE)
    assert dsp.mfcc_pooled(t).shape == (120,) and dsp.lfcc(t).shape[1] == 60
    q = dsp.cqt_uint8(t)
    assert abs(int(q.mean(1).argmax()) - round(12 * np.log2(440 / 32.7))) <= 1 and q.max() == 255
    assert np.abs(dsp.augmented(t, 3)).max() <= 1 and np.array_equal(dsp.augmented(t, 3), dsp.augmented(t, 3))
    rows = dsp.pooled(spark.createDataFrame([("a", t.tolist()), ("b", None)], "filename string, y array<double>"), "mfcc").collect()
    assert [(len(r.x) if r.x else None, r.error is None) for r in sorted(rows)] == [(120, True), (None, False)]
