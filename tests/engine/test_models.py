"""Signals, mixtures, classical models, fusion and bootstrap against written-out definitions and small cases."""

import io
import struct
import wave

import numpy as np
import pytest
from scorelake import __main__ as cli
from scorelake.operators import bootstrap, classical, dsp, fusion, metrics, mixtures
from scorelake.plans import bootstrap_queries
from scorelake.sources import files
from scorelake.streaming import batches
from pyspark.sql import functions as F


def test_deltas_are_derivatives_of_fitted_polynomials():
    t = np.arange(30.0)
    c = np.stack([3 * t + 1, t**2, np.sin(t)], 1)
    d, dd = dsp.deltas(c), dsp.deltas(c, order=2)
    assert np.allclose(d[:, 0], 3) and np.allclose(dd[:, 0], 0) and np.allclose(dd[:, 1], 2) and np.allclose(d[4:-4, 1], 2 * t[4:-4])
    n = np.arange(-4, 5)
    for i in (4, 15, 25):
        slope, curve = np.polyfit(n, c[i - 4 : i + 5, 2], 1)[0], 2 * np.polyfit(n, c[i - 4 : i + 5, 2], 2)[0]
        assert (d[i, 2], dd[i, 2]) == pytest.approx((slope, curve))
    assert np.allclose(d[:4], d[4]) and np.allclose(dd[-4:], dd[-5])
    assert not dsp.deltas(c[:2]).any() and dsp.deltas(c[:4]).shape == (4, 3)


def test_mel_bank_by_its_definition():
    bank = dsp.mel_bank()
    assert bank.shape == (128, 257)
    to_hz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    top = 15 + 27 * np.log(8) / np.log(6.4)
    edges = [to_hz(top * i / 129) for i in range(130)]
    for k in (0, 20, 60, 127):
        lo, mid, hi = edges[k : k + 3]
        for b in range(257):
            f = b * dsp.RATE / dsp.FFT
            want = max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo)
            assert bank[k, b] == pytest.approx(want, abs=1e-12)


def test_cepstra_of_a_record():
    r = np.random.default_rng(3).integers(0, 256, 8 * 12)
    out = dsp.cq_cepstra(r, 8, 5)
    db = r.reshape(8, 12) / 255 * 80 - 80
    k, b = np.arange(5)[:, None], np.arange(8)[None, :]
    basis = np.cos(np.pi / 8 * (b + 0.5) * k) * np.where(k == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
    assert out.shape == (12, 15) and np.allclose(out[:, :5], (basis @ db).T)
    assert len(dsp.cq_kernels(90, 12, 32.7)[0]) > 8192


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    y = np.arange(240) % 3 == 0
    x = r.normal(0, 1, (240, 4)) * [1, 100, 1, 1] + np.where(y, 1.5, 0)[:, None] * [1, 100, 0, 0]
    return spark.createDataFrame([(i, a.tolist(), int(b), i % 4 == 0) for i, (a, b) in enumerate(zip(x, y))], "filename long, x array<double>, y int, held boolean")


def auc(scored):
    return metrics.auc_of(metrics.error_curve(scored.withColumn("g", F.lit(1)), ["g"]), ["g"]).first().roc_auc


def test_classical_models(spark, rows):
    train, test = rows.where("not held"), rows.where("held")
    (z,) = classical.standardised(train)
    z = np.array([r.x for r in z.collect()])
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0), 1)
    assert auc(classical.fourier_svm_scores(train, test, gamma=0.1)) > 0.85
    model = classical.forest(train, trees=40)
    assert auc(classical.forest_scores(model, test)) > 0.85 and model.getMaxDepth() == 30
    b = [r.importance for r in classical.block_importance(spark, model, 2, 2).orderBy("block").collect()]
    assert sum(b) == pytest.approx(1) and b[0] > b[1]


def test_stored_mixtures(spark, tmp_path):
    m = mixtures.DiagonalMixture(np.array([0.3, 0.7]), np.array([[0.0, 1], [2, 3]]), np.array([[1.0, 2], [3, 4]]))
    mixtures.save(spark, m, str(tmp_path / "m"), kind="bona", dims="2")
    n, meta = mixtures.load(spark, str(tmp_path / "m"))
    assert meta == {"kind": "bona", "dims": "2"} and all(np.array_equal(getattr(m, k), getattr(n, k)) for k in ("weights", "means", "variances"))


def naive(rows, weight):
    """Equal error rate and least cost over weighted rows (score, y, unit), by the definition."""
    c0, c1, c2 = 0.06713, 0.87337, 0.45276
    nb, ns = (sum(weight(u) for _, y, u in rows if y == k) for k in (1, 0))
    if not nb or not ns:
        return None
    best, cost = None, None
    for t in sorted({s for s, _, _ in rows}, reverse=True):
        tp, fp = (sum(weight(u) for s, y, u in rows if y == k and s >= t) for k in (1, 0))
        miss, false = (nb - tp) / nb, fp / ns
        gap = abs((nb - tp) * ns - fp * nb)
        if best is None or gap < best[0]:
            best = (gap, (miss + false) / 2)
        c = (c0 + c1 * miss + c2 * false) / (c0 + min(c1, c2))
        cost = c if cost is None else min(cost, c)
    return best[1], cost


@pytest.mark.parametrize("stratified", [True, False])
def test_bootstrap_matches_naive_resampling(spark, stratified, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(g, int(r.integers(0, 7)), int(r.integers(0, 2)), float(r.integers(0, 12)) + (g == "b") * 0.5, i) for i, g in enumerate(["a", "b"] * 60)]
    t = spark.createDataFrame(rows, "system string, speaker long, y int, score double, filename long")
    monkeypatch.setattr(bootstrap, "CELLS", 64)
    monkeypatch.setattr(bootstrap, "CHUNK", 7)
    got = {(x.system, x.rep): (x.eer, x.min_tdcf) for x in bootstrap.replicate_metrics(t, ["system"], 15, stratified=stratified, cost=(0.06713, 0.87337, 0.45276)).collect()}
    speakers = {y: sorted({s for _, s, v, _, _ in rows if v == y or not stratified}) for y in (1, 0)}
    for rep in range(15):
        w = {}
        for y, salt in ((1, 0), (0, 1 if stratified else 0)):
            counts = bootstrap.draw_counts([rep], len(speakers[y]), salt)[0]
            w.update({(y, s): int(n) for s, n in zip(speakers[y], counts)})
        for g in "ab":
            want = naive([(s, y, (y, spk)) for system, spk, y, s, _ in rows if system == g], w.get)
            assert (want is None) == ((g, rep) not in got)
            assert want is None or got[g, rep] == pytest.approx(want, abs=1e-12)
    trial = {(x.system, x.rep): (x.eer, x.min_tdcf) for x in bootstrap.replicate_metrics(t, ["system"], 5, "trial", cost=(0.06713, 0.87337, 0.45276)).collect()}
    for rep in range(5):
        for g in "ab":
            own = [(s, y, i) for system, _, y, s, i in rows if system == g]
            w = dict(zip([i for *_, i in own], bootstrap.poisson([rep], [i for *_, i in own])[0].tolist()))
            assert trial[g, rep] == pytest.approx(naive(own, w.get), abs=1e-12)


def test_poisson_weights():
    w = bootstrap.poisson(range(50), np.arange(4000))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03


def test_poisson_weights_are_those_of_the_plain_hash():
    units = np.concatenate([np.arange(3000), [2**31 - 1, 2**32 - 1, 10**12]])
    u = (bootstrap.mixed(np.arange(9)[:, None], units[None, :], 77) + 0.5) / 2.0**32
    assert np.array_equal(bootstrap.poisson(range(9), units), np.searchsorted(bootstrap.POISSON, u, side="right"))
    assert (bootstrap.BY_HALF == 255).sum() <= 16


def test_slices_that_no_replicate_needs_are_not_read(spark, monkeypatch):
    """Scores that part the classes: nearly all replicates settle at the edges of two slices, and the values stay the plain ones."""
    read = []
    dealt = bootstrap.joined
    monkeypatch.setattr(bootstrap, "joined", lambda rows, needed, by: read.append(needed.count()) or dealt(rows, needed, by))
    monkeypatch.setattr(bootstrap, "SLICE_ROWS", 10)
    rows = [(i % 9, int(i >= 190 + i % 20), float(i), i) for i in range(400)]
    t = spark.createDataFrame(rows, "speaker long, y int, score double, filename long").withColumn("system", F.lit("a"))
    got = bootstrap.replicate_metrics(t, ["system"], 6, "trial", cost=(0.06713, 0.87337, 0.45276)).collect()
    for r in got:
        w = dict(enumerate(bootstrap.poisson([r.rep], np.arange(400))[0].tolist()))
        assert (r.eer, r.min_tdcf) == pytest.approx(naive([(s, y, i) for _, y, s, i in rows], w.get), abs=1e-12)
    assert len(got) == 6 and read and max(read) <= 10  # of 40


def test_draws_are_made_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "PIECE", 7)
    got = {(r.rep, r.stratum, r.unit): r.w for r in bootstrap.draw_table(spark, 3, [23, 5, 0]).collect()}
    want = {(r, s, u): int(w) for s, n in enumerate((23, 5)) for r in range(3) for u, w in enumerate(bootstrap.draw_counts([r], n, s)[0]) if w}
    assert got == want


def test_wav_markdown_and_command_line(spark, tmp_path, capsys):
    body = io.BytesIO()
    with wave.open(body, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(struct.pack("<6h", 0, 16384, -32768, -32768, 100, 300))
    (tmp_path / "a.wav").write_bytes(body.getvalue())
    (tmp_path / "b.wav").write_bytes(b"RIFF nonsense")
    a, b = files.wav(spark, str(tmp_path)).orderBy("path").collect()
    assert a.rate == 8000 and a.samples == pytest.approx([0.25, -1, 200 / 32768]) and a.error is None
    assert b.samples is None and b.error
    text = files.markdown(spark.createDataFrame([("a|b", 0.123456, None)], "name string, eer double, note string"), "Results")
    assert text.splitlines()[2:] == ["| name | eer | note |", "| --- | --- | --- |", "| a\\|b | 0.1235 |  |"]
    cli.main([])
    assert "q_system_table" in capsys.readouterr().out
    cli.main(["q_system_eer", "--data", "/root/testdata/sf0.001", "--markdown"])
    assert "| system |" in capsys.readouterr().out


def test_incomplete_batches_write_nothing_and_failures_can_be_accepted(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(20).withColumnRenamed("id", "filename").coalesce(1).write.parquet(src)
    short = lambda df: df.where("filename < 5").withColumn("error", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="rows"):
        batches.run_available(spark, src, "filename long", short, str(tmp_path / "o"), str(tmp_path / "c"))
    assert not (tmp_path / "o").exists()
    bad = lambda df: df.withColumn("error", F.lit("bad"))
    assert batches.run_available(spark, src, "filename long", bad, str(tmp_path / "o2"), str(tmp_path / "c2"), accept_failures=True) == 0
    assert spark.read.parquet(str(tmp_path / "o2/failed")).count() == 20


def test_weights_and_speakers_do_not_pass_the_driver(spark, monkeypatch):
    """A large table of speakers was broadcast, and the weights were made on the driver (q_bootstrap_naive_check)."""
    rows = [(i % 9, int(i % 3 == 0), float(i % 17), i, "a") for i in range(200)]
    t = spark.createDataFrame(rows, "speaker long, y int, score double, filename long, system string")
    want = {r.rep: r.eer for r in bootstrap.replicate_metrics(t, ["system"], 4).collect()}
    monkeypatch.setattr(bootstrap, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: pytest.fail("sent by the driver"))
    numbered, sizes = bootstrap.numbered_speakers(t, True)
    assert "Broadcast" not in numbered._jdf.queryExecution().executedPlan().toString() and numbered.count() == 200 and sum(sizes) == 9
    assert {r.rep: r.eer for r in bootstrap.replicate_metrics(t, ["system"], 4).collect()} == want and len(want) == 4


def test_a_width_of_zero_has_the_ratio_that_sql_gives(spark, monkeypatch):
    """Spark's division by zero raises (q_ci_width_ratio)."""
    widths = iter([(0.5, 0.0), (0.0, 0.0)])
    monkeypatch.setattr(bootstrap_queries, "replicates", lambda *a: None)
    monkeypatch.setattr(bootstrap, "intervals", lambda *a: spark.createDataFrame([("A", *next(widths))], "system string, eer_ci_width double, tdcf_ci_width double"))
    got = bootstrap_queries.q_ci_width_ratio(spark, "").first()
    assert (got.clustered_width, got.trial_width, got.eer_ratio) == (0.5, 0.0, np.inf) and np.isnan(got.tdcf_ratio)
