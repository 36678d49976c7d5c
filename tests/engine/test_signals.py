import numpy as np
from scorelake.operators import dsp
from scorelake.plans import model_queries as m

SF = "/root/testdata/sf0.001"


def test_signal_queries_cover_all_vectors(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert m.signals(spark, SF).count() == n
    assert m.QUERIES["q_lfcc"](spark, SF).select("filename").distinct().count() == n


def test_effects_keep_to_their_definitions():
    """Ratio, decay, limits and distortion over many draws."""
    t = np.arange(16000) / 16000
    y = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.1 * np.sin(2 * np.pi * 3000 * t)
    ratios, limits, kinds = [], [], {"tanh": 0, "hard": 0}
    for seed in range(60):
        noise = dsp.noisy(y, np.random.default_rng(seed)) - y
        ratios.append(10 * np.log10(np.dot(y, y) / np.dot(noise, noise)))
        echo = dsp.reverberant(np.concatenate([[1.0], np.zeros(15999)]), np.random.default_rng(seed))
        assert len(echo) == 16000 and np.abs(echo).sum() <= 1 + 1e-9 and np.abs(echo[8001:]).max() < 1e-9  # half a second at most
        early, late = np.abs(echo[1:200]).mean(), np.abs(echo[1000:1200]).mean()
        assert late < early
        out = dsp.clipped(y, np.random.default_rng(seed))
        top = np.abs(out).max() / np.abs(y).max()
        kinds["tanh" if top > 0.99 else "hard"] += 1
        if top <= 0.99:
            limits.append(top)
            assert np.array_equal(out, np.clip(y, -np.abs(out).max(), np.abs(out).max()))
        else:
            assert (np.abs(out) >= np.abs(y) - 1e-12).all()
        coded = dsp.recoded(y, np.random.default_rng(seed))
        error = coded - y
        assert len(coded) == len(y) and 0 < np.dot(error, error) < np.dot(y, y) / 10
    assert 10 <= min(ratios) < 15 and 25 < max(ratios) <= 30
    assert 0.3 <= min(limits) < 0.45 and 0.65 < max(limits) <= 0.8 and min(kinds.values()) > 15


def test_more_bits_lose_less_and_what_cannot_be_coded_comes_back():
    y = 0.8 * np.sin(np.arange(4000) / 9)
    for coder in (dsp.adaptive_steps, dsp.companded):
        losses = [np.mean((coder(y, b) - y) ** 2) for b in (3, 5, 8)]
        assert losses[0] > losses[1] > losses[2]
    assert np.abs(dsp.companded(y, 8) - y).max() < 0.03
    r = np.random.default_rng(0)
    for odd in (np.zeros(5), np.zeros(0), np.array([np.nan, 1.0]), np.array([np.inf])):
        assert dsp.recoded(odd, r) is odd
    assert [e.__name__ for e, _ in dsp.EFFECTS] == ["noisy", "reverberant", "clipped", "recoded"]
    assert np.array_equal(dsp.clipped(np.zeros(3), r), np.zeros(3)) and np.array_equal(dsp.noisy(np.zeros(3), r), np.zeros(3))
