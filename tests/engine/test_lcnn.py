"""The network's layers against plain loops."""

import numpy as np
import pytest
from scorelake.operators import lcnn


def test_published_sizes():
    assert lcnn.n_parameters(lcnn.shapes(90, 250, "timepool")) == 184_017
    assert lcnn.n_parameters(lcnn.shapes(90, 400, "flatten")) == 798_417
    assert lcnn.n_parameters(lcnn.shapes(90, 400, "timepool")) == 184_017
    with pytest.raises(ValueError):
        lcnn.shapes(90, 250, "other")
    with pytest.raises(ValueError):
        lcnn.shapes(15, 250, "flatten")


def loops_convolved(x, w, b):
    n, c, f, t = x.shape
    o, _, k, _ = w.shape
    out = np.zeros((n, o, f, t))
    for i in np.ndindex(n, o, f, t):
        total = b[i[1]]
        for ch in range(c):
            for u in range(k):
                for v in range(k):
                    y, z = i[2] + u - k // 2, i[3] + v - k // 2
                    if 0 <= y < f and 0 <= z < t:
                        total += x[i[0], ch, y, z] * w[i[1], ch, u, v]
        out[i] = total
    return out


def loops_forward(p, image, head):
    x = image[None]
    for i, (filters, width, after) in enumerate(lcnn.LAYERS):
        y = loops_fast(x, p[f"conv{i}.weight"], p[f"conv{i}.bias"])
        x = np.array([[[max(y[c, a, b], y[c + filters // 2, a, b]) for b in range(y.shape[2])] for a in range(y.shape[1])] for c in range(filters // 2)])
        for step in after:
            if step == "p":
                x = np.array([[[max(ch[2 * a, 2 * b], ch[2 * a + 1, 2 * b], ch[2 * a, 2 * b + 1], ch[2 * a + 1, 2 * b + 1]) for b in range(ch.shape[1] // 2)] for a in range(ch.shape[0] // 2)] for ch in x])
            else:
                g = {k: p[f"norm{i}.{k}"] for k in ("weight", "bias", "mean", "var")}
                x = np.array([(ch - g["mean"][c]) / np.sqrt(g["var"][c] + 1e-5) * g["weight"][c] + g["bias"][c] for c, ch in enumerate(x)])
    flat = [v for c in x for row in c for v in ([row.mean()] if head == "timepool" else row)]
    h = [sum(a * b for a, b in zip(row, flat)) + bias for row, bias in zip(p["hidden.weight"], p["hidden.bias"])]
    h = [max(a, b) for a, b in zip(h[:80], h[80:])]
    g = {k: p[f"last.norm.{k}"] for k in ("weight", "bias", "mean", "var")}
    h = [(v - m) / np.sqrt(s + 1e-5) * w + b for v, m, s, w, b in zip(h, g["mean"], g["var"], g["weight"], g["bias"])]
    return sum(a * b for a, b in zip(p["last.weight"][0], h)) + p["last.bias"][0]


def loops_fast(x, w, b):
    """Shift by shift, one map at a time."""
    c, f, t = x.shape
    k = w.shape[-1]
    big = np.zeros((c, f + 2 * (k // 2), t + 2 * (k // 2)))
    big[:, k // 2 : k // 2 + f, k // 2 : k // 2 + t] = x
    out = np.zeros((len(w), f, t)) + b[:, None, None]
    for o in range(len(w)):
        for ch in range(c):
            for u in range(k):
                for v in range(k):
                    out[o] += w[o, ch, u, v] * big[ch, u : u + f, v : v + t]
    return out


def random_network(bins, frames, head, seed):
    r, p = np.random.default_rng(seed), lcnn.drawn(bins, frames, head, seed)
    return {k: np.abs(v + r.normal(0, 0.2, v.shape)) + 0.1 if k.endswith("var") else v + r.normal(0, 0.05, v.shape) for k, v in p.items()}


def test_layers_equal_plain_loops():
    r = np.random.default_rng(1)
    for k in (1, 3, 5):
        x, w, b = r.normal(size=(2, 3, 6, 7)), r.normal(size=(4, 3, k, k)), r.normal(size=4)
        want = loops_convolved(x, w, b)
        assert np.allclose(lcnn.convolved(x, w, b), want) and np.allclose(loops_fast(x[1], w, b), want[1])
    x = r.normal(size=(2, 4, 5, 7))
    assert lcnn.pooled(x).shape == (2, 4, 2, 3) and lcnn.pooled(x)[1, 2, 1, 2] == x[1, 2, 2:4, 4:6].max()
    assert np.array_equal(lcnn.halved(x)[:, 1], np.maximum(x[:, 1], x[:, 3]))


@pytest.mark.parametrize("head,frames", [("timepool", 33), ("flatten", 34)])
def test_scores_equal_the_network_in_loops(spark, head, frames, monkeypatch):
    monkeypatch.setattr(lcnn, "CELLS", 2 * 17 * frames * 64)
    p = random_network(17, frames, head, 3)
    maps = np.random.default_rng(4).normal(size=(3, 17, frames))
    rows = [(i, m.ravel().tolist()) for i, m in enumerate(maps)] + [(3, None), (4, []), (5, [1.0] * 5), (0, maps[0].ravel().tolist())]
    df = spark.createDataFrame(rows, "filename long, x array<double>")
    table = lcnn.as_table(spark, p)
    got = lcnn.scores(df, table, 17, frames, head).collect()
    assert len(got) == 7
    for r in got:
        if r.filename > 2:
            assert r.score is None
        else:
            assert r.score == pytest.approx(loops_forward(p, maps[r.filename], head), abs=1e-9)
    with pytest.raises(ValueError, match="another network"):
        lcnn.scores(df, table, 17, frames + 16, "flatten")
    assert lcnn.scores(df.limit(0), table, 17, frames, head).count() == 0
