"""Light convolutional network with max-feature-maps (L21): scores of spectrograms from parameters that are kept as a table.

A layer is a convolution over strided windows, of whose channels the larger of two halves stays; some are normalised, some pooled. The
head averages over time (`timepool`) or keeps every place (`flatten`). Higher scores are more bonafide. Parameters are rows (name, shape, values): a few
megabytes whatever the data, measured before they are sent to the tasks. Rows are scored in batches whose memory is bounded by CELLS.

Defined cases: a null or empty map, or one of another size than the network's, has a null score; repeated rows are each scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: Each layer's filters before halving, their width, and what follows (p: pooled by two, n: normalised, in this order).
LAYERS = ((64, 5, "p"), (64, 1, "n"), (96, 3, "pn"), (96, 1, "n"), (128, 3, "p"), (128, 1, "n"), (64, 3, "n"), (64, 1, "n"), (64, 3, "p"))
HIDDEN, EPSILON = 160, 1e-5
#: Cells of a batch's widest layer.
CELLS = 1 << 24
SCHEMA = "name string, shape array<int>, values array<double>"


def shapes(bins: int, frames: int, head: str) -> dict[str, tuple[int, ...]]:
    """The parameters by name, running statistics of normalised layers included."""
    if head not in ("timepool", "flatten"):
        raise ValueError(f"unknown head {head}")
    out, channels, f, t = {}, 1, bins, frames
    for i, (filters, width, after) in enumerate(LAYERS):
        out |= {f"conv{i}.weight": (filters, channels, width, width), f"conv{i}.bias": (filters,)}
        channels = filters // 2
        if "p" in after:
            f, t = f // 2, t // 2
        if "n" in after:
            out |= {f"norm{i}.{k}": (channels,) for k in ("weight", "bias", "mean", "var")}
    if not f or not t:
        raise ValueError(f"{bins} x {frames} cells are too few for the pools")
    wide = channels * f * (t if head == "flatten" else 1)
    out |= {"hidden.weight": (HIDDEN, wide), "hidden.bias": (HIDDEN,)}
    out |= {f"last.norm.{k}": (HIDDEN // 2,) for k in ("weight", "bias", "mean", "var")}
    return out | {"last.weight": (1, HIDDEN // 2), "last.bias": (1,)}


def n_parameters(parameters: dict[str, tuple[int, ...]]) -> int:
    """What training changes: running statistics do not count."""
    return sum(int(np.prod(s)) for k, s in parameters.items() if not k.endswith((".mean", ".var")))


def drawn(bins: int, frames: int, head: str = "timepool", seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters to begin with: normal weights scaled by what feeds them, no bias, normalisations that change nothing."""
    r, out = np.random.default_rng(seed), {}
    for name, shape in shapes(bins, frames, head).items():
        if len(shape) > 1:
            out[name] = r.normal(0, np.sqrt(2 / np.prod(shape[1:])), shape)
        else:
            out[name] = np.full(shape, float(name.endswith(("var",)) or "norm" in name and name.endswith("weight")))
    return out


def halved(x: np.ndarray) -> np.ndarray:
    """Of each pair of channels, half the channels apart, the larger."""
    half = x.shape[1] // 2
    return np.maximum(x[:, :half], x[:, half:])


def convolved(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """rows x channels x bins x frames, with zeros around so that the size stays."""
    pad = weight.shape[-1] // 2
    if not pad:
        return np.einsum("oc,ncft->noft", weight[:, :, 0, 0], x, optimize=True) + bias[:, None, None]
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad))), weight.shape[2:], axis=(2, 3))
    return np.tensordot(windows, weight, axes=((1, 4, 5), (1, 2, 3))).transpose(0, 3, 1, 2) + bias[:, None, None]


def pooled(x: np.ndarray) -> np.ndarray:
    """The largest of two by two; an odd last row or column falls away."""
    n, c, f, t = x.shape
    return x[:, :, : f // 2 * 2, : t // 2 * 2].reshape(n, c, f // 2, 2, t // 2, 2).max((3, 5))


def normalised(x: np.ndarray, p: dict[str, np.ndarray], name: str) -> np.ndarray:
    scale = p[f"{name}.weight"] / np.sqrt(p[f"{name}.var"] + EPSILON)
    shift = p[f"{name}.bias"] - p[f"{name}.mean"] * scale
    return x * scale.reshape(1, -1, *[1] * (x.ndim - 2)) + shift.reshape(1, -1, *[1] * (x.ndim - 2))


def forward(p: dict[str, np.ndarray], x: np.ndarray, head: str) -> np.ndarray:
    """The scores of maps (rows x bins x frames)."""
    x = x[:, None]
    for i, (_, _, after) in enumerate(LAYERS):
        x = halved(convolved(x, p[f"conv{i}.weight"], p[f"conv{i}.bias"]))
        for step in after:
            x = pooled(x) if step == "p" else normalised(x, p, f"norm{i}")
    x = (x.mean(3) if head == "timepool" else x).reshape(len(x), -1)
    x = halved(x @ p["hidden.weight"].T + p["hidden.bias"])
    return (normalised(x, p, "last.norm") @ p["last.weight"].T + p["last.bias"])[:, 0]


def as_table(spark: SparkSession, parameters: dict[str, np.ndarray]) -> DataFrame:
    """name, shape, values; stored."""
    rows = [(k, list(v.shape), [float(a) for a in v.ravel()]) for k, v in parameters.items()]
    return stored(spark.createDataFrame(rows, SCHEMA), "network")


def from_table(table: DataFrame, most: int = 64 << 20) -> dict[str, np.ndarray]:
    """The parameters of one network; a table of more bytes than that is none."""
    size = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if 8 * size > most:
        raise ValueError(f"{size} numbers are no network's parameters")
    return {r.name: np.array(r["values"], float).reshape(r.shape) for r in table.collect()}


def scores(rows: DataFrame, parameters: DataFrame, bins: int, frames: int, head: str = "timepool", key: str = "filename", column: str = "x") -> DataFrame:
    """key, score; column holds the map's cells, bin by bin."""
    p = from_table(parameters)
    if {k: v.shape for k, v in p.items()} != shapes(bins, frames, head):
        raise ValueError("the parameters are another network's")
    shared = rows.sparkSession.sparkContext.broadcast(p)
    step = max(1, CELLS // (bins * frames * 64))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [None] * b.num_rows
            cells = b.column(1).to_pylist()
            good = [i for i, c in enumerate(cells) if c is not None and len(c) == bins * frames and None not in c]
            for s in range(0, len(good), step):
                some = good[s : s + step]
                x = np.array([cells[i] for i in some], float).reshape(-1, bins, frames)
                for i, v in zip(some, forward(shared.value, x, head)):
                    out[i] = float(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], [key, "score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(column).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, score double")
