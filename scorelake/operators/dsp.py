"""Signal operators on arrays of samples (D01-D03, D05, D06, D12-D17): numpy kernels run in Arrow batches.

Choices where publications leave room: magnitudes of centred Hann frames, reflected at the edges; the mel scale that is linear up to
1 kHz (Slaney), with bands of equal area; deltas are derivatives of a polynomial fitted to the frames around, at the edges of the
first and last full windows; the constant-Q kernels are windowed complex exponentials (Brown, 1991).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FFT, HOP = 16000, 512, 160


def spectra(y: np.ndarray, window: int = FFT, hop: int = HOP) -> np.ndarray:
    """Power spectra, frames by bins."""
    y = np.asarray(y, np.float64)
    if not len(y):
        y = np.zeros(1)
    y = np.pad(y, FFT // 2, mode="reflect" if len(y) > FFT // 2 else "constant")
    n = 1 + (len(y) - FFT) // hop
    frames = y[np.arange(FFT)[None, :] + hop * np.arange(n)[:, None]]
    w = np.zeros(FFT)
    s = (FFT - window) // 2
    w[s : s + window] = np.hanning(window + 1)[:-1]
    return np.abs(np.fft.rfft(frames * w, axis=1)) ** 2


@lru_cache(None)
def linear_bank(n: int = 70) -> np.ndarray:
    """Triangles with evenly spaced centres."""
    f, width = np.arange(FFT // 2 + 1) * RATE / FFT, RATE / 2 / (n + 1)
    return np.maximum(0, 1 - np.abs(f[None, :] - width * np.arange(1, n + 1)[:, None]) / width)


@lru_cache(None)
def mel_bank(n: int = 128) -> np.ndarray:
    """Triangles between points that are even on the mel scale: 200/3 Hz a mel up to 1 kHz, then 27 steps to 6.4 kHz."""
    step, top = np.log(6.4) / 27, 15 + np.log(RATE / 2 / 1000) / (np.log(6.4) / 27)
    at = np.linspace(0, top, n + 2)
    edges = np.where(at < 15, at * 200 / 3, 1000 * np.exp(step * (np.maximum(at, 15) - 15)))
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    up = (f[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(None)
def dct(n: int, k: int) -> np.ndarray:
    """The first k rows of the orthonormal DCT-II."""
    m = np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None]) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def deltas(c: np.ndarray, width: int = 9, order: int = 1) -> np.ndarray:
    """The derivative of that order of a polynomial of that degree, fitted to up to width frames (Savitzky and Golay); the
    frames before the first and after the last full window have that window's. Zeros under three frames."""
    t = len(c)
    if t < 3:
        return np.zeros_like(c)
    h = min(width, t - (t + 1) % 2) // 2
    n = np.arange(-h, h + 1.0)
    w = n / (n**2).sum() if order == 1 else 2 * (n**2 - (n**2).mean()) / ((n**2 - (n**2).mean()) ** 2).sum()
    full = sum(w[i] * c[i : t - 2 * h + i] for i in range(2 * h + 1))
    return np.pad(full, ((h, h), (0, 0)), mode="edge")


def stacked(c: np.ndarray) -> np.ndarray:
    return np.hstack([c, deltas(c), deltas(c, order=2)])


def lfcc(y: np.ndarray) -> np.ndarray:
    """60 coefficients a frame."""
    return stacked(np.log(spectra(y, 320) @ linear_bank().T + 1e-10) @ dct(70, 20).T)


def mfcc_pooled(y: np.ndarray) -> np.ndarray:
    """Means and population deviations of 60 coefficients."""
    db = 10 * np.log10(np.maximum(spectra(y) @ mel_bank().T, 1e-10))
    c = stacked(np.maximum(db, db.max() - 80) @ dct(128, 20).T)
    return np.concatenate([c.mean(0), c.std(0)])


@lru_cache(None)
def cq_kernels(bins: int, octave: int, low: float):
    out = []
    q = 1 / (2 ** (1 / octave) - 1)
    for k in range(bins):
        f = low * 2 ** (k / octave)
        n = int(np.ceil(q * RATE / f))
        out.append(np.hanning(n) * np.exp(2j * np.pi * f / RATE * np.arange(n)) / n)
    return out


def cqt_uint8(y: np.ndarray, bins: int = 90, octave: int = 12, hop: int = 256, low: float = 32.7) -> np.ndarray:
    """Decibels below the greatest magnitude, floored at -80, rounded half to even to 0..255; bins by frames."""
    y = np.asarray(y, np.float64)
    frames = 1 + len(y) // hop
    mag = np.empty((bins, frames))
    for k, kern in enumerate(cq_kernels(bins, octave, low)):
        p = np.pad(y, (len(kern) // 2, len(kern) + hop))
        spans = np.lib.stride_tricks.sliding_window_view(p, len(kern))[: frames * hop : hop][:frames]
        mag[k] = np.abs(spans @ kern.conj())
    db = 20 * np.log10(np.maximum(mag, 1e-10) / max(mag.max(), 1e-10))
    return np.clip(np.rint((np.maximum(db, -80) + 80) / 80 * 255), 0, 255).astype(np.uint8)


def cq_cepstra(record: np.ndarray, bins: int, keep: int = 20) -> np.ndarray:
    """A record of 0 to 255, bins by frames, as decibels, transformed over the bins, with deltas: frames by 3 x keep."""
    db = np.asarray(record, np.float64).reshape(bins, -1) / 255 * 80 - 80
    return stacked(db.T @ dct(bins, keep).T)


#: Fixed values of the effects' definitions: ranges of the ratio of signal to noise (dB) and of the smoothing, of the decay time to
#: -60 dB (s), of the drive of soft and the share of the peak of hard clipping; each effect's chance is in EFFECTS.
SNR, SMOOTHING, DECAY, DRIVE, SHARE = (10.0, 30.0), (3, 15), (0.08, 0.5), (1.5, 6.0), (0.3, 0.8)


def noisy(y: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Noise whose energy is below the signal's by a random ratio; half of the time its spectrum falls, by a moving average."""
    ratio, noise = 10 ** (r.uniform(*SNR) / 10), r.normal(size=len(y))
    if r.random() < 0.5:
        width = int(r.integers(SMOOTHING[0], SMOOTHING[1] + 1))
        sums = np.cumsum(np.concatenate([np.zeros(width), noise]))
        noise = sums[width:] - sums[:-width]
    own = np.dot(noise, noise)
    return y + noise * np.sqrt(np.dot(y, y) / (ratio * own)) if own > 0 else y


def reverberant(y: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """A room whose echoes are random and fall by 60 dB over the decay time, beside the direct path; no louder than before, and
    cut to the signal's length."""
    length = int(r.uniform(*DECAY) * RATE)
    room = r.normal(size=length) * np.power(10.0, -3 * np.arange(length) / length)
    room[0] += 1
    room /= np.sum(np.abs(room))
    size = 1 << int(np.ceil(np.log2(len(y) + length)))
    return np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(room, size), size)[: len(y)]


def clipped(y: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Saturation relative to the peak, which soft clipping keeps; hard clipping cuts at a share of it."""
    peak = np.abs(y).max(initial=0.0)
    if peak == 0:
        return y
    if r.random() < 0.5:
        drive = r.uniform(*DRIVE)
        return peak / np.tanh(drive) * np.tanh(drive / peak * y)
    limit = peak * r.uniform(*SHARE)
    return np.minimum(np.maximum(y, -limit), limit)


def adaptive_steps(y: np.ndarray, bits: int) -> np.ndarray:
    """Each sample as a code of a few bits for its difference from the last one that the decoder has; steps grow after large
    codes and shrink after small ones."""
    most, step, last, out = (1 << (bits - 1)) - 1, 0.02, 0.0, np.empty(len(y))
    for i, v in enumerate(y.tolist()):
        code = max(-most, min(most, round((v - last) / step)))
        last += code * step
        out[i] = last
        step = min(0.5, max(1e-4, step * (0.9 if abs(code) <= most // 2 else 1.0 + 0.8 * abs(code) / most)))
    return out


def companded(y: np.ndarray, bits: int) -> np.ndarray:
    """Each sample's logarithmically compressed value (mu = 255) in so many bits."""
    levels = (1 << (bits - 1)) - 1
    code = np.rint(np.sign(y) * np.log1p(255 * np.abs(y)) / np.log(256) * levels) / levels
    return np.sign(code) * np.expm1(np.abs(code) * np.log(256)) / 255


def recoded(y: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """A lossy round trip, adaptive steps of 3 to 5 bits or companding to 5 to 8, in place of the MP3 and AAC coders, which Spark's workers do not
    have. What cannot be coded comes back as it is."""
    peak = np.abs(y).max(initial=0.0)
    if not np.isfinite(peak) or peak == 0:
        return y
    coder, bits = (adaptive_steps, int(r.integers(3, 6))) if r.random() < 0.5 else (companded, int(r.integers(5, 9)))
    return coder(y / peak, bits) * peak


EFFECTS = ((noisy, 0.6), (reverberant, 0.5), (clipped, 0.35), (recoded, 0.3))


def augmented(y: np.ndarray, seed: int) -> np.ndarray:
    """Effects in random order, each by chance, one at least; scaled down if it passes 1."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(EFFECTS))
    use = [i for i in order if r.random() < EFFECTS[i][1]] or [int(order[0])]
    for i in use:
        y = EFFECTS[i][0](y, r)
    peak = np.abs(y).max(initial=0)
    return y / peak if peak > 1 else y


def pooled(signals: DataFrame, kernel: str, key: str = "filename", column: str = "y") -> DataFrame:
    """key, x, error: a kernel's result for each signal, flattened; a failure is kept as data."""
    kernels = {"mfcc": mfcc_pooled, "lfcc": lambda y: lfcc(y).ravel(), "cqt": lambda y: cqt_uint8(y).ravel().astype(float), "cepstra8": lambda y: cq_cepstra(y, 8, 5).ravel()}
    kind = dict(signals.dtypes)[key]

    def run(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            keys, signal = b.column(0).to_pylist(), b.column(1)
            flat, ends = signal.values.to_numpy(zero_copy_only=False), signal.offsets.to_numpy()
            there, xs, errors = signal.is_valid().to_pylist(), [], []
            for k, ok, lo, hi in zip(keys, there, ends[:-1], ends[1:]):
                try:
                    if not ok:
                        raise ValueError("no signal")
                    y = flat[lo:hi]
                    xs.append(augmented(y, zlib.crc32(str(k).encode())) if kernel == "augment" else kernels[kernel](y))
                    errors.append(None)
                except (TypeError, ValueError) as e:
                    xs.append(None)
                    errors.append(str(e))
            sizes = [0 if x is None else len(x) for x in xs]
            values = pa.array(np.concatenate([np.zeros(0), *[x for x in xs if x is not None]]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values, mask=pa.array([x is None for x in xs]))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(errors, pa.string())], [key, "x", "error"])

    return signals.select(key, F.col(column).cast("array<double>").alias(column)).mapInArrow(run, f"{key} {kind}, x array<double>, error string")
