"""FLAC files written by a plain encoder, bit by bit, and read back."""

import hashlib
import io
import wave

import numpy as np
import pytest
from scorelake.sources import audio


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, x, n):
        self.bits += [x >> (n - 1 - i) & 1 for i in range(n)]
        return self

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def crc(data, bits, poly):
    """Bit by bit."""
    c = 0
    for byte in data:
        for i in range(8):
            top = c >> (bits - 1) & 1
            c = (c << 1) & ((1 << bits) - 1)
            if top ^ (byte >> (7 - i) & 1):
                c ^= poly
    return c


def put_residual(w, r, order, block, k, parts, method, escape):
    w.put(method, 2).put(parts, 4)
    width, size = 4 + method, block >> parts
    for i in range(1 << parts):
        lo, hi = max(0, i * size - order), (i + 1) * size - order
        if escape:
            w.put((1 << width) - 1, width).put(20, 5)
            for x in r[lo:hi]:
                w.put(x & (1 << 20) - 1, 20)
            continue
        w.put(k, width)
        for x in r[lo:hi]:
            u = 2 * x if x >= 0 else -2 * x - 1
            w.bits += [0] * (u >> k) + [1]
            w.put(u & (1 << k) - 1, k)


FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def put_subframe(w, x, depth, kind, wasted=0, k=6, parts=0, method=0, escape=False):
    x, block = [int(v) >> wasted for v in x], len(x)
    name, order = kind if isinstance(kind, tuple) else (kind, 0)
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[name]
    w.put(0, 1).put(code, 6).put(int(wasted > 0), 1)
    if wasted:
        w.put(1, wasted)
    depth -= wasted
    mask = (1 << depth) - 1
    if name == "constant":
        w.put(x[0] & mask, depth)
    elif name == "verbatim":
        for v in x:
            w.put(v & mask, depth)
    else:
        coef, shift = (FIXED[order], 0) if name == "fixed" else ([int(c) for c in np.random.default_rng(order).integers(-300, 300, order)], 9)
        for v in x[:order]:
            w.put(v & mask, depth)
        if name == "lpc":
            w.put(11, 4).put(shift, 5)
            for c in coef:
                w.put(c & 0xFFF, 12)
        r = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coef)) >> shift) for i in range(order, block)]
        put_residual(w, r, order, block, k, parts, method, escape)


def encode(x, rate=16000, depth=16, block=256, kinds=(("fixed", 2),), layout=None, digest=True, **how):
    """x: channels x samples."""
    channels, n = x.shape
    info = Writer().put(block, 16).put(block, 16).put(0, 24).put(0, 24).put(rate, 20).put(channels - 1, 3).put(depth - 1, 5).put(n, 36).bytes()
    body = x.T.astype("<i8").copy().view(np.uint8).reshape(-1, 8)[:, : (depth + 7) // 8].tobytes()
    info += hashlib.md5(body).digest() if digest else bytes(16)
    out = b"fLaC" + bytes([0]) + len(info).to_bytes(3) + info + bytes([0x81]) + (5).to_bytes(3) + b"\0" * 5
    for f, s in enumerate(range(0, n, block)):
        part = x[:, s : s + block]
        size = part.shape[1]
        w = Writer().put(0x3FFE, 14).put(0, 2).put(7, 4).put(0, 4).put(channels - 1 if layout is None else layout, 4).put(0, 4)
        number = [f] if f < 128 else [0xC0 | f >> 6, 0x80 | f & 0x3F]
        for b in number:
            w.put(b, 8)
        w.put(size - 1, 16)
        w.put(crc(w.bytes(), 8, 0x07), 8)
        a, b = part[0], part[-1]
        rows = {None: list(part), 8: [a, a - b], 9: [a - b, b], 10: [a + b >> 1, a - b]}[layout]
        for c, row in enumerate(rows):
            put_subframe(w, row, depth + (c == {8: 1, 9: 0, 10: 1}.get(layout)), kinds[(f + c) % len(kinds)], **how)
        data = w.bytes()
        out += data + crc(data, 16, 0x8005).to_bytes(2)
    return out


def tone(n, channels=1, depth=16, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    scale = 2 ** (depth - 3)
    return np.stack([(np.sin(t / (7 + c)) * scale + r.normal(0, scale / 50, n)).astype(np.int64) for c in range(channels)])


CASES = {
    "every fixed order": (dict(kinds=[("fixed", i) for i in range(5)], k=8), tone(1500)),
    "linear prediction": (dict(kinds=[("lpc", i) for i in (1, 2, 8, 32)], k=12), tone(1500)),
    "constant and verbatim": (dict(kinds=["verbatim"]), tone(600)),
    "silence": (dict(kinds=["constant"]), np.zeros((1, 512), np.int64)),
    "partitions, wide parameters": (dict(kinds=[("fixed", 2)], parts=3, method=1, k=9), tone(1024)),
    "raw partitions": (dict(kinds=[("fixed", 1)], escape=True, parts=1), tone(512)),
    "two channels": (dict(kinds=[("fixed", 2), ("lpc", 4)], k=10), tone(700, 2)),
    "left and side": (dict(kinds=[("fixed", 2)], layout=8, k=9), tone(700, 2)),
    "right and side": (dict(kinds=[("fixed", 2)], layout=9, k=9), tone(700, 2)),
    "middle and side": (dict(kinds=[("fixed", 2)], layout=10, k=9), tone(701, 2)),
    "wasted bits": (dict(kinds=[("fixed", 2)], wasted=3, k=6), tone(512) >> 3 << 3),
    "24 bits": (dict(kinds=[("fixed", 3)], depth=24, k=15, method=1), tone(512, depth=24)),
    "8 bits, no digest": (dict(kinds=[("fixed", 1)], depth=8, k=3, digest=False), tone(512, depth=8)),
    "many frames": (dict(kinds=[("fixed", 1)], block=16, k=8), tone(16 * 140)),
}


@pytest.mark.parametrize("name", CASES)
def test_samples_come_back(name):
    how, x = CASES[name]
    rate, got = audio.flac(encode(x, **how))
    assert rate == 16000 and np.array_equal(got, x.mean(0) / 2.0 ** (how.get("depth", 16) - 1))


def test_damage_is_found():
    good = encode(tone(600), k=8)
    for place in (5000 % len(good), len(good) // 2, len(good) - 1, 60):
        bad = bytearray(good)
        bad[place] ^= 0x10
        with pytest.raises(ValueError):
            audio.flac(bytes(bad))
    for cut in (3, 20, 60, len(good) // 2, len(good) - 1):
        with pytest.raises(ValueError):
            audio.flac(good[:cut])
    wrong = encode(tone(600), k=8).replace(hashlib.md5(tone(600).T.astype("<i2").tobytes()).digest(), b"x" * 16)
    with pytest.raises(audio.Damaged, match="digest"):
        audio.flac(wrong)


@pytest.mark.parametrize("rate", [8000, 22050, 44100, 48000])
def test_resampling_keeps_what_both_rates_hold(rate):
    t = np.arange(rate) / rate
    got = audio.resampled(np.sin(2 * np.pi * 1000 * t) + 0.5 * np.cos(2 * np.pi * 2500 * t), rate, 16000)
    u = np.arange(16000) / 16000
    want = np.sin(2 * np.pi * 1000 * u) + 0.5 * np.cos(2 * np.pi * 2500 * u)
    assert len(got) == 16000 and np.abs(got - want)[200:-200].max() < 1e-3
    if rate > 16000:  # what lies above the new rate's half is gone
        high = audio.resampled(np.sin(2 * np.pi * 10_000 * t), rate, 16000)
        assert np.abs(high)[200:-200].max() < 1e-3


def test_files_as_rows(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    x = tone(800, 2)
    (tmp_path / "p1" / "a.flac").write_bytes(encode(x, rate=8000, kinds=[("lpc", 3)], layout=None, k=11))
    (tmp_path / "b.flac").write_bytes(encode(x, k=8)[:-5])
    body = io.BytesIO()
    with wave.open(body, "wb") as w:
        w.setnchannels(1), w.setsampwidth(3), w.setframerate(16000)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in (0, 1 << 22, -(1 << 23))))
    (tmp_path / "c.wav").write_bytes(body.getvalue())
    (tmp_path / "d.wav").write_bytes(b"RIFF")
    (tmp_path / "notes.txt").write_text("no audio")
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.flac", "b.flac", "c.wav", "d.wav"}
    assert rows["a.flac"].rate == 16000 and len(rows["a.flac"].samples) == 1600 and rows["a.flac"].error is None
    assert rows["b.flac"].samples is None and "checksum" in rows["b.flac"].error or "ends" in rows["b.flac"].error
    assert rows["c.wav"].samples == [0.0, 0.5, -1.0] and rows["d.wav"].error
    own = audio.files(spark, str(tmp_path), "*.flac", None).where("error is null").first()
    assert own.rate == 8000 and np.array_equal(own.samples, x.mean(0) / 2**15)
