"""Audio files as rows (S10): WAV by the standard library, FLAC by its published format, resampled by a polyphase filter.

A file is decoded inside the task that reads it; what can't be decoded, or fails its own checks (frame CRCs, the stream's MD5), is a row with an
error. FLAC is read frame by frame: the bits of one frame are laid out as an array, Rice codes are found by jumping from one set bit to the next, fixed
predictors are undone by running sums, and linear prediction sample by sample.
"""

from __future__ import annotations

import hashlib
import io
import wave
from operator import mul

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: block sizes and rates by code, bits by code.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class Damaged(ValueError):
    """What a file says of itself is not so."""


class Ended(Damaged):
    def __init__(self):
        super().__init__("the file ends within a frame")


def crc_table(bits: int, polynomial: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return out


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC16[c >> 8 ^ b]
    return c


class Bits:
    """The bits of a stretch of bytes, read from the front."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        at = np.where(self.bits == 1, np.arange(len(self.bits)), len(self.bits))
        self.next_one = np.minimum.accumulate(at[::-1])[::-1]
        self.place = 0

    def take(self, n: int) -> int:
        if self.place + n > len(self.bits):
            raise Ended
        out = 0
        for b in self.bits[self.place : self.place + n].tolist():
            out = out << 1 | b
        self.place += n
        return out

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """How many zeros stand before the next one, which is read too."""
        one = int(self.next_one[self.place]) if self.place < len(self.bits) else len(self.bits)
        if one == len(self.bits):
            raise Ended
        n, self.place = one - self.place, one + 1
        return n

    def fields(self, starts: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(starts), np.int64)
        for j in range(width):
            out = out << 1 | self.bits[starts + j]
        return out

    def numbers(self, n: int, width: int) -> np.ndarray:
        if self.place + n * width > len(self.bits):
            raise Ended
        x = self.fields(self.place + width * np.arange(n), width) if width else np.zeros(n, np.int64)
        self.place += n * width
        return x - (x >> (width - 1) << width) if width else x

    def rice(self, n: int, k: int) -> np.ndarray:
        """n codes: a quotient in unary, k bits of remainder, the sign last."""
        ones, place, ends, end = [], self.place, self.next_one, len(self.bits)
        for _ in range(n):
            one = int(ends[place]) if place < end else end
            ones.append(one)
            place = one + 1 + k
        if place > end or end in ones:
            raise Ended
        at = np.array(ones, np.int64)
        begins = np.concatenate([[self.place], at[:-1] + 1 + k])[:n] if n else at
        x = at - begins << k | (self.fields(at + 1, k) if k else 0)
        self.place = place
        return x >> 1 ^ -(x & 1)


def residual(bits: Bits, block: int, order: int) -> np.ndarray:
    method = bits.take(2)
    if method > 1:
        raise Damaged("unknown residual coding")
    width, parts = 4 + method, 1 << bits.take(4)
    if block % parts or block // parts < order:
        raise Damaged("a partition is too short")
    out = []
    for i in range(parts):
        n, k = block // parts - (order if i == 0 else 0), bits.take(width)
        out.append(bits.numbers(n, bits.take(5)) if k == (1 << width) - 1 else bits.rice(n, k))
    return np.concatenate(out)


def subframe(bits: Bits, block: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise Damaged("a subframe does not begin with zero")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        x = np.full(block, bits.signed(depth), np.int64)
    elif kind == 1:
        x = bits.numbers(block, depth)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = bits.numbers(order, depth)
        x = residual(bits, block, order)
        # differences of each order are summed up again, from the first samples' own differences
        for d in range(order, 0, -1):
            x = np.cumsum(np.concatenate([[np.diff(first[:d], d - 1)[0]], x]))
    elif kind >= 32:
        order = kind - 31
        x = bits.numbers(order, depth).tolist()
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise Damaged("unusable coefficients")
        coefficients = bits.numbers(order, precision)[::-1].tolist()
        for r in residual(bits, block, order).tolist():
            x.append(r + (sum(map(mul, coefficients, x[-order:])) >> shift))
        x = np.array(x, np.int64)
    else:
        raise Damaged("unknown subframe")
    return x << wasted


def coded_number(bits: Bits) -> int:
    """The frame's or sample's number, in as many bytes as leading ones say."""
    first = bits.take(8)
    n = 8 - (first ^ 0xFF).bit_length()
    if n == 1 or n > 7:
        raise Damaged("unreadable frame number")
    out = first & (0x7F >> n) if n else first
    for _ in range(max(0, n - 1)):
        out = out << 6 | bits.take(8) & 0x3F
    return out


def frame(data: bytes, start: int, depth: int, channels: int, largest: int) -> tuple[np.ndarray, int]:
    """Samples by channel of the frame that begins at start, and where it ends. As many bytes are laid out as plain samples would
    take, and more if the frame needs them."""
    room = 64 + channels * (max(largest, 16) * (depth + 1) // 8 + 64)
    while True:
        try:
            return parsed(data, start, Bits(data[start : start + room]), depth)
        except Ended:
            if start + room >= len(data):
                raise
            room *= 2


def parsed(data: bytes, start: int, bits: Bits, depth: int) -> tuple[np.ndarray, int]:
    if bits.take(15) != 0x7FFC:
        raise Damaged("no frame where one should begin")
    bits.take(1)
    size, rate, layout, bits_code, _ = bits.take(4), bits.take(4), bits.take(4), bits.take(3), bits.take(1)
    coded_number(bits)
    if size in (6, 7):
        block = bits.take(8 if size == 6 else 16) + 1
    elif size in BLOCK_SIZES:
        block = BLOCK_SIZES[size]
    else:
        raise Damaged("unknown block size")
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = bits.place // 8
    if crc8(data[start : start + head]) != bits.take(8):
        raise Damaged("a frame header's checksum fails")
    depth = DEPTHS.get(bits_code, depth)
    if layout > 10:
        raise Damaged("unknown channel layout")
    side = {8: 1, 9: 0, 10: 1}.get(layout)
    x = [subframe(bits, block, depth + (c == side)) for c in range(layout + 1 if layout < 8 else 2)]
    if layout == 8:
        x[1] = x[0] - x[1]
    elif layout == 9:
        x[0] = x[0] + x[1]
    elif layout == 10:
        middle = x[0] << 1 | x[1] & 1
        x = [middle + x[1] >> 1, middle - x[1] >> 1]
    end = start + (bits.place + 7) // 8
    if len(data) < end + 2:
        raise Ended
    if crc16(data[start:end]) != int.from_bytes(data[end : end + 2]):
        raise Damaged("a frame's checksum fails")
    return np.stack(x), end + 2


def flac(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (mono, -1 to 1) of a FLAC file."""
    if data[:4] != b"fLaC":
        raise Damaged("not a FLAC file")
    place, info, last = 4, None, False
    while not last:
        if place + 4 > len(data):
            raise Damaged("the file ends within its metadata")
        kind, size = data[place], int.from_bytes(data[place + 1 : place + 4])
        last = bool(kind & 0x80)
        if kind & 0x7F == 0:
            info = data[place + 4 : place + 4 + size]
        place += 4 + size
    if info is None or len(info) < 34:
        raise Damaged("no stream information")
    largest, packed = int.from_bytes(info[2:4]), int.from_bytes(info[10:18])
    rate, channels, depth, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    parts, n = [], 0
    while place < len(data) and (not total or n < total):
        x, place = frame(data, place, depth, channels, largest)
        if len(x) != channels:
            raise Damaged("a frame has other channels than the stream")
        parts.append(x)
        n += x.shape[1]
    if total and n != total:
        raise Damaged(f"{n} samples of {total}")
    x = np.concatenate(parts, 1) if parts else np.zeros((channels, 0), np.int64)
    width = (depth + 7) // 8
    if any(info[18:34]):
        body = x.T.astype("<i8").copy().view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        if hashlib.md5(body, usedforsecurity=False).digest() != info[18:34]:
            raise Damaged("the samples' digest differs")
    return rate, x.mean(0) / 2.0 ** (depth - 1)


def pcm(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (mono, -1 to 1) of a WAV file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        width, raw = w.getsampwidth(), w.readframes(w.getnframes())
        if width == 3:
            cells = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            x = (np.concatenate([np.zeros((len(cells), 1), np.uint8), cells], 1).copy().view("<i4").ravel() >> 8) / 2.0**23
        else:
            kind, middle, scale = {1: (np.uint8, 128, 128.0), 2: ("<i2", 0, 2.0**15), 4: ("<i4", 0, 2.0**31)}[width]
            x = (np.frombuffer(raw, kind).astype(np.float64) - middle) / scale
        return w.getframerate(), x.reshape(-1, w.getnchannels()).mean(1)


def resampled(x: np.ndarray, rate: int, to: int, lobes: int = 32, beta: float = 9.0) -> np.ndarray:
    """The signal at another rate: a Kaiser-windowed low-pass at the lower of the two, of which each output takes the phase that it falls on."""
    if rate == to or not len(x):
        return x
    common = np.gcd(rate, to)
    up, down = to // common, rate // common
    cutoff = min(1.0, to / rate) * 0.95
    half = int(np.ceil(lobes / cutoff))
    n = -(-len(x) * up // down)
    at = np.arange(n, dtype=np.int64) * down
    t = np.arange(-half, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    window = np.i0(beta * np.sqrt(np.maximum(0, 1 - (t / (half + 1)) ** 2))) / np.i0(beta)
    taps = cutoff * np.sinc(cutoff * t) * window
    taps /= taps.sum(1, keepdims=True)
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    views = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    out = np.empty(n)
    for i in range(0, n, 8192):
        s = at[i : i + 8192]
        out[i : i + 8192] = np.einsum("ij,ij->i", views[s // up], taps[s % up])
    return out


def decoded(rows: DataFrame, to: int | None = 16_000) -> DataFrame:
    """path, rate, samples (mono, at the wanted rate; None: as they are), error, from path and content."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, body in zip(b.column(0), b.column(1)):  # a row at a time: samples are many times the file
                rate = samples = error = None
                try:
                    data = body.as_py() or b""
                    rate, samples = flac(data) if data[:4] == b"fLaC" else pcm(data)
                    if to:
                        rate, samples = to, resampled(samples, rate, to)
                except (wave.Error, EOFError, KeyError, ValueError, IndexError) as e:
                    rate = samples = None
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([rate], pa.int32()), pa.array([samples], pa.list_(pa.float64())), pa.array([error], pa.string())], ["path", "rate", "samples", "error"])

    return rows.select("path", "content").mapInArrow(run, "path string, rate int, samples array<double>, error string")


def files(spark: SparkSession, path: str, pattern: str = "*.{wav,flac}", to: int | None = 16_000) -> DataFrame:
    """The audio files below a folder."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path), to)
