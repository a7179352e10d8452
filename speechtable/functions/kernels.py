"""Numpy kernels on one clip's samples, for use inside pandas UDFs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

NOISES = ("white", "pink", "fan", "babble")
#: fixed values: frequency, weight and phase of a fan's tones
HUM = ((60, 0.8, 0.0), (120, 0.35, 0.2), (240, 0.18, 0.7))


def _butterworth_highpass(cutoff: float, rate: int, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a Butterworth high-pass by the bilinear transform."""
    k = np.tan(np.pi * cutoff / rate)
    sections = []
    for i in range(order // 2):
        q = 1 / (2 * np.cos(np.pi * (2 * i + 1) / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        sections.append((np.array([norm, -2 * norm, norm]), np.array([1, 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm])))
    return sections


_RESPONSE: dict[tuple[float, int], np.ndarray] = {}
#: frames that are worked on at once: what is made of them stays in the cache, whatever the clip's length
FRAMES = 32


def _impulse_response(cutoff: float, rate: int, n: int = 4096) -> np.ndarray:
    """The filter's answer to a single one; at 75 Hz it has died away (1e-15) after a quarter of a second."""
    if (cutoff, rate) not in _RESPONSE:
        x = [1.0] + [0.0] * (n - 1)
        for b, a in _butterworth_highpass(cutoff, rate):
            z1 = z2 = 0.0
            y = []
            for v in x:
                out = b[0] * v + z1
                z1 = b[1] * v - a[1] * out + z2
                z2 = b[2] * v - a[2] * out
                y.append(out)
            x = y
        _RESPONSE[cutoff, rate] = np.array(x)
    return _RESPONSE[cutoff, rate]


@lru_cache(maxsize=4)
def _spectrum(cutoff: float, rate: int, n: int) -> np.ndarray:
    return np.fft.rfft(_impulse_response(cutoff, rate), n)


def highpass(x: np.ndarray, cutoff: float, rate: int) -> np.ndarray:
    """By Fourier transform with the impulse response."""
    n = 1 << (len(x) + len(_impulse_response(cutoff, rate)) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * _spectrum(cutoff, rate, n), n)[: len(x)]


def condition(x: np.ndarray, rate: int = 16000) -> np.ndarray:
    """High-pass at 75 Hz, then a limiter to a peak of 0.75. Very short clips stay as they are."""
    if len(x) < 32:
        return x
    y = highpass(np.asarray(x, float), 75.0, rate)
    if not np.isfinite(y).all():
        return x
    peak = np.abs(y).max()
    return y * (0.75 / max(peak, 0.75)) if peak > 0.01 else y


def _framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    n = 1 + (len(x) - size) // hop if len(x) >= size else 0
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] if n else np.zeros((0, size))


def _blocks(frames: np.ndarray) -> Iterator[np.ndarray]:
    return (frames[at : at + FRAMES] for at in range(0, len(frames), FRAMES))


def _autocorrelation(frames: np.ndarray) -> np.ndarray:
    n = 1 << (2 * frames.shape[1] - 1).bit_length()
    spectrum = np.fft.rfft(frames, n, axis=1)
    return np.fft.irfft(np.abs(spectrum) ** 2, n, axis=1)[:, : frames.shape[1]]


def f0_contour(x: np.ndarray, rate: int = 16000, low: float = 80.0, high: float = 380.0, smooth: bool = True) -> np.ndarray:
    """Pitch of the voiced 30 ms frames, every 10 ms: the highest value of the autocorrelation among the lags of low to high,
    refined by a parabola. Frames that are quiet (after the window) or noisy are left out, and those whose highest value is
    weak or lies at an edge of the lags."""
    frames = _framed(np.asarray(x, float), int(0.03 * rate), int(0.01 * rate))
    f0 = np.concatenate([np.zeros(0), *(_pitch(own, rate, low, high) for own in _blocks(frames))])
    return median5(f0) if smooth else f0


def _pitch(frames: np.ndarray, rate: int, low: float, high: float) -> np.ndarray:
    frames = (frames - frames.mean(1, keepdims=True)) * np.hamming(frames.shape[1])
    rms = np.sqrt((frames**2).mean(1) + 1e-12)
    signs = (frames > 0).astype(np.int8) - (frames < 0).astype(np.int8)
    crossings = np.abs(np.diff(signs, axis=1)).mean(1) / 2
    frames = frames[(rms >= 0.004) & (crossings <= 0.24)]
    if not len(frames):
        return np.zeros(0)
    r = _autocorrelation(frames)
    own = r[:, int(rate / high) : int(rate / low)]
    at, row = own.argmax(1), np.arange(len(own))
    inner = np.clip(at, 1, own.shape[1] - 2)
    before, top, after = own[row, inner - 1], own[row, inner], own[row, inner + 1]
    ok = (at == inner) & (top > before) & (top > after) & (r[:, 0] > 0) & (top >= 0.42 * r[:, 0])
    bend = before - 2 * top + after
    shift = np.where(np.abs(bend) > 1e-12, 0.5 * (before - after) / np.where(bend == 0, 1, bend), 0)
    f0 = rate / (int(rate / high) + at + np.clip(shift, -0.5, 0.5))[ok]
    return f0[(f0 >= 70) & (f0 <= 400)]


def median5(x: np.ndarray) -> np.ndarray:
    """Five-point median, zeros beyond the ends; shorter series stay."""
    if len(x) < 5:
        return x
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 2), 5), axis=1)


def _before_end(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames that end before the last sample: one that ends with it is left out."""
    return _framed(x[:-1], size, hop)


def energy_ratio(x: np.ndarray, rate: int = 16000) -> float:
    """Highest over mean energy of 50 ms blocks at every 25 ms; 0 for less than a block."""
    energy = (_before_end(np.asarray(x, float), int(0.05 * rate), int(0.025 * rate)) ** 2).sum(1)
    return float(energy.max() / (energy.mean() + 1e-12)) if len(energy) else 0.0


def _power(x: np.ndarray, rate: int, size: int = 512, hop: int = 256) -> np.ndarray:
    """Power spectra (a row a frame, density) of tapered frames about their means."""
    return _density(_framed(x, size, hop), rate)


def _density(frames: np.ndarray, rate: int) -> np.ndarray:
    window = _tukey(frames.shape[1], 0.25)
    power = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window, axis=1)) ** 2 / (rate * (window**2).sum())
    power[:, 1:-1] *= 2
    return power


def overlap_evidence(x: np.ndarray, rate: int = 16000) -> tuple[float, int, int]:
    """Mean spectral entropy in bits over all frames of 512 samples, silent ones too; voiced 30 ms frames, and those whose
    autocorrelation has two peaks or more."""
    x = np.asarray(x, float)
    entropy, n = [], []
    for frames in _blocks(_framed(x, 512, 256)):
        power = _density(frames, rate) + 1e-10
        share = power / (power.sum(1, keepdims=True) + 1e-10)
        entropy.append(-(share * np.log2(share + 1e-10)).sum(1))
    if not entropy:
        return 0.0, 0, 0
    for frames in _blocks(_before_end(x, int(0.03 * rate), int(0.03 * rate))):
        r = _autocorrelation(frames[np.abs(frames).max(1) >= 0.02])
        own = r[:, int(rate / 400) : int(rate / 80)]
        peaks = (own[:, 1:-1] > own[:, :-2]) & (own[:, 1:-1] > own[:, 2:]) & (own[:, 1:-1] > 0.35 * r[:, :1])
        n.append(peaks.sum(1))
    n = np.concatenate([np.zeros(0, int), *n])
    return float(np.concatenate(entropy).mean()), int((n >= 1).sum()), int((n >= 2).sum())


def mfcc_embedding(x: np.ndarray, rate: int = 16000, dims: int = 192) -> np.ndarray:
    """Means and spreads of 20 cepstral coefficients, centred over time, as a unit vector of `dims` values."""
    size, bands = 512, 26
    x = np.asarray(x, float)
    power = _power(np.pad(x, (0, max(0, size - len(x)))), rate)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(100), mel(rate / 2), bands + 2) / 2595) - 1)
    edges = np.floor((size + 1) * hz / rate)  # bands begin and end at whole bins
    low, mid, high = (edges[i : i + bands, None] for i in range(3))
    bin_ = np.arange(size // 2 + 1)
    rise, fall = (bin_ - low) / np.maximum(mid - low, 1), (high - bin_) / np.maximum(high - mid, 1)
    bank = np.clip(np.where(bin_ < mid, rise, fall), 0, None)
    k, n = np.arange(1, 21)[:, None], np.arange(bands)
    cosines = np.sqrt(2 / bands) * np.cos(np.pi * k * (2 * n + 1) / (2 * bands))
    cepstrum = np.log((power + 1e-10) @ bank.T + 1e-6) @ cosines.T
    cepstrum = cepstrum - cepstrum.mean(0)
    v = np.zeros(dims)
    v[:40] = np.concatenate((cepstrum.mean(0), cepstrum.std(0)))
    return v / (np.linalg.norm(v) + 1e-8)


@lru_cache(maxsize=4)
def _tukey(n: int, share: float) -> np.ndarray:
    """Periodic tapered cosine window."""
    at = np.arange(n) / n
    edge = share / 2
    w = np.ones(n)
    w[at < edge] = 0.5 * (1 + np.cos(np.pi * (at[at < edge] / edge - 1)))
    w[at > 1 - edge] = 0.5 * (1 + np.cos(np.pi * ((at[at > 1 - edge] - 1) / edge + 1)))
    return w


def mean_square(x: np.ndarray) -> float:
    """Summed from the first sample on, as columns.mean_square does, so that both agree to the last bit."""
    return float(np.cumsum(np.asarray(x, float) ** 2)[-1]) / len(x)


def xxhash64_ints(values: np.ndarray, seed: int) -> np.ndarray:
    """Spark's xxhash64 of ints, going on from the hash `seed` of the columns before them."""
    turn = lambda h, n: (h << np.uint64(n)) | (h >> np.uint64(64 - n))
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = np.uint64((seed + int(p5) + 4) % 2**64) ^ (values.astype(np.uint32).astype(np.uint64) * p1)
    h = turn(h, 23) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def active(x: np.ndarray, rate: int = 16000) -> np.ndarray:
    """Which samples lie in active 20 ms blocks; all if there is no block."""
    block = int(0.02 * rate)
    n = len(x) // block
    if not n:
        return np.ones(len(x), bool)
    rms = np.sqrt((x[: n * block].reshape(n, block) ** 2).mean(1))
    on = rms >= max(0.008, 0.12 * np.percentile(rms, 85))
    return np.concatenate((np.repeat(on, block), np.zeros(len(x) - n * block, bool)))


@lru_cache(maxsize=4)
def _pink(n: int, rate: int) -> np.ndarray:
    hz = np.fft.rfftfreq(n, 1 / rate)
    return np.sqrt(np.where(hz > 0, hz, 1))


@lru_cache(maxsize=4)
def _hum(n: int, rate: int) -> np.ndarray:
    t = np.arange(n) / rate
    return sum(a * np.sin(2 * np.pi * f * t + p) for f, a, p in HUM)


def noise(kind: str, n: int, rate: int, seed: int, speech: np.ndarray, on: np.ndarray | None = None) -> np.ndarray:
    """Noise of unit loudness over the active part of the speech (on, where that is known)."""
    rng = np.random.default_rng(abs(int(seed)))
    if kind == "white":
        x = rng.standard_normal(n)
    elif kind == "pink":
        x = np.fft.irfft(np.fft.rfft(rng.standard_normal(n)) / _pink(n, rate), n)
    elif kind == "fan":
        x = 0.6 * rng.standard_normal(n) + _hum(n, rate)
    elif kind == "babble":
        x = np.roll(speech, int(7.3 * rate)) + 0.015 * rng.standard_normal(n)
    else:
        raise ValueError(f"unknown noise {kind}")
    on = active(speech, rate) if on is None else on
    loud = np.sqrt((x[on] ** 2).mean()) if on.any() else np.sqrt((x**2).mean())
    return x / max(loud, 1e-12)


def mix(speech: np.ndarray, kind: str, snr_db: float, rate: int, seed: int, on: np.ndarray | None = None) -> np.ndarray:
    if not len(speech):
        return speech
    on = active(speech, rate) if on is None else on
    loud = np.sqrt((speech[on] ** 2).mean()) if on.any() else 0.0
    x = speech + noise(kind, len(speech), rate, seed, speech, on) * loud / 10 ** (snr_db / 20)
    peak = np.abs(x).max()
    return np.clip(x * (0.98 / peak if peak > 0.98 else 1.0), -1, 1)


def encode_pcm16(x: np.ndarray, symmetric: bool = False) -> bytes:
    """16-bit little-endian samples; below zero times 32768 unless symmetric."""
    x = np.clip(np.asarray(x, float), -1, 1)
    return np.where((x < 0) & (not symmetric), x * 32768, x * 32767).astype("<i2").tobytes()


#: beyond so many items the walk along diagonals is tried first, up to so many edits
LONG, FEW = 1000, 150


def _few_edits(a: list, b: list, most: int) -> int | None:
    """The edit distance if it is at most `most`: how far each diagonal is reached with 0, 1, 2... edits. A step along a
    diagonal costs nothing where items agree, so the time is the length, and the square of the edits."""
    number: dict = {}
    x, y = (np.array([number.setdefault(v, len(number)) for v in w], np.int64) for w in (a, b))
    n, m = len(x), len(y)

    def slide(i: int, k: int) -> int:
        step = 16
        while True:
            to = min(step, n - i, m - i - k)
            if to <= 0:
                return i
            differ = np.flatnonzero(x[i : i + to] != y[i + k : i + k + to])
            if len(differ):
                return i + int(differ[0])
            i, step = i + to, step * 4

    reached = {0: slide(0, 0)}  # items of a, by items of b less items of a
    for edits in range(most + 1):
        if reached.get(m - n, -1) >= n:
            return edits
        furthest = {}
        for k in range(-edits - 1, edits + 2):
            i = max(reached.get(k, -2) + 1, reached.get(k - 1, -1), reached.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i >= max(0, -k):
                furthest[k] = slide(i, k)
        reached = furthest
    return None


def edit_distance(a: list, b: list) -> int:
    """Fewest insertions, deletions and replacements that make b of a.

    Long lists with few edits are walked along diagonals. The others are done bit-parallel: the differences between neighbours of a column of the table are the bits of two long integers, and an item
    of b moves them all at once, so n x m table entries cost n x m / 64 word operations; what both begin or end with is left out.
    """
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    if m > LONG and (few := _few_edits(a, b, FEW)) is not None:
        return few
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    where = {}
    for x in set(b) & set(places):
        bits = bytearray(m // 8 + 1)
        for i in places[x]:
            bits[i >> 3] |= 1 << (i & 7)
        where[x] = int.from_bytes(bits, "little")
    all_, last = (1 << m) - 1, m - 1
    up, down, score = all_, 0, m  # where a column's entries rise and fall by one
    for x in b:
        same = where.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (all_ & ~(diagonal | up)), up & diagonal
        score += (rise >> last & 1) - (fall >> last & 1)
        rise, fall = (rise << 1 | 1) & all_, (fall << 1) & all_
        up, down = fall | (all_ & ~(diagonal | rise)), rise & diagonal
    return score
