"""Vectors and signals held as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; unequal lengths or a zero vector raise."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(norm == 0, F.raise_error(F.lit("a vector is zero")).cast("double")).otherwise(_dot(a, b) / norm)
    )


def si_sdr(reference: Column, estimate: Column, task: str = "se") -> Column:
    """Scale-invariant signal-to-distortion ratio in dB of the common length, means removed.

    se: a silent reference raises, a perfect estimate is 100. tse: silent is 0, perfect is +inf, no trace of the target -inf.
    """
    n = F.least(F.size(reference), F.size(estimate))
    r, e = F.slice(reference, F.lit(1), n), F.slice(estimate, F.lit(1), n)
    # sums over the raw samples, so that no lambda holds another array's sum
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    mr, me = total(r) / n, total(e) / n
    power, all_, both = _dot(r, r) - n * mr * mr, _dot(e, e) - n * me * me, _dot(r, e) - n * mr * me
    signal = F.try_divide(both * both, power)
    rest = all_ - signal
    rest = F.when(rest <= 1e-13 * all_, 0.0).otherwise(rest)  # what rounding leaves of nothing
    tiny = F.lit(1e-8)
    if task == "se":
        return F.when(power <= tiny, F.raise_error(F.lit("the reference is silent")).cast("double")).when(rest <= tiny, 100.0).otherwise(10 * F.log10((signal + tiny) / (rest + tiny)))
    return F.when(power <= 1e-30, 0.0).when(rest == 0, F.lit(float("inf"))).when(signal == 0, F.lit(float("-inf"))).otherwise(10 * F.log10(signal / rest))


def max_frame(scores: Column) -> Column:
    """The largest of an array; 0 for none."""
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def calibrated(x: Column, coefficients: tuple[float, ...]) -> Column:
    """A polynomial, the highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def relative_score(score: Column, baseline: Column, higher_is_better: Column, rate: Column) -> Column:
    """Score over baseline, or baseline over score where lower is better (0 gives +inf). Baselines of rates are percents."""
    base = F.when(rate, baseline / 100).otherwise(baseline)
    mine = F.when(rate & higher_is_better & (score > 1), score / 100).otherwise(score)
    return F.when(base.isNull() | mine.isNull(), None).when(higher_is_better, F.try_divide(mine, base)).when(mine == 0, F.lit(float("inf"))).otherwise(base / mine)


def finite_mean(x: Column) -> Column:
    """Mean of the finite values; +inf where all are infinite."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.avg(F.when(fine, x)), F.when(F.count(x) > 0, F.lit(float("inf"))))


def milliseconds(begin: Column, end: Column) -> Column:
    return F.round((end - begin) * 1000).cast("int")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resample(samples: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    """Linear resampling on grids without end points."""

    def one(x, a, b):
        if x is None or a == b or not len(x):
            return x
        x = np.asarray(x, float)
        n = max(1, round(len(x) * b / a))
        return np.interp(np.linspace(0, len(x) / a, n, endpoint=False), np.linspace(0, len(x) / a, len(x), endpoint=False), x)

    return pd.Series([one(x, a, b) for x, a, b in zip(samples, source, target)])


def polyphase(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up/down times its rate: zeros between samples, a windowed-sinc low-pass (Kaiser, 5), every down-th sample of the result."""
    k = np.gcd(up, down)
    up, down = up // k, down // k
    if up == down:
        return np.asarray(x, float)
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    low = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    low *= up / low.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    n, size = -(-len(x) * up // down), len(wide) + 2 * half
    fft = 1 << int(size).bit_length()
    full = np.fft.irfft(np.fft.rfft(wide, fft) * np.fft.rfft(low, fft), fft)[half : half + len(wide)]
    return full[::down][:n]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resample_polyphase(samples: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    """Resampling by rational factors with a polyphase low-pass."""
    return pd.Series([x if x is None or not len(x) else polyphase(np.asarray(x, float), int(b), int(a)) for x, a, b in zip(samples, source, target)])


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[:-1:hop] if len(x) > size else np.zeros((0, size))


def intelligibility(clean: np.ndarray, heard: np.ndarray, rate: int) -> float:
    """Short-time objective intelligibility (Taal and others, 2011): mean correlation of one-third octave envelopes over 384 ms.

    Frames more than 40 dB below the loudest clean one are left out; 1e-5 where fewer than 30 are left. The rate becomes 10 kHz.
    """
    x, y = (polyphase(np.asarray(a, float), 10_000, rate) for a in (clean, heard))
    n = min(len(x), len(y))
    window = np.hanning(258)[1:-1]
    a, b = (_frames(s[:n], 256, 128) * window for s in (x, y))
    level = 20 * np.log10(np.linalg.norm(a, axis=1) + 1e-12)
    loud = level > level.max(initial=-np.inf) - 40
    joined = []
    for f in (a[loud], b[loud]):
        out = np.zeros(128 * (len(f) + 1))
        for i, frame in enumerate(f):
            out[128 * i : 128 * i + 256] += frame
        joined.append(np.abs(np.fft.rfft(_frames(out, 256, 128) * window, 512)) ** 2)
    freq = np.linspace(0, 5_000, 257)
    middle = 150 * 2.0 ** (np.arange(15) / 3)
    bands = np.zeros((15, 257))
    for i, m in enumerate(middle):
        lo, hi = (np.argmin((freq - m * 2.0**e) ** 2) for e in (-1 / 6, 1 / 6))
        bands[i, lo:hi] = 1
    a, b = (np.sqrt(p @ bands.T).T for p in joined)  # band x frame
    if a.shape[1] < 30:
        return 1e-5
    u, v = (np.lib.stride_tricks.sliding_window_view(e, 30, axis=1) for e in (a, b))
    v = np.minimum(v * (np.linalg.norm(u, axis=2, keepdims=True) / (np.linalg.norm(v, axis=2, keepdims=True) + 1e-15)), u * (1 + 10 ** (15 / 20)))
    u, v = (e - e.mean(2, keepdims=True) for e in (u, v))
    return float(((u * v).sum(2) / (np.linalg.norm(u, axis=2) * np.linalg.norm(v, axis=2) + 1e-15)).mean())


@F.pandas_udf(T.DoubleType())
def stoi(reference: pd.Series, estimate: pd.Series, rate: pd.Series) -> pd.Series:
    """Short-time objective intelligibility of estimates against clean references."""
    return pd.Series([None if r is None or e is None else intelligibility(r, e, int(f)) for r, e, f in zip(reference, estimate, rate)], dtype=float)


@F.pandas_udf(T.DoubleType())
def sliding_mean(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Mean root-mean-square level over 9.01 s windows, 1 s apart; a short clip repeats itself, a short tail is left out."""

    def one(x, rate):
        if x is None or not len(x):
            return None
        x, size = np.asarray(x, float), int(9.01 * rate)
        while len(x) < size:
            x = np.concatenate([x, x])
        hops = int(np.floor(len(x) / rate) - 9.01) + 1
        parts = [x[i * rate : i * rate + size] for i in range(max(hops, 1))]
        return float(np.mean([np.sqrt(np.mean(p**2)) for p in parts if len(p) == size]))

    return pd.Series([one(x, r) for x, r in zip(samples, rate)], dtype=float)
