"""Mel-frequency cepstra of clips, as one vectorised pandas function, and other kernels that need an FFT or recursion."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import params as P


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mel filterbank (triangles between FFT bins), orthonormal DCT-II, symmetric Hann window."""
    mel = np.linspace(2595 * np.log10(1 + P.FMIN / 700), 2595 * np.log10(1 + P.FMAX / 700), P.NUM_MEL + 2)
    edge = np.floor((P.NFFT + 1) * 700 * (10 ** (mel / 2595) - 1) / P.SAMPLE_RATE)
    k = np.arange(P.NFFT // 2 + 1)
    low, mid, high = edge[:-2, None], edge[1:-1, None], edge[2:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        bank = np.where((k >= low) & (k < mid), (k - low) / (mid - low), np.where((k >= mid) & (k < high), (high - k) / (high - mid), 0.0))
    n = np.arange(P.NUM_MEL)
    dct = np.cos(np.pi / P.NUM_MEL * (n + 0.5) * np.arange(P.NUM_MFCC)[:, None]) * np.sqrt(2 / P.NUM_MEL)
    dct[0] = np.sqrt(1 / P.NUM_MEL)
    return bank.astype(np.float32), dct.astype(np.float32), np.hanning(P.FRAME_LEN).astype(np.float32)


def mfcc_of(pcm: np.ndarray) -> np.ndarray:
    """(clips, samples) of 16 bits to (clips, frames, coefficients)."""
    bank, dct, hann = tables()
    x = pcm.astype(np.float32) / np.float32(32768)
    x = np.concatenate([x[:, :1], x[:, 1:] - np.float32(P.PREEMPHASIS) * x[:, :-1]], axis=1)
    framed = np.lib.stride_tricks.sliding_window_view(x, P.FRAME_LEN, axis=1)[:, :: P.STRIDE_LEN] * hann
    spectrum = np.fft.rfft(framed, n=P.NFFT, axis=2)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    logmel = np.log(power.astype(np.float64) @ bank.T.astype(np.float64) + P.LOG_FLOOR).astype(np.float32)
    return (logmel.astype(np.float64) @ dct.T.astype(np.float64)).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def mfcc(pcm: pd.Series) -> pd.Series:
    """MFCC of clips of exactly one second; null for other lengths and nulls."""
    out = pd.Series([None] * len(pcm), dtype=object)
    ok = [i for i, x in enumerate(pcm) if x is not None and len(x) == P.CLIP_SAMPLES]
    for at in range(0, len(ok), 64):
        block = ok[at : at + 64]
        for i, m in zip(block, mfcc_of(np.stack([np.asarray(pcm.iloc[i]) for i in block])), strict=True):
            out.iloc[i] = [row.tolist() for row in m]
    return out


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """Band-limited resampling of a periodic signal to n samples, in the frequency domain."""
    have = np.fft.rfft(x)
    bins = n // 2 + 1
    want = np.zeros(bins, complex)
    m = min(bins, len(have))
    want[:m] = have[:m]
    short = min(n, len(x))
    if short % 2 == 0 and n != len(x):
        want[short // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(want, n) * (n / len(x))


def speed(factor: float):
    """A pandas function that plays samples `factor` times as fast."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else resampled(np.asarray(v, float), int(round(len(v) / factor))).tolist() if len(v) else [])

    return run


def shelf(gain_db: float, cutoff_hz: float = 500.0) -> tuple[list[float], list[float]]:
    """Coefficients (b0, b1, b2), (a1, a2) of the published low-shelf biquad, shelf slope 1."""
    a = 10 ** (gain_db / 40)
    w = 2 * np.pi * cutoff_hz / P.SAMPLE_RATE
    c, s = np.cos(w), 2 * np.sqrt(a) * np.sin(w) / 2 * np.sqrt(2)
    b = a * (a + 1 - (a - 1) * c + s), 2 * a * (a - 1 - (a + 1) * c), a * (a + 1 - (a - 1) * c - s)
    a0 = a + 1 + (a - 1) * c + s
    return [float(x / a0) for x in b], [float(-2 * (a - 1 + (a + 1) * c) / a0), float((a + 1 + (a - 1) * c - s) / a0)]


def filtered(x: np.ndarray, b: list[float], a: list[float]) -> np.ndarray:
    """A biquad over samples, as a scan over blocks: all blocks are filtered at once as if each began in silence, the two
    values that a block hands to the next go from block to block, and what they add is a fixed response in each."""
    n = len(x)
    size = max(2, int(np.sqrt(n)))
    u = b[0] * x
    u[1:] += b[1] * x[:-1]
    u[2:] += b[2] * x[:-2]
    y = np.concatenate([u, np.zeros(-n % size)]).reshape(-1, size)
    one, two = np.zeros(size + 2), np.zeros(size + 2)  # of a last value of 1, of one before it; behind two values of the past
    one[1], two[0] = 1.0, 1.0
    for h in one, two:
        for t in range(2, size + 2):
            h[t] = -a[0] * h[t - 1] - a[1] * h[t - 2]
    one, two = one[2:], two[2:]
    for t in range(1, size):
        y[:, t] -= a[0] * y[:, t - 1] + (a[1] * y[:, t - 2] if t > 1 else 0)
    last, before = np.zeros(len(y)), np.zeros(len(y))
    for i in range(1, len(y)):
        p, q = last[i - 1], before[i - 1]
        last[i], before[i] = y[i - 1, -1] + one[-1] * p + two[-1] * q, y[i - 1, -2] + one[-2] * p + two[-2] * q
    return (y + last[:, None] * one + before[:, None] * two).ravel()[:n]


def low_shelf(gain_db: float, cutoff_hz: float = 500.0):
    """A pandas function with the low shelf, clipped to [-1, 1]."""
    b, a = shelf(gain_db, cutoff_hz)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.clip(filtered(np.asarray(v, float), b, a), -1.0, 1.0).tolist() if len(v) else [])

    return run
