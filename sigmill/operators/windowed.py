"""Operators that need a whole window at once: recursive filters, Fourier filters, resampling, own functions.

A window is gathered into one array (its length is the window definition's, not the stream's) and handed to numpy in
Arrow batches of many windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_arrays(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """key, x: the window's samples in order."""
    return df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("double")).alias("x"))


def as_samples(df: DataFrame, key: list[str], value: str = "value", order: str = "k") -> DataFrame:
    return df.select(*key, F.posexplode("x").alias(order, value)).withColumn(order, F.col(order).cast("long"))


def each(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str = "x") -> DataFrame:
    """Applies f to every array; equally long ones go through it together as rows of a matrix."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        out: list = [None] * len(xs)
        size = xs.map(len)
        for n in size.unique():
            at = np.flatnonzero(size == n)
            y = f(np.array(xs.iloc[at].tolist(), float).reshape(len(at), n)) if n else np.zeros((len(at), 0))
            for i, row in zip(at, y.tolist()):
                out[i] = row
        return pd.Series(out, dtype=object)

    return df.withColumn(column, run(column))


def lfilter(b: list[float], a: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    """Direct-form recursive filter along rows, zero initial state."""
    b, a = np.array(b, float) / a[0], np.array(a, float) / a[0]

    def run(x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for t in range(x.shape[1]):
            for k in range(len(b)):
                if t - k >= 0:
                    y[:, t] += b[k] * x[:, t - k]
            for k in range(1, len(a)):
                if t - k >= 0:
                    y[:, t] -= a[k] * y[:, t - k]
        return y

    return run


def dc_removal(alpha: float = 0.95) -> Callable[[np.ndarray], np.ndarray]:
    return lfilter([1.0, -1.0], [1.0, -alpha])


def butterworth(order: int, cutoff: float) -> tuple[list[float], list[float]]:
    """Low-pass coefficients (b, a) for a cut-off as a share of the Nyquist frequency: bilinear transform of the analogue poles."""
    warped = 4 * np.tan(np.pi * cutoff / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    z = (4 + poles) / (4 - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(-np.ones(order)))
    return [float(x) for x in b * a.sum() / b.sum()], [float(x) for x in a]


def _moduli(k: float) -> list[float]:
    """Landen's descending moduli: elliptic functions of modulus k become circular ones along them."""
    out = []
    while k > 1e-15:
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _ascend(w, k: float):
    for v in reversed(_moduli(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _cd(u, k: float):
    """Jacobi's cd at u quarter periods."""
    return _ascend(np.cos(u * np.pi / 2), k)


def _sn(u, k: float):
    return _ascend(np.sin(u * np.pi / 2), k)


def _inverse_sn(w: complex, k: float) -> complex:
    for before, v in zip([k, *_moduli(k)], _moduli(k)):
        w = w / (1 + np.sqrt(1 - (w * before) ** 2)) * 2 / (1 + v)
    return 2 / np.pi * np.arcsin(w)


def elliptic(order: int, band: float | tuple[float, float], loss: float = 0.5, stop: float = 60.0) -> tuple[list[float], list[float]]:
    """Coefficients (b, a) of an elliptic low-pass (band: its edge) or band-pass (both edges; twice the order), edges as
    shares of the Nyquist frequency. loss: the largest loss in the pass band, stop: the least in the stop band, in dB.

    The analogue prototype has its poles and zeros at values of elliptic functions whose modulus solves the degree
    equation; the band and the bilinear transform map them.
    """
    ripple = math.sqrt(10 ** (loss / 10) - 1)
    k1 = ripple / math.sqrt(10 ** (stop / 10) - 1)
    u = (2 * np.arange(1, order // 2 + 1) - 1) / order
    other = math.sqrt(1 - k1 * k1)
    k = math.sqrt(1 - (other**order * float(np.prod(_sn(u, other))) ** 4) ** 2)
    v0 = -1j * _inverse_sn(1j / ripple, k1) / order
    zeros = 1j / (k * _cd(u, k))
    poles = 1j * _cd(u - 1j * v0, k)
    zeros, poles = np.r_[zeros, zeros.conj()], np.r_[poles, poles.conj()]
    if order % 2:
        poles = np.r_[poles, 1j * _sn(1j * v0, k)]
    open_ = order - len(zeros)  # zeros at infinity
    if isinstance(band, tuple):
        low, high = (math.tan(math.pi * x / 2) for x in band)
        pair = lambda s: np.concatenate([np.roots([1.0, -x * (high - low), low * high]) for x in s])
        zeros, poles, centre = np.r_[pair(zeros) if len(zeros) else [], np.zeros(open_)], pair(poles), 1j * math.sqrt(low * high)
    else:
        zeros, poles, centre = zeros * math.tan(math.pi * band / 2), poles * math.tan(math.pi * band / 2), 0.0
    plane = lambda s: (1 + s) / (1 - s)
    b, a = np.real(np.poly(np.r_[plane(zeros), -np.ones(open_)])), np.real(np.poly(plane(poles)))
    gain = 1.0 if order % 2 else 10 ** (-loss / 20)
    at = plane(centre)
    return [float(x) for x in b * gain * abs(np.polyval(a, at) / np.polyval(b, at))], [float(x) for x in a]


def both_ways(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Forward and backward: no phase shift."""
    return lambda x: f(f(x)[:, ::-1])[:, ::-1]


def decimate(f: Callable[[np.ndarray], np.ndarray], k: int) -> Callable[[np.ndarray], np.ndarray]:
    """Every k-th sample of what a (low-pass) filter leaves."""
    return lambda x: f(x)[:, ::k]


def daubechies(order: int) -> list[float]:
    """Low-pass kernel of 2 order taps with order vanishing moments (order 1 is Haar): the roots inside the unit circle of the half-band polynomial."""
    p = [math.comb(order - 1 + k, k) for k in range(order)]
    zeros = []
    for y in np.roots(p[::-1]):
        pair = np.roots([1.0, 4 * y - 2, 1.0])
        zeros.append(pair[np.argmin(np.abs(pair))])
    h = np.real(np.poly([-1.0] * order + zeros))
    return [float(x) for x in h * math.sqrt(2) / h.sum()]


def dwt(kernel: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    """One level of the wavelet transform with mirrored borders: approximation, then detail, floor((n + taps - 1) / 2) each."""
    low = np.array(kernel)
    high = low * (-1.0) ** (np.arange(len(low)) + 1)

    def run(x: np.ndarray) -> np.ndarray:
        n, taps = x.shape[1], len(low)
        at = (2 * np.arange((n + taps - 1) // 2)[:, None] + 1 - np.arange(taps)) % (2 * n)
        near = x[:, np.where(at < n, at, 2 * n - 1 - at)]
        return np.concatenate([near @ low[::-1], near @ high], axis=1)

    return run


def fft_bandpass(low: float, high: float, fs: float) -> Callable[[np.ndarray], np.ndarray]:
    """Keeps the frequencies in [low, high]."""

    def run(x: np.ndarray) -> np.ndarray:
        spectrum, f = np.fft.rfft(x, axis=1), np.fft.rfftfreq(x.shape[1], 1 / fs)
        spectrum[:, (f < low) | (f > high)] = 0
        return np.fft.irfft(spectrum, x.shape[1], axis=1)

    return run


def fft_resample(size: int) -> Callable[[np.ndarray], np.ndarray]:
    """To size samples, by cutting or padding the spectrum."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        spectrum = np.fft.rfft(x, axis=1)
        keep = min(n, size) // 2 + 1
        out = np.zeros((len(x), size // 2 + 1), complex)
        out[:, :keep] = spectrum[:, :keep]
        if min(n, size) % 2 == 0 and n != size:  # the lone bin at the smaller Nyquist frequency
            out[:, keep - 1] *= 1.0 if n > size else 0.5
        return np.fft.irfft(out, size, axis=1) * size / n

    return run


def detrend_linear(x: np.ndarray) -> np.ndarray:
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    slope = x @ t / max(float(t @ t), 1e-300)
    return x - x.mean(1, keepdims=True) - slope[:, None] * t
