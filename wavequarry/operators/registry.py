"""Filters by name, for views and users; register() adds one."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequential, spectral, windows

Filter = Callable[[DataFrame], DataFrame]


def box(n: int) -> list[float]:
    return [1.0 / n] * n


def delayed(n: int) -> list[float]:
    """Taps that pass the value n samples before."""
    return [1.0, *[0.0] * n]


def low_pass_taps(n: int, cut: float) -> list[float]:
    """Windowed sinc of n taps with its cut at that share of the sample rate, 1 at zero frequency."""
    k = np.arange(n) - (n - 1) / 2
    h = 2 * cut * np.sinc(2 * cut * k) * spectral.window(n, "Hamming")
    return (h / h.sum()).tolist()


def high_pass_taps(n: int, cut: float) -> list[float]:
    """What a low pass of an odd number of taps leaves."""
    h = -np.array(low_pass_taps(n, cut))
    h[n // 2] += 1
    return h.tolist()


def notch_taps(n: int, low: float, high: float) -> list[float]:
    return (np.array(low_pass_taps(n, low)) + np.array(high_pass_taps(n, high))).tolist()


def weighting_taps(kind: str, sps: float, width: int = 256) -> list[float]:
    """Taps of A, B or C weighting at a sample rate."""
    return spectral.fir_taps(width, lambda n: spectral.weighting(kind, np.arange(n) * sps / 2 / (n - 1))).tolist()


def _centred(taps: list[float]) -> Filter:
    return lambda s: windows.centred_fir(s, taps)


#: Named tables of taps, made by rule.
TAPS: dict[str, list[float]] = {
    "None": [1.0], **{f"Box {n}": box(n) for n in (4, 10, 20)}, **{f"Delay {n}": delayed(n) for n in (1, 5, 10, 20)},
    **{f"Lpf {c:g}": low_pass_taps(63, c) for c in (0.01, 0.02, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4)}, **{f"Hpf {c:g}": high_pass_taps(63, c) for c in (0.05, 0.1, 0.25)},
    "Notch 0.1": notch_taps(63, 0.08, 0.12), "Notch 0.2": notch_taps(63, 0.18, 0.22),
}
FILTERS: dict[str, Filter] = {
    "None": lambda s: s.withColumn("out", F.col("value")), "RMS 100": lambda s: windows.moving_rms(s, 100), "RMS 1000": lambda s: windows.moving_rms(s, 1000),
    "SG 10/3": lambda s: windows.savitzky_golay(s, 10, 3), "SG 20/5": lambda s: windows.savitzky_golay(s, 20, 5), "SG 50/5": lambda s: windows.savitzky_golay(s, 50, 5),
    "A 48k": _centred(weighting_taps("A", 48000.0, 64)), "C 48k": _centred(weighting_taps("C", 48000.0, 64)), "Bessel": lambda s: sequential.linear_filter(s, sequential.bessel_band_pass()),
    "Limiter": lambda s: windows.limiter(s, -1.0, 1.0), "ProgressiveLimiter": windows.progressive_limiter, **{n: _centred(t) for n, t in TAPS.items() if n != "None"},
}


def register(name: str, f: Filter | list[float]) -> None:
    """A filter of one's own, or taps for a centred one."""
    FILTERS[name] = _centred(f) if isinstance(f, list) else f


def filtered(s: DataFrame, name: str) -> DataFrame:
    """The filter of that name over samples; an unknown name raises KeyError."""
    return FILTERS[name](s)


#: Spectral filters of whole traces by name: gain over the bins of a transform of n samples at a rate.
SPECTRAL: dict[str, Callable[..., np.ndarray]] = {
    "BandPass": lambda bins, n, sps, low, high: spectral.band_pass_3db(bins, spectral.hz_to_bin(low, n, sps), spectral.hz_to_bin(high, n, sps), "RaisedCosine"),
    "Notch": lambda bins, n, sps, low, high: spectral.notch_3db(bins, spectral.hz_to_bin(low, n, sps), spectral.hz_to_bin(high, n, sps), "RaisedCosine"),
    "LowPass": lambda bins, n, sps, low, high: spectral.low_pass(bins, math.sqrt(0.5), spectral.hz_to_bin(low, n, sps), 0.5, spectral.hz_to_bin(high, n, sps), "RaisedCosine"),
    "HighPass": lambda bins, n, sps, low, high: spectral.high_pass(bins, 0.5, spectral.hz_to_bin(low, n, sps), math.sqrt(0.5), spectral.hz_to_bin(high, n, sps), "RaisedCosine"),
    "A": lambda bins, n, sps: spectral.weighting("A", np.arange(bins) * sps / n), "C": lambda bins, n, sps: spectral.weighting("C", np.arange(bins) * sps / n),
}


def spectral_filtered(f: DataFrame, name: str, width: int, sps: float, *hz: float) -> DataFrame:
    """Frames of that width through the spectral filter of that name."""
    return spectral.filtered(f, lambda bins: SPECTRAL[name](bins, width, sps, *hz))
