"""Fourier transforms of whole traces, of any length, without a trace in one task.

The transform of n samples is a convolution with a chirp (a wave of rising frequency), which is worked out by transforms of a
power of two m >= 2 n - 1. Such a transform takes four steps: m samples are a matrix of m1 rows and m2 columns; columns are
transformed, turned by a twiddle, dealt anew by rows, and rows are transformed. Each task holds a block of columns or rows, so a
trace of a million million samples takes blocks of a million.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few, written

#: Complex values that a block of columns or of rows holds, a power of two: 2 MB, of which a task has some dozens at a time.
VALUES = 1 << 17
PLAN = ["n", "m1", "m2"]


def turned(place: np.ndarray, of: int, sign: float) -> np.ndarray:
    """exp(sign 2 pi i place / of), place reduced in whole numbers first."""
    return np.exp(sign * 2j * np.pi * ((place % of) / of))


def chirp(k: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi i k^2 / n): k^2 modulo 2 n by digits of 20 bits, so that it stays exact for k below 2^40."""
    whole, rest = 2 * n, np.zeros_like(k)
    for shift in (40, 20, 0):
        rest = ((rest << 20) % whole + k * ((k >> shift) & 0xFFFFF) % whole) % whole
    return np.exp(-1j * np.pi * (rest / n))


def plan_of(z: DataFrame) -> DataFrame:
    """trace, n, m1, m2: m1 m2 = m is the least power of two from 2 n - 1 on, m1 is m2 or twice as much."""
    n = z.groupBy("trace").agg(F.count("*").alias("n"))
    bits = F.length(F.regexp_replace(F.bin(2 * F.col("n") - 2), "^0$", ""))  # of 2 n - 2, none for n = 1
    power = lambda k: F.pow(F.lit(2.0), k).cast("long")
    return written(n.select("trace", "n", power(bits - F.floor(bits / 2)).alias("m1"), power(F.floor(bits / 2)).alias("m2")), "transform_plan")


def tiles(trace: str, plan: dict[str, int], start: int, arrays: list[np.ndarray], width: int) -> pa.Table:
    """Blocks of `width` columns of arrays whose rows begin at start, as rows (part, at, data of each)."""
    parts = range(-(-arrays[0].shape[1] // width))
    cut = [[np.ascontiguousarray(a[:, p * width : (p + 1) * width]).tobytes() for p in parts] for a in arrays]
    k = len(parts)
    return pa.table({"trace": [trace] * k, **{c: pa.array([v] * k, pa.int64()) for c, v in plan.items()}, "part": pa.array(parts, pa.int64()), "at": pa.array([start] * k, pa.int64()), **{f"x{i}": pa.array(c, pa.binary()) for i, c in enumerate(cut)}})


def joined(t: pa.Table, column: str, length: int) -> np.ndarray:
    """Tiles put together: their columns become rows, `length` long."""
    data = [np.frombuffer(d.as_py(), complex) for d in t[column]]
    deep = sum(map(len, data)) // length
    out = np.zeros((deep, length), complex)
    for a, d in zip(t["at"].to_pylist(), data, strict=True):
        tile = d.reshape(-1, deep)
        out[:, a : a + len(tile)] = tile.T
    return out


def plan_in(t: pa.Table) -> tuple[str, dict[str, int]]:
    return t["trace"][0].as_py(), {c: t[c][0].as_py() for c in PLAN}


def transformed(z: DataFrame, inverse: bool = False, values: int = VALUES, plan: DataFrame | None = None) -> DataFrame:
    """trace, idx, re, im of the transform of (trace, idx, re, im), idx from 0 without gaps: sum of z exp(-2 pi i idx k / n). inverse: the other way, over n. plan: plan_of() of these traces, if it is known."""
    sign = -1.0 if inverse else 1.0  # the inverse is the conjugate of the conjugate's transform
    plan = plan_of(z) if plan is None else plan
    planned = z.join(F.broadcast(plan) if few(plan) else plan, "trace")
    width = F.least("m2", F.greatest(F.lit(1), F.floor(F.lit(values) / F.col("m1"))))
    dealt = planned.withColumn("block", F.floor((F.col("idx") % F.col("m2")) / width))
    narrow = "trace string, n long, m1 long, m2 long, part long, at long"

    def columns(t: pa.Table) -> pa.Table:
        """Columns of the samples, turned by the chirp, and of the chirp that they meet."""
        trace, p = plan_in(t)
        n, m1, m2 = p.values()
        idx = t["idx"].to_numpy()
        wide = min(m2, max(1, values // m1))
        start = int(t["block"][0].as_py()) * wide
        x = np.zeros((wide, m1), complex)
        x[idx % m2 - start, idx // m2] = (t["re"].to_numpy() + sign * 1j * t["im"].to_numpy()) * chirp(idx, n)
        column = np.arange(start, start + wide)[:, None]
        place = column + m2 * np.arange(m1)[None, :]
        near = np.minimum(place, m1 * m2 - place)
        other = np.where(near < n, np.conj(chirp(np.minimum(near, n - 1), n)), 0)
        twist = turned(column * np.arange(m1)[None, :], m1 * m2, -1.0)
        return tiles(trace, p, start, [np.fft.fft(a, axis=1) * twist for a in (x, other)], max(1, values // m2))

    def rows(t: pa.Table) -> pa.Table:
        """Rows of both spectra, multiplied and transformed back along the row."""
        trace, p = plan_in(t)
        _, m1, m2 = p.values()
        x, other = (np.fft.fft(joined(t, c, m2), axis=1) for c in ("x0", "x1"))
        start = t["part"][0].as_py() * max(1, values // m2)
        row = np.arange(start, start + len(x))[:, None]
        back = np.fft.ifft(x * other, axis=1) * turned(row * np.arange(m2)[None, :], m1 * m2, 1.0)
        return tiles(trace, p, start, [back], min(m2, max(1, values // m1)))

    def out(t: pa.Table) -> pa.Table:
        """Columns transformed back: the samples of the result."""
        trace, p = plan_in(t)
        n, m1, m2 = p.values()
        y = np.fft.ifft(joined(t, "x0", m1), axis=1)
        start = t["part"][0].as_py() * min(m2, max(1, values // m1))
        idx = (np.arange(start, start + len(y))[:, None] + m2 * np.arange(m1)[None, :]).ravel()
        keep = idx < n
        idx = idx[keep]
        z = y.ravel()[keep] * chirp(idx, n) / (n if inverse else 1)
        return pa.table({"trace": [trace] * len(idx), "idx": idx, "re": z.real, "im": sign * z.imag})

    first = dealt.groupBy("trace", "block").applyInArrow(columns, f"{narrow}, x0 binary, x1 binary")
    second = first.groupBy("trace", "part").applyInArrow(rows, f"{narrow}, x0 binary")
    return second.groupBy("trace", "part").applyInArrow(out, "trace string, idx long, re double, im double")


def complex_samples(s: DataFrame) -> DataFrame:
    return s.select("trace", "idx", F.col("value").alias("re"), F.lit(0.0).alias("im"))


def whole_spectrum(s: DataFrame, values: int = VALUES) -> DataFrame:
    """trace, bin, re, im, magnitude, phase of each trace as a whole: bins from 0 to half its length, over its length."""
    plan = plan_of(s)
    z, n = transformed(complex_samples(s), values=values, plan=plan), plan.select("trace", "n")
    rows = z.join(F.broadcast(n) if few(n) else n, "trace").where(F.col("idx") <= F.floor(F.col("n") / 2))
    re, im = F.col("re") / F.col("n"), F.col("im") / F.col("n")
    return rows.select("trace", F.col("idx").alias("bin"), re.alias("re"), im.alias("im"), F.hypot(re, im).alias("magnitude"), F.atan2(im, re).alias("phase"))


def whole_filtered(s: DataFrame, gain: Callable[[Column, Column], Column], values: int = VALUES) -> DataFrame:
    """trace, idx, out: each trace filtered as a whole, its bins times gain(bin, n), which is asked for bins up to half the length n."""
    plan = plan_of(s)
    z, n = transformed(complex_samples(s), values=values, plan=plan), plan.select("trace", "n")
    rows = z.join(F.broadcast(n) if few(n) else n, "trace")
    g = gain(F.least("idx", F.col("n") - F.col("idx")), F.col("n"))
    back = transformed(rows.select("trace", "idx", (F.col("re") * g).alias("re"), (F.col("im") * g).alias("im")), inverse=True, values=values, plan=plan)
    return back.select("trace", "idx", F.col("re").alias("out"))
