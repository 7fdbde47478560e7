"""Calculations across traces: samples meet by idx."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BLOCK, running_sum
from ..session import few, written
from . import lookup, spectral, windows


def all_present(s: DataFrame, traces: list[str], combine: Callable[[], Column]) -> DataFrame:
    """At each idx, over those of the traces that still have a sample: one combinable aggregate, no joins."""
    if len(traces) < 2:
        raise ValueError("two traces or more are needed")
    return s.where(F.col("trace").isin(traces)).groupBy("idx").agg(combine().alias("out"))


def magnitude(s: DataFrame, traces: list[str]) -> DataFrame:
    return all_present(s, traces, lambda: F.sqrt(F.sum(F.col("value") * F.col("value"))))


def total(s: DataFrame, traces: list[str]) -> DataFrame:
    return all_present(s, traces, lambda: F.sum("value"))


def mean(s: DataFrame, traces: list[str]) -> DataFrame:
    return all_present(s, traces, lambda: F.avg("value"))


def product(s: DataFrame, traces: list[str]) -> DataFrame:
    return all_present(s, traces, lambda: F.product("value"))


def both(s: DataFrame, a: str, b: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """At each idx that both traces have."""
    left = s.where(F.col("trace") == a).select("idx", F.col("value").alias("a"))
    right = s.where(F.col("trace") == b).select("idx", F.col("value").alias("b"))
    return left.join(right, "idx").select("idx", combine(F.col("a"), F.col("b")).alias("out"))


def atan2(s: DataFrame, a: str, b: str) -> DataFrame:
    return both(s, a, b, F.atan2)


def difference(s: DataFrame, a: str, b: str) -> DataFrame:
    return both(s, a, b, lambda x, y: F.abs(x - y))


def subtract(s: DataFrame, a: str, b: str) -> DataFrame:
    return both(s, a, b, lambda x, y: x - y)


def xy(s: DataFrame, a: str, b: str) -> DataFrame:
    """Points of a parametric plot."""
    return both(s, a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))).select("idx", "out.x", "out.y")


def xyz(s: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Points in space, at each idx that all three traces have."""
    part = lambda t, n: s.where(F.col("trace") == t).select("idx", F.col("value").alias(n))
    return part(a, "x").join(part(b, "y"), "idx").join(part(c, "z"), "idx")


def spread(s: DataFrame, f: Callable[[], list[Column]]) -> DataFrame:
    """Samples with aggregates of their whole trace (a row a trace, joined back)."""
    return s.join(s.groupBy("trace").agg(*f()), "trace")


def rescaled(s: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Each trace from its least and greatest value to low and high; a flat one to low."""
    r = spread(s, lambda: [F.min("value").alias("__lo"), F.max("value").alias("__hi")])
    out = F.when(F.col("__hi") == F.col("__lo"), low).otherwise((F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (high - low) + low)
    return r.withColumn("out", out).drop("__lo", "__hi")


def rescaled_to_peak(s: DataFrame, high: float) -> DataFrame:
    """Each trace times high over the greater of its maximum and its negated minimum."""
    r = spread(s, lambda: [F.greatest(-F.min("value"), F.max("value")).alias("__p")])
    return r.withColumn("out", F.col("value") * high / F.col("__p")).drop("__p")


def normalised(s: DataFrame) -> DataFrame:
    """Each trace over its L2 norm."""
    r = spread(s, lambda: [F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__n")])
    return r.withColumn("out", F.when(F.col("__n") != 0, F.col("value") / F.col("__n")).otherwise(float("nan"))).drop("__n")


def rescaled_error(s: DataFrame, a: str, b: str) -> DataFrame:
    """Difference of the two traces, each rescaled to 0..1 over its whole length."""
    r = rescaled(s.where(F.col("trace").isin(a, b)))
    return both(r.drop("value").withColumnRenamed("out", "value"), a, b, lambda x, y: x - y)


def normalised_error(s: DataFrame, a: str, b: str) -> DataFrame:
    r = normalised(s.where(F.col("trace").isin(a, b)))
    return both(r.drop("value").withColumnRenamed("out", "value"), a, b, lambda x, y: x - y)


def quantised(s: DataFrame, offset: float = 1.0, scale: float = 32767.0) -> DataFrame:
    """round((value - offset) * scale) / scale, halves away from zero; the offset isn't added again."""
    return s.withColumn("out", F.round((F.col("value") - offset) * scale) / scale)


def poly_filtered(s: DataFrame, order: int = 5) -> DataFrame:
    """The polynomial that fits the whole trace best, at each sample: trace, idx, out.

    One aggregate of sums of Chebyshev polynomials of the place (from -1 to 1 over the trace), their products with each other and
    with the values; a small system of equations a trace; then each sample is worked out from its trace's coefficients. A trace
    with fewer samples than coefficients gets the smallest solution, which meets its samples.
    """
    n = written(s.groupBy("trace").agg(F.max("idx").alias("top")), "poly_lengths")
    rows = s.join(F.broadcast(n) if few(n) else n, "trace").withColumn("u", F.when(F.col("top") == 0, 0.0).otherwise(2.0 * F.col("idx") / F.col("top") - 1.0))
    basis = lambda u: [F.lit(1.0), u] + [F.cos(k * F.acos(F.greatest(F.least(u, F.lit(1.0)), F.lit(-1.0)))) for k in range(2, order + 1)]
    t = basis(F.col("u"))[: order + 1]
    size = order + 1
    sums = [F.sum(t[i] * t[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i + 1)] + [F.sum(t[i] * F.col("value")).alias(f"b{i}") for i in range(size)]
    names = [f"g{max(i, j)}_{min(i, j)}" for i in range(size) for j in range(size)] + [f"b{i}" for i in range(size)]
    packed = rows.groupBy("trace").agg(*sums).select("trace", F.array(*names).alias("sums"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.linalg.lstsq((v := a.values.to_numpy())[: size * size].reshape(size, size), v[size * size :], rcond=1e-12)[0] for a in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tolist() for c in x], pa.list_(pa.float64()))], names=["trace", "c"])

    fits = written(packed.mapInArrow(solve, "trace string, c array<double>"), "poly_fits")
    out = t[0] * F.col("c")[0]
    for k in range(1, size):
        out = out + t[k] * F.col("c")[k]
    return rows.join(F.broadcast(fits) if few(n) else fits, "trace").select("trace", "idx", out.alias("out"))


#: Most taps that are held as a list; a longer kernel is a table.
KERNEL = 4096


def fir_by_trace(s: DataFrame, a: str, b: str, size: int = BLOCK) -> DataFrame:
    """Trace a through the centred filter whose taps are trace b, of any length."""
    kernel = s.where(F.col("trace") == b)
    taps = [r[0] for r in kernel.orderBy("idx").select("value").limit(KERNEL + 1).collect()]
    if len(taps) <= KERNEL:
        return windows.centred_fir(s.where(F.col("trace") == a), taps, size=size).select("idx", "out")
    return convolved(s.where(F.col("trace") == a), kernel, size)


def convolved(s: DataFrame, kernel: DataFrame, size: int = BLOCK) -> DataFrame:
    """windows.centred_fir() with the samples of a trace as taps, for any number of both.

    Each block of samples meets each block of taps; what a pair adds to the samples it reaches is summed up. Before its start
    and after its end the trace keeps its first and last value, whose shares are sums over the taps beyond.
    """
    n, m = s.count(), kernel.count()
    half = m // 2
    ahead = m - 1 - half
    if n < half:
        return s.select("idx", F.lit(0.0).alias("out"))
    parts = -(-m // size)
    xs = spectral.frames(s, size, short=True).select(F.col("frame").alias("at"), F.col("samples").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("frame"))
    pairs = xs.join(spectral.frames(kernel, size, short=True).select("frame", F.col("samples").alias("h")), "frame").select("at", "frame", "x", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, frame, x, h in zip(*(batch.column(i) for i in range(4)), strict=True):
                x, h = x.values.to_numpy(zero_copy_only=False), h.values.to_numpy(zero_copy_only=False)
                width = len(x) + len(h) - 1
                y = np.fft.irfft(np.fft.rfft(x, width) * np.fft.rfft(h[::-1], width), width)
                idx = np.arange(width) + (at.as_py() - frame.as_py()) * size - (len(h) - 1) + ahead
                keep = (idx >= 0) & (idx < n)
                yield pa.RecordBatch.from_pydict({"idx": pa.array(idx[keep]), "v": pa.array(y[keep])})

    inner = pairs.mapInArrow(run, "idx long, v double")
    sums = running_sum(kernel.select("trace", "idx", "value"), F.col("value"), "upto", size)
    total = kernel.agg(F.sum("value")).first()[0]
    ends = dict(s.where(F.col("idx").isin(0, n - 1)).select("idx", "value").collect())
    # A sample i before `ahead` has taps up to ahead - i - 1 over the start; one within `half` of the end has those over the end.
    left = sums.where(F.col("idx") < ahead).select((ahead - 1 - F.col("idx")).alias("idx"), (F.lit(ends[0]) * F.col("upto")).alias("v"))
    right = sums.where(F.col("idx") >= m - 1 - half).select((n - 1 + ahead - F.col("idx")).alias("idx"), (F.lit(ends[n - 1]) * (total - F.col("upto"))).alias("v"))
    every = inner.unionByName(left.where(F.col("idx") < n)).unionByName(right.where((F.col("idx") >= 0) & (F.col("idx") < n)))
    return every.groupBy("idx").agg(F.sum("v").alias("out"))


#: Calculations of a single trace by name, with their parameters' defaults.
SINGLE: dict[str, Callable[..., DataFrame]] = {
    "Abs": lambda s: s.withColumn("out", F.abs("value")),
    "SubtractOffset": lambda s, param=1.0: s.withColumn("out", F.col("value") - param),
    "ProductSimple": lambda s, param=1.0: s.withColumn("out", F.col("value") * param),
    "Rescale": lambda s, low=0, high=1: rescaled(s, float(low), float(high)),
    "Normalised": normalised,
    "Differentiate": windows.differentiated,
    "Integrate": windows.integrated,
    "Quantize": quantised,
    "RollingRMS": lambda s, window=100: windows.rolling_rms(s, window),
    "RollingMean": lambda s, window=100: windows.rolling_mean(s, window),
    "PolyFilter": poly_filtered,
    "ProjectYTtoY": lambda s: lookup.to_uniform(s).select("trace", F.col("i").alias("idx"), F.col("value").alias("out")),
    "Resample": lambda s, count=100: lookup.resampled(s, count).select("trace", F.col("i").alias("idx"), F.col("value").alias("out")),
}
#: Of exactly two traces, and of two or more.
PAIR = {"Atan2": atan2, "Difference": difference, "Subtract": subtract, "RescaledError": rescaled_error, "NormalisedError": normalised_error, "FIR": fir_by_trace}
MANY = {"Magnitude": magnitude, "Sum": total, "Mean": mean, "Product": product}


def calculate(kind: str, s: DataFrame, traces: list[str], **parameters) -> DataFrame:
    """The calculation of that name over traces of s; the wrong number of traces raises ValueError."""
    if kind in SINGLE:
        if len(traces) != 1:
            raise ValueError(f"{kind} takes one trace")
        return SINGLE[kind](s.where(F.col("trace") == traces[0]), **parameters)
    if kind in PAIR:
        if len(traces) != 2:
            raise ValueError(f"{kind} takes two traces")
        return PAIR[kind](s, *traces, **parameters)
    return MANY[kind](s, traces, **parameters)
