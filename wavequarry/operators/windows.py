"""Filters and transforms with a finite or a summable history, as Spark windows over blocks of a trace.

Each function takes samples (trace, idx, value, ...) and returns them with a column `out`. Trailing filters are primed: a trace
counts as if its first sample had come for ever before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..model import BLOCK, blocks, framed, running_sum


def rolling_mean(s: DataFrame, count: int, size: int = BLOCK) -> DataFrame:
    """Mean over count // 2 samples on either side; the window shrinks at the ends."""
    return framed(s, count // 2, count // 2, {"out": lambda w: F.avg("value").over(w)}, size)


def rolling_rms(s: DataFrame, count: int, size: int = BLOCK) -> DataFrame:
    return framed(s, count // 2, count // 2, {"out": lambda w: F.sqrt(F.avg(F.col("value") * F.col("value")).over(w))}, size)


def rolling_max(s: DataFrame, count: int, size: int = BLOCK) -> DataFrame:
    """NaN is left out; only NaN in the window gives minus infinity."""
    return framed(s, count // 2, count // 2, {"out": lambda w: F.coalesce(F.max(F.when(~F.isnan("value"), F.col("value"))).over(w), F.lit(float("-inf")))}, size)


def differentiated(s: DataFrame, size: int = BLOCK) -> DataFrame:
    """value less the one before; 0 at the start."""
    return lagged(s, 1, size).withColumn("out", F.coalesce(F.col("value") - F.col("lagged"), F.lit(0.0))).drop("lagged")


def integrated(s: DataFrame, size: int = BLOCK) -> DataFrame:
    return running_sum(s, F.col("value"), "out", size)


def lagged(s: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    """Adds lagged: the value n samples before, null before the start."""
    rows = blocks(s, before=n, size=size)
    at = F.lag("value", n).over(Window.partitionBy("trace", "block").orderBy("idx"))
    return rows.withColumn("lagged", at).where("own").drop("block", "own")


def delay(s: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    """The value n samples before; 0 before the start."""
    return lagged(s, n, size).withColumn("out", F.coalesce("lagged", F.lit(0.0))).drop("lagged")


def unwrapped(s: DataFrame, step: float, tolerance: float, size: int = BLOCK) -> DataFrame:
    """Adds or takes away step at each jump of more than tolerance, from there on."""
    jump = F.col("lagged") - F.col("value")
    turn = F.when(jump > tolerance, step).when(jump < -tolerance, -step).otherwise(0.0)
    turned = running_sum(lagged(s, 1, size), F.coalesce(turn, F.lit(0.0)), "turns", size)
    return turned.withColumn("out", F.col("value") + F.col("turns")).drop("turns", "lagged")


def _primed(s: DataFrame, n: int, columns: dict[str, Column], size: int) -> DataFrame:
    """For each column the mean over the trailing n values, those before the start being the trace's first."""

    def mean(c: Column):
        return lambda w: (F.sum(c).over(w) + F.first(c).over(w) * (n - F.count(c).over(w))) / n

    return framed(s, n - 1, 0, {k: mean(c) for k, c in columns.items()}, size)


def moving_average(s: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    return _primed(s, n, {"out": F.col("value")}, size)


def moving_rms(s: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    return _primed(s, n, {"out": F.col("value") * F.col("value")}, size).withColumn("out", F.sqrt("out"))


def dc_block(s: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    return _primed(s, n, {"out": F.col("value")}, size).withColumn("out", F.col("value") - F.col("out"))


def history_stats(s: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    """Of the primed trailing n values: out (the oldest), sum, sum_square, mean, rms, std (0 where the variance is no more than rounding)."""
    rows = framed(s, n - 1, 0, {"mean": _mean(F.col("value"), n), "mean_square": _mean(F.col("value") * F.col("value"), n), "out": lambda w: F.first("value").over(w)}, size)
    variance = F.col("mean_square") - F.col("mean") * F.col("mean")
    return (
        rows.withColumn("sum", F.col("mean") * n).withColumn("sum_square", F.col("mean_square") * n).withColumn("rms", F.sqrt("mean_square"))
        .withColumn("std", F.when(variance > 1e-12 * F.col("mean_square"), F.sqrt(variance)).otherwise(0.0)).drop("mean_square")
    )


def _mean(c: Column, n: int):
    return lambda w: (F.sum(c).over(w) + F.first(c).over(w) * (n - F.count(c).over(w))) / n


def fixed_point_stats(s: DataFrame, n: int, q: int = 16, size: int = BLOCK) -> DataFrame:
    """history_stats over values cut to whole steps of 2 ** -q, summed as whole numbers (64 bits, so the sums don't overflow)."""
    scale = float(1 << q)
    v = F.col("fixed")
    total = lambda c: lambda w: F.sum(c).over(w) + F.first(c).over(w) * (n - F.count(c).over(w))
    rows = framed(s.withColumn("fixed", (F.col("value") * scale).cast("long")), n - 1, 0, {"sum_q": total(v), "sum_qq": total(v * v), "oldest": lambda w: F.first("fixed").over(w)}, size)
    mean, square = F.col("sum_q") / scale / n, F.col("sum_qq") / scale / scale / n
    variance = square - mean * mean
    return (
        rows.withColumn("out", F.col("oldest") / scale).withColumn("sum", F.col("sum_q") / scale).withColumn("sum_square", F.col("sum_qq") / scale / scale).withColumn("mean", mean)
        .withColumn("rms", F.sqrt(square)).withColumn("std", F.when(variance > 0, F.sqrt(variance)).otherwise(0.0)).drop("fixed", "sum_q", "sum_qq", "oldest")
    )


def steady_state(s: DataFrame, n: int, limit: float, size: int = BLOCK) -> DataFrame:
    """The last value at which n samples had come and their deviation was under limit; 0 before the first."""
    rows = blocks(history_stats(s, n, size).withColumn("steady", F.when((F.col("idx") >= n - 1) & (F.col("std") < limit), F.col("value"))), size=size)
    last = rows.groupBy("trace", "block").agg(F.max_by("steady", F.when(F.col("steady").isNotNull(), F.col("idx"))).alias("l"))
    carried = F.last("l", ignorenulls=True).over(Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carry = last.select("trace", "block", carried.alias("carried"))
    inside = F.last("steady", ignorenulls=True).over(Window.partitionBy("trace", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(carry, ["trace", "block"]).withColumn("out", F.coalesce("inside", "carried", F.lit(0.0))).drop("inside", "carried", "steady", "block", "own", "std", "rms", "mean", "sum", "sum_square")


#: Longer filters run as a NumPy kernel on blocks, shorter ones as sums of lags.
SHORT = 12


def _long_fir(s: DataFrame, taps: list[float], gain: float, after: int, size: int) -> DataFrame:
    """Taps times the samples from len(taps) - 1 - after ahead to `after` behind, the first and last standing for those beyond the ends: per block with its margins."""
    before, weights = len(taps) - 1 - after, np.asarray(taps) * gain

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        x, idx = t["value"].to_numpy(), t["idx"].to_numpy()
        own = np.flatnonzero(t["own"].to_numpy(zero_copy_only=False))
        if not len(own):
            return t.select(names).append_column("out", pa.array(np.zeros(len(t)))).slice(0, 0)
        lo, hi = int(own[0]), int(own[-1]) + 1
        front, back = max(0, before - lo), max(0, after - (len(x) - hi))
        y = np.correlate(np.concatenate([np.full(front, x[0]), x, np.full(back, x[-1])]), weights, "valid")
        start = lo + front - before
        return t.select(names).slice(lo, hi - lo).append_column("out", pa.array(y[start : start + hi - lo]))

    names = s.columns
    schema = StructType([*s.schema.fields, StructField("out", DoubleType())])
    return blocks(s, before, after, size).groupBy("trace", "block").applyInArrow(run, schema)


def fir(s: DataFrame, taps: list[float], gain: float = 1.0, size: int = BLOCK) -> DataFrame:
    """Sum of taps times the primed history, oldest first (a correlation)."""
    n = len(taps)
    if n > SHORT:
        return _long_fir(s, taps, gain, 0, size)
    w = Window.partitionBy("trace", "block").orderBy("idx")
    first = F.first("value").over(w.rowsBetween(-(n - 1), 0))
    terms = [F.coalesce(F.lag("value", n - 1 - k).over(w) if k < n - 1 else F.col("value"), first) * float(taps[k]) for k in range(n)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return blocks(s, before=n - 1, size=size).withColumn("out", out * gain).where("own").drop("block", "own")


def centred_fir(s: DataFrame, taps: list[float], gain: float = 1.0, size: int = BLOCK) -> DataFrame:
    """fir() shifted by half its length, the last sample standing for those after the end; 0 in traces shorter than half the taps."""
    n, half = len(taps), len(taps) // 2
    length = s.groupBy("trace").agg(F.count("*").alias("__n"))
    if n > SHORT:
        rows = _long_fir(s, taps, gain, half, size)
        return rows.join(length, "trace").withColumn("out", F.when(F.col("__n") >= half, F.col("out")).otherwise(0.0)).drop("__n")
    w = Window.partitionBy("trace", "block").orderBy("idx")
    wide = w.rowsBetween(-(n - 1 - half), half)
    terms = []
    for k in range(n):
        ahead = k - (n - 1 - half)
        x = F.lead("value", ahead).over(w) if ahead > 0 else F.lag("value", -ahead).over(w) if ahead < 0 else F.col("value")
        terms.append(F.coalesce(x, (F.last("value") if ahead > 0 else F.first("value")).over(wide)) * float(taps[k]))
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    rows = blocks(s, before=n - 1 - half, after=half, size=size).withColumn("out", out * gain).where("own").drop("block", "own")
    return rows.join(length, "trace").withColumn("out", F.when(F.col("__n") >= half, F.col("out")).otherwise(0.0)).drop("__n")


def savgol_kernel(n: int, order: int) -> list[float]:
    """Weights whose sum over n samples is the value at their middle of the polynomial that fits them best."""
    x = np.arange(n) - (n - 1) / 2
    return np.linalg.pinv(np.vander(x, order + 1))[-1].tolist()


def savitzky_golay(s: DataFrame, n: int, order: int, size: int = BLOCK) -> DataFrame:
    return fir(s, savgol_kernel(n, order), size=size)


def gain(s: DataFrame, factor: float) -> DataFrame:
    return s.withColumn("out", F.col("value") * factor)


def limiter(s: DataFrame, low: float, high: float) -> DataFrame:
    return s.withColumn("out", F.greatest(F.least(F.col("value"), F.lit(high)), F.lit(low)))


def progressive_limiter(s: DataFrame, knee: float = 0.5, limit: float = 1.0, reduced: float = 0.8) -> DataFrame:
    """Below the knee the magnitude, above the limit the reduced limit, in between a curve that keeps the sign."""
    a = F.abs("value")
    d = 1.0 - (a - knee) / (limit - knee)
    curve = knee + (1.0 - d * d) * (reduced - knee)
    return s.withColumn("out", F.when(a > limit, reduced).when(a < knee, a).otherwise(F.when(F.col("value") < 0, -curve).otherwise(curve)))


def noise_added(s: DataFrame, share: float, seed: int) -> DataFrame:
    """value * (1 - share) + uniform noise in [-1, 1) * share, the noise fixed by seed, trace and idx."""
    u = F.pmod(F.xxhash64(F.lit(seed), "trace", "idx"), F.lit(1 << 53)) / float(1 << 53)
    return s.withColumn("out", F.col("value") * (1 - share) + (2 * u - 1) * share)
