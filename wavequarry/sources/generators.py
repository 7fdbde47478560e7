"""Signals by formula, made where they are needed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tone(spark: SparkSession, count: int, hz: float, sps: float, amplitude: float = 1.0, phase: float = 0.0, trace: str = "tone") -> DataFrame:
    """Sine of fixed frequency in closed form."""
    i = F.col("idx")
    return spark.range(count).select(F.lit(trace).alias("trace"), F.col("id").alias("idx")).withColumn("value", amplitude * F.sin(2 * math.pi * hz / sps * i + phase))


def sweep(spark: SparkSession, count: int, start: float, stop: float, per_second: float, sps: float, amplitude: float = 1.0, trace: str = "sweep") -> DataFrame:
    """Sine whose frequency rises linearly from start to stop, per_second times a second, and begins anew: phase in closed form, so any part can be made alone."""
    if per_second == 0:
        return tone(spark, count, start, sps, amplitude, trace=trace)
    period = sps / per_second
    turn = F.floor(F.col("id") / period)
    u = F.col("id") - turn * period
    cycles = lambda x: (start * x + (stop - start) * x * x / (2 * period)) / sps
    whole = turn * cycles(F.lit(period))
    return spark.range(count).select(F.lit(trace).alias("trace"), F.col("id").alias("idx"), (amplitude * F.sin(2 * math.pi * F.pmod(whole + cycles(u), F.lit(1.0)))).alias("value"))


def noise(spark: SparkSession, count: int, amplitude: float, seed: int, trace: str = "noise") -> DataFrame:
    """Uniform in [-amplitude, amplitude), by seed and place alone."""
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) / float(1 << 53)
    return spark.range(count).select(F.lit(trace).alias("trace"), F.col("id").alias("idx"), (amplitude * (2 * u - 1)).alias("value"))


def harmonics(spark: SparkSession, count: int, parts: list[tuple[int, float]], trace: str) -> DataFrame:
    """One period of a sum of sines: (order, amplitude)."""
    x = F.col("id") * (2 * math.pi / count)
    value = sum((F.sin(x * k) * a for k, a in parts), F.lit(0.0))
    return spark.range(count).select(F.lit(trace).alias("trace"), F.col("id").alias("idx"), value.alias("value"))


def wave(spark: SparkSession, kind: str, count: int = 65536) -> DataFrame:
    """A period of Sine, Square, Triangle, RisingSawtooth, FallingSawtooth (exact shapes) or SquareF1to9 (its first odd harmonics)."""
    x = F.col("id") / count
    if kind == "SquareF1to9":
        return harmonics(spark, count, [(k, 4 / (math.pi * k)) for k in range(1, 10, 2)], kind)
    value = {
        "Sine": F.sin(x * 2 * math.pi),
        "Square": F.when(x < 0.5, 1.0).otherwise(-1.0),
        "Triangle": 1 - 4 * F.abs(F.pmod(x + 0.25, F.lit(1.0)) - 0.5),
        "RisingSawtooth": 2 * x - 1,
        "FallingSawtooth": 1 - 2 * x,
    }[kind]
    return spark.range(count).select(F.lit(kind).alias("trace"), F.col("id").alias("idx"), value.alias("value"))


def sinc(spark: SparkSession, count: int, amplitude: float, left: float, right: float, trace: str = "sinc") -> DataFrame:
    """amplitude * sin(x) / x at count even steps from left to right."""
    x = left + (right - left) * F.col("id") / max(1, count - 1)
    return spark.range(count).select(F.lit(trace).alias("trace"), F.col("id").alias("idx"), F.when(x == 0, amplitude).otherwise(amplitude * F.sin(x) / F.when(x != 0, x)).alias("value"))


def ramp(spark: SparkSession, start: float, count: int, step: float, trace: str = "range") -> DataFrame:
    return spark.range(count).select(F.lit(trace).alias("trace"), F.col("id").alias("idx"), (start + F.col("id") * step).alias("value"))
