"""A view of traces: offset and length, filter, spectral filter, trigger, zoom and decimation as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats, triggers, windows


def offset_and_length(s: DataFrame, offset: int, length: int, fill: str = "zero") -> DataFrame:
    """length samples from offset on, numbered anew; places outside the trace get zero, or the first or last value."""
    n = s.groupBy("trace").agg(F.max("idx").alias("top"), F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"))
    places = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")))).withColumn("idx", F.col("i") + offset)
    other = {"zero": F.lit(0.0), "first": F.col("first"), "last": F.col("last")}[fill]
    return places.join(s.select("trace", "idx", "value"), ["trace", "idx"], "left").select("trace", F.col("i").alias("idx"), F.coalesce("value", other).alias("value"))


def set_range(s: DataFrame, left: int, right: int, to: float) -> DataFrame:
    """Samples from left up to right (exclusive) overwritten."""
    return s.withColumn("value", F.when(F.col("idx").between(left, right - 1), to).otherwise(F.col("value")))


@dataclass(frozen=True)
class View:
    """What is done to samples, in this order; steps that aren't set are left out."""

    offset: int | None = None
    length: int | None = None
    differentiate: bool = False
    filter: Callable[[DataFrame], DataFrame] | None = None
    integrate: bool = False
    trigger: float | None = None
    rising: bool = True
    back: int = 0
    zoom: tuple[int, int] | None = None
    width: int | None = None

    def __call__(self, s: DataFrame) -> DataFrame:
        taken = lambda d: d.select("trace", "idx", F.col("out").alias("value"))
        if self.length is not None:
            s = offset_and_length(s, self.offset or 0, self.length)
        if self.differentiate:
            s = taken(windows.differentiated(s))
        if self.filter:
            s = taken(self.filter(s))
        if self.integrate:
            s = taken(windows.integrated(s))
        if self.trigger is not None:
            start = triggers.trigger_start(s, self.trigger, self.rising, self.back)
            s = s.join(start, "trace").where(F.col("idx") >= F.col("start")).select("trace", (F.col("idx") - F.col("start")).alias("idx"), "value")
        if self.zoom is not None:
            left, right = self.zoom
            s = s.where(F.col("idx").between(left, right - 1)).select("trace", (F.col("idx") - left).alias("idx"), "value")
        return stats.pixels(s, self.width) if self.width else s
