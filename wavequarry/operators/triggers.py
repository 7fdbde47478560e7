"""Level crossings: the triggered start, and slices between triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCK, blocks
from .sequential import sequential
from .windows import lagged


def crossings(s: DataFrame, level: float, rising: bool = True, size: int = BLOCK) -> DataFrame:
    """Samples at or beyond the level whose predecessor is strictly before it."""
    rows = lagged(s, 1, size)
    hit = (F.col("lagged") < level) & (F.col("value") >= level) if rising else (F.col("lagged") > level) & (F.col("value") <= level)
    return rows.where(hit).drop("lagged")


def trigger_start(s: DataFrame, level: float, rising: bool = True, back: int = 0, auto: bool = False) -> DataFrame:
    """trace and start: the first crossing less `back` samples, 0 at least. Without a crossing: 0 if auto, else no row."""
    first = crossings(s, level, rising).groupBy("trace").agg(F.min("idx").alias("at"))
    start = F.greatest(F.col("at") - back, F.lit(0))
    if auto:
        return s.select("trace").distinct().join(first, "trace", "left").select("trace", F.coalesce(start, F.lit(0)).alias("start"))
    return first.select("trace", start.alias("start"))


class Spaced:
    """Which crossings start a slice: the first, and each at least `gap` after the start before."""

    def __init__(self, gap: int):
        self.gap, self.last = gap, None

    def __call__(self, idx):
        out = []
        for i in idx.tolist():
            starts = self.last is None or i - self.last >= self.gap
            self.last = i if starts else self.last
            out.append(float(starts))
        return out


def triggered_slices(s: DataFrame, level: float, rising: bool = True, back: int = 0, gap: int = 1, size: int = BLOCK) -> DataFrame:
    """trace, slice, place, value: slices from one trigger to the next (the last to the end), each with `back` samples before it, 0 ahead of the trace.

    Only crossings go through the sequential rule; samples join their slice by its range within their block of idx.
    """
    starts = sequential(crossings(s, level, rising, size).select("trace", "idx"), ["idx"], lambda: Spaced(gap)).where("out = 1").select("trace", "idx")
    w = Window.partitionBy("trace").orderBy("idx")
    n = s.groupBy("trace").agg(F.count("*").alias("n"))
    cuts = starts.join(n, "trace").select("trace", F.row_number().over(w).alias("slice"), F.col("idx").alias("start"), F.coalesce(F.lead("idx").over(w), "n").alias("end"))
    places = cuts.withColumn("at", F.explode(F.sequence(F.col("start") - back, F.col("end") - 1))).select("trace", "slice", (F.col("at") - F.col("start") + back).cast("long").alias("place"), F.col("at").alias("idx"))
    return places.join(s.select("trace", "idx", "value"), ["trace", "idx"], "left").select("trace", "slice", "place", F.coalesce("value", F.lit(0.0)).alias("value"))


def changed_points(s: DataFrame, size: int = BLOCK) -> DataFrame:
    """Samples whose value differs from the one before; the first sample goes."""
    return lagged(s, 1, size).where(F.col("lagged").isNotNull() & (F.col("lagged") != F.col("value"))).drop("lagged")


def since_change(s: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds out: the time of each sample since the state (its value) last changed, or since the start."""
    changed = lagged(s, 1, size).withColumn("at", F.when(F.col("lagged").isNull() | (F.col("lagged") != F.col("value")), F.col("t"))).drop("lagged")
    rows = blocks(changed, size=size)
    ends = rows.groupBy("trace", "block").agg(F.max("at").alias("m"))
    carried = F.max("m").over(Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max("at").over(Window.partitionBy("trace", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("inside", inside).join(ends.select("trace", "block", carried.alias("carried")), ["trace", "block"])
    return joined.withColumn("out", F.col("t") - F.coalesce("inside", "carried")).drop("at", "inside", "carried", "block", "own")
