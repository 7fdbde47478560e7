"""Aggregates over traces. All are combinable or two passes; none gathers a trace in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCK
from ..session import few, written


def trace_stats(s: DataFrame) -> DataFrame:
    """count (all samples); of the finite values min, max, range, sum, sum_square, mean, rms, variance (0 where flat), std, and last by idx."""
    v = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    flat = F.min(v) == F.max(v)
    return s.groupBy("trace").agg(
        F.count("*").alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_square"),
        F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.when(flat, 0.0).otherwise(F.var_pop(v)).alias("variance"), F.when(flat, 0.0).otherwise(F.stddev_pop(v)).alias("std"), F.max_by(v, "idx").alias("last"),
    )


def time_stats(s: DataFrame) -> DataFrame:
    """Deviation of the gaps between times, and the rate by the smallest gap above 0."""
    from ..model import lagged_time

    gap = F.col("t") - F.col("before")
    return lagged_time(s).groupBy("trace").agg(F.stddev_pop(gap).alias("gap_std"), (1 / F.min(F.when(gap > 0, gap))).alias("samples_per_second"))


def linear_regression(s: DataFrame) -> DataFrame:
    """Slope, intercept and r squared of value against idx."""
    return s.groupBy("trace").agg(F.regr_slope("value", "idx").alias("slope"), F.regr_intercept("value", "idx").alias("intercept"), F.regr_r2("value", "idx").alias("r_squared"))


def within(x: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows v (trace, x) that lie in the ranges m (trace, lo, hi) of their trace."""
    side = F.broadcast(ranges.alias("m")) if few(ranges) else ranges.alias("m")
    return x.alias("v").join(side, F.col("v.trace") == F.col("m.trace")).where((F.col("v.x") >= F.col("m.lo")) & (F.col("v.x") <= F.col("m.hi")))


def middles(s: DataFrame, value: str, bins: int = 4096, small: int = BLOCK) -> DataFrame:
    """trace and median: the exact median of a column, NaN and null left out.

    Values are counted by bins of even width between the trace's least and greatest, a bin is searched for the middle, and what
    lies in it is cut into bins again, until it has at most `small` rows, which are ranked, or one value only; so no task gets
    more than that and counts are combined before they are shuffled. s is read in each round. The number of values of a trace may be odd or even: both middle ranks are followed.
    """
    x = s.where(F.col(value).isNotNull() & ~F.isnan(value)).select("trace", F.col(value).alias("x"))
    ends = x.groupBy("trace").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    ranks = F.array_distinct(F.array(F.expr("(n - 1) DIV 2"), F.expr("n DIV 2")))
    left = written(ends.select("trace", "lo", "hi", "n", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("passed")), "medians")
    done = []
    while True:
        # Flat ranges are found, short ones ranked; others go on.
        done.append(left.where("lo = hi").select("trace", F.col("lo").alias("x")))
        at = F.col("passed") + F.row_number().over(Window.partitionBy("m.trace", "m.rank").orderBy("v.x")) - 1
        done.append(within(x, left.where(f"lo < hi AND n <= {small}")).select("m.trace", "m.rank", "v.x", at.alias("at")).where("at = rank").select("trace", "x"))
        more = left.where(f"lo < hi AND n > {small}")
        if more.isEmpty():
            break
        inside = within(x, more)
        # The place in the range, by halves so that no difference leaves the range of doubles.
        place = (F.col("v.x") / 2 - F.col("m.lo") / 2) / (F.col("m.hi") / 2 - F.col("m.lo") / 2)
        at = F.least(F.floor(place * bins), F.lit(bins - 1))
        counts = inside.groupBy("m.trace", "m.rank", at.alias("bin")).agg(F.count("*").alias("k"), F.min("v.x").alias("lo"), F.max("v.x").alias("hi"), F.first("m.passed").alias("passed"))
        upto = F.col("passed") + F.sum("k").over(Window.partitionBy("trace", "rank").orderBy("bin"))
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("k") <= F.col("rank")))
        left = written(found.select("trace", "lo", "hi", F.col("k").alias("n"), "rank", (F.col("upto") - F.col("k")).alias("passed")), "medians")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.groupBy("trace").agg(F.avg("x").alias("median"))


def medians(s: DataFrame) -> DataFrame:
    """Exact median, and mean and median of the absolute deviations from mean and median."""
    side = lambda df: F.broadcast(df) if few(df) else df
    s = written(s.select("trace", "value"), "medians_of")
    m = written(s.groupBy("trace").agg(F.avg("value").alias("mean")).join(middles(s, "value"), "trace", "left"), "medians")
    d = s.join(side(m), "trace").select("trace", "mean", F.abs(F.col("value") - F.col("mean")).alias("from_mean"), F.abs(F.col("value") - F.col("median")).alias("from_median"))
    return m.join(d.groupBy("trace").agg(F.avg("from_mean").alias("mad_mean")), "trace").join(middles(d, "from_median").withColumnRenamed("median", "mad_median"), "trace", "left").drop("mean")


def products(s: DataFrame) -> DataFrame:
    """Product, L2 norm and sum of squares."""
    return s.groupBy("trace").agg(F.coalesce(F.product("value"), F.lit(0.0)).alias("product"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("magnitude"), F.sum(F.col("value") * F.col("value")).alias("sum_square"))


def log_products(s: DataFrame) -> DataFrame:
    """Product as its sign and log10 of its magnitude (null where it is 0), for traces whose product leaves the range of doubles, and L2 norm."""
    v = F.col("value")
    sign = F.when(F.max(F.when(v == 0, 1).otherwise(0)) == 1, 0).when(F.sum(F.when(v < 0, 1).otherwise(0)) % 2 == 1, -1).otherwise(1)
    log = F.when(F.max(F.when(v == 0, 1).otherwise(0)) == 0, F.sum(F.when(v != 0, F.log10(F.abs(v)))))
    return s.groupBy("trace").agg(sign.alias("sign"), log.alias("log10"), F.sqrt(F.sum(v * v)).alias("magnitude"))


def histogram(s: DataFrame, bins: int) -> DataFrame:
    """centre, count and fraction of every bin; only the maximum itself falls into the last bin. No rows for traces of one value or a flat one."""
    edges = s.groupBy("trace").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).where("n > 1 AND hi > lo")
    at = F.floor((bins - 1) * (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("int")
    counts = s.join(edges, "trace").groupBy("trace", at.alias("bin")).agg(F.count("*").alias("count"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, ["trace", "bin"], "left").select("trace", "bin", (F.col("lo") + width * (F.col("bin") + 0.5)).alias("centre"), F.coalesce("count", F.lit(0)).alias("count"), (F.coalesce("count", F.lit(0)) / F.col("n")).alias("fraction"))


def peak_hold(frames: DataFrame) -> DataFrame:
    """Least and greatest value at each idx over all frames of a trace."""
    return frames.groupBy("trace", "idx").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def slice_mean(slices: DataFrame) -> DataFrame:
    """Mean by place over slices (trace, slice, place, value); shorter slices count as 0 beyond their end."""
    n = slices.groupBy("trace").agg(F.countDistinct("slice").alias("n"))
    return slices.groupBy("trace", "place").agg(F.sum("value").alias("total")).join(n, "trace").select("trace", "place", (F.col("total") / F.col("n")).alias("value"))


def pixels(s: DataFrame, width: int) -> DataFrame:
    """Least, greatest and mean value of each of width pixels: p covers samples from floor(p n / width) to floor((p + 1) n / width), and at least one."""
    n = s.groupBy("trace").agg(F.count("*").alias("n"))
    rows = s.join(n, "trace")
    # The pixels whose range holds a sample: a run of them where there are fewer samples than pixels.
    first = F.expr(f"(idx * {width}) DIV n")
    last = F.greatest(F.expr(f"((idx + 1) * {width} + n - 1) DIV n") - 1, first)
    p = F.explode(F.sequence(first, last))
    covered = rows.withColumn("pixel", p).where(F.col("pixel") < width)
    lo = F.expr(f"(pixel * n) DIV {width}")
    hi = F.greatest(F.expr(f"((pixel + 1) * n) DIV {width}"), lo + 1)
    return covered.where((F.col("idx") >= lo) & (F.col("idx") < hi)).groupBy("trace", "pixel").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def flat_traces(s: DataFrame) -> DataFrame:
    """Traces of one value only, those with fewer than two samples included."""
    return s.groupBy("trace").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n < 2 OR lo <=> hi").select("trace")


def auto_range(s: DataFrame, digits: int = 2) -> DataFrame:
    """Least and greatest value widened by a tenth of the range and rounded outwards to so many significant digits."""

    def outward(x, up: bool):
        step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
        return F.when(x == 0, 0.0).otherwise((F.ceil(x / step) if up else F.floor(x / step)) * step)

    r = s.groupBy("trace").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    margin = (F.col("hi") - F.col("lo")) * 0.1
    return r.select("trace", outward(F.col("lo") - margin, False).alias("low"), outward(F.col("hi") + margin, True).alias("high"))


def between_times(s: DataFrame, left: float, right: float) -> DataFrame:
    """Statistics of the samples whose time is in [left, right)."""
    return trace_stats(s.where((F.col("t") >= left) & (F.col("t") < right)))


def drop_empty(traces: DataFrame, s: DataFrame) -> DataFrame:
    """The rows of a table of traces that have samples and, if it has a column visible, are visible."""
    shown = traces.where("visible") if "visible" in traces.columns else traces
    return shown.join(s.select("trace").distinct(), "trace", "left_semi")


def smoothed_pixels(p: DataFrame, half: int) -> DataFrame:
    """Low and high of each pixel as means over half a width on either side; the window shrinks at the ends. Traces have few pixels."""
    w = Window.partitionBy("trace").orderBy("pixel").rowsBetween(-half, half)
    return p.withColumn("low", F.avg("low").over(w)).withColumn("high", F.avg("high").over(w))
