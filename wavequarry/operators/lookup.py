"""What combines traces by time or value: as-of lookups, range slices, interpolation and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCK, blocks, lagged_time
from ..session import few, written


def as_of(s: DataFrame, queries: DataFrame, width: float, strict: bool = True) -> DataFrame:
    """For each query (trace, t, ...) the last sample of its trace before t (strict) or at most at t, else the trace's first: its value, idx and time.

    Samples and queries are dealt by trace and by spans of `width` seconds. Within a span a window carries the last sample on;
    what a span begins with comes from a running window over one row a span. No trace is in one task.
    """
    sample = F.struct("idx", "value", F.col("t").alias("time"))
    rows = s.select("trace", "t", sample.alias("s"), F.lit(None).cast(queries.schema).alias("q"), F.lit(1 if strict else 0).alias("o"))
    # Among equal times queries come first if strict, else samples do.
    asked = queries.select("trace", "t", F.lit(None).cast(rows.schema["s"].dataType).alias("s"), F.struct(*queries.columns).alias("q"), F.lit(0 if strict else 1).alias("o"))
    every = rows.unionByName(asked).withColumn("span", F.floor(F.col("t") / width))
    inside = F.last("s", ignorenulls=True).over(Window.partitionBy("trace", "span").orderBy("t", "o", "s.idx").rowsBetween(Window.unboundedPreceding, 0))
    ends = s.groupBy("trace", F.floor(F.col("t") / width).alias("span")).agg(F.max_by(F.struct("idx", "value", F.col("t").alias("time")), "idx").alias("end"))
    spans = ends.select("trace", "span", "end").unionByName(queries.select("trace", F.floor(F.col("t") / width).alias("span"), F.lit(None).cast(ends.schema["end"].dataType).alias("end")).distinct())
    spans = spans.groupBy("trace", "span").agg(F.max("end").alias("end"))
    carried = F.last("end", ignorenulls=True).over(Window.partitionBy("trace").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    carry = spans.select("trace", "span", carried.alias("carried"))
    first = s.where("idx = 0").select("trace", F.struct("idx", "value", F.col("t").alias("time")).alias("first"))
    found = every.withColumn("inside", inside).where("q IS NOT NULL").join(carry, ["trace", "span"]).join(first, "trace")
    hit = F.coalesce("inside", "carried", "first")
    return found.select("q.*", hit["idx"].alias("idx"), hit["value"].alias("value"), hit["time"].alias("time"))


def at_uniform(s: DataFrame, queries: DataFrame, sps: float, leftmost: float) -> DataFrame:
    """For each query the sample nearest to its time in a uniform trace, clamped to the trace."""
    n = s.groupBy("trace").agg(F.max("idx").alias("top"))
    at = F.least(F.greatest(F.round((F.col("t") - leftmost) * sps).cast("long"), F.lit(0)), F.col("top"))
    return queries.join(n, "trace").withColumn("idx", at).join(s.select("trace", "idx", "value"), ["trace", "idx"]).drop("top")


def time_slice(s: DataFrame, left: float, right: float) -> DataFrame:
    """Samples with left <= t <= right, and one more on either side: the ends come from one combinable aggregate."""
    ends = s.groupBy("trace").agg(F.max(F.when(F.col("t") < left, F.col("idx"))).alias("lo"), F.min(F.when(F.col("t") > right, F.col("idx"))).alias("hi"))
    ends = written(ends, "slice_ends")
    ends = F.broadcast(ends) if few(ends) else ends
    return s.join(ends, "trace").where((F.col("lo").isNull() | (F.col("idx") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("idx") <= F.col("hi")))).drop("lo", "hi")


def running_max(s: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds top_before: the greatest value before each sample; null at the start."""
    rows = blocks(s, size=size)
    tops = rows.groupBy("trace", "block").agg(F.max("value").alias("m"))
    carried = F.max("m").over(Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carry = tops.select("trace", "block", carried.alias("carried"))
    inside = F.max("value").over(Window.partitionBy("trace", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", inside).join(carry, ["trace", "block"]).withColumn("top_before", F.greatest("inside", "carried")).drop("inside", "carried", "block", "own")


def first_at_least(s: DataFrame, events: DataFrame, at: str) -> DataFrame:
    """For each event (trace, at, ...) the idx of the first sample whose value is at least `at`, else -1.

    Only samples above all before them can be first; an event falls between the record before and the record itself, so it
    meets one row. The records of a trace grow with the logarithm of its length in most data.
    """
    records = running_max(s).where(F.col("top_before").isNull() | (F.col("value") > F.col("top_before"))).select(F.col("trace").alias("__trace"), F.col("value").alias("__v"), F.col("top_before").alias("__b"), "idx")
    on = (events["trace"] == F.col("__trace")) & (F.col("__v") >= events[at]) & (F.col("__b").isNull() | (F.col("__b") < events[at]))
    return events.join(records, on, "left").select(*[events[c] for c in events.columns], F.coalesce("idx", F.lit(-1)).alias("idx"))


def segments(s: DataFrame, x: str, size: int = BLOCK) -> DataFrame:
    """Each sample with the next one: trace, idx, x0, y0, x1, y1 (null after the last)."""
    w = Window.partitionBy("trace", "block").orderBy("idx")
    rows = blocks(s, after=1, size=size).select("trace", "idx", "own", F.col(x).alias("x0"), F.col("value").alias("y0"), F.lead(x).over(w).alias("x1"), F.lead("value").over(w).alias("y1"))
    return rows.where("own").drop("own")


def linear_onto_grid(s: DataFrame, x: str, count: int, offset: float, step: float) -> DataFrame:
    """Values at offset + step * i for i under count, by lines between samples; NaN outside the trace's range.

    Each segment makes the grid points that lie in it, so there is no join between samples and grid.
    """
    seg = segments(s, x)
    first = F.ceil((F.col("x0") - offset) / step)
    last = F.when(F.col("x1").isNull(), F.floor((F.col("x0") - offset) / step)).otherwise(F.ceil((F.col("x1") - offset) / step) - 1)
    lo, hi = F.greatest(first, F.lit(0)).cast("long"), F.least(last, F.lit(count - 1)).cast("long")
    points = seg.where(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
    g = offset + step * F.col("i")
    value = F.when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (g - F.col("x0")) / (F.col("x1") - F.col("x0")))
    points = points.select("trace", "i", value.alias("value"))
    every = s.select("trace").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return every.join(points, ["trace", "i"], "left").select("trace", "i", F.coalesce("value", F.lit(float("nan"))).alias("value"))


def rate(s: DataFrame) -> DataFrame:
    """Samples a second by the smallest gap above 0; one second where there is none."""
    gap = F.col("t") - F.col("before")
    return lagged_time(s).groupBy("trace").agg((1.0 / F.coalesce(F.min(F.when(gap > 0, gap)), F.lit(1.0))).alias("sps"))


def to_uniform(s: DataFrame, size: int = BLOCK) -> DataFrame:
    """A trace with times of its own on a uniform grid at its smallest gap's rate: trace, i, value.

    Between samples by lines; the first grid point later than a quarter step before a sample takes that sample's value.
    """
    ends = s.groupBy("trace").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("idx").alias("top"))
    info = rate(s).join(ends, "trace").withColumn("n", F.floor((F.col("t1") - F.col("t0")) * F.col("sps") + 1.0).cast("long"))
    seg = segments(s, "t", size).join(info, "trace").where("x1 IS NOT NULL")
    after = lambda x: F.floor((F.col(x) - 0.25 / F.col("sps") - F.col("t0")) * F.col("sps")) + 1
    lo = F.when(F.col("idx") == 0, 0).otherwise(after("x0")).cast("long")
    hi = F.when(F.col("idx") == F.col("top") - 1, F.col("n") - 1).otherwise(F.least(after("x1") - 1, F.col("n") - 1)).cast("long")
    points = seg.where(lo <= hi).withColumn("lo", lo).withColumn("i", F.explode(F.sequence(lo, hi)))
    at = F.col("t0") + F.col("i") / F.col("sps")
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return points.select("trace", "i", F.when((F.col("i") == F.col("lo")) & (F.col("idx") > 0), F.col("y0")).otherwise(line).alias("value"))


def resampled(s: DataFrame, count: int, size: int = BLOCK) -> DataFrame:
    """count samples a trace at even steps of its length, by lines; the last sample counts as repeated."""
    n = s.groupBy("trace").agg(F.count("*").alias("n"))
    seg = segments(s.withColumn("x", F.col("idx")), "x", size).join(n, "trace")
    lo = F.expr(f"(idx * {count} + n - 1) DIV n")
    hi = F.expr(f"((idx + 1) * {count} + n - 1) DIV n") - 1
    points = seg.where(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
    part = F.col("i") * F.col("n") / count - F.col("idx")
    return points.select("trace", "i", (F.col("y0") + (F.coalesce("y1", "y0") - F.col("y0")) * part).alias("value"))


def time_range(s: DataFrame) -> DataFrame:
    """left and right of all traces together; an empty or zero span is widened by 1 on either side."""
    r = s.agg(F.coalesce(F.min("t"), F.lit(0.0)).alias("l"), F.coalesce(F.max("t"), F.lit(0.0)).alias("r"))
    return r.select(F.when(F.col("l") == F.col("r"), F.col("l") - 1).otherwise(F.col("l")).alias("left"), F.when(F.col("l") == F.col("r"), F.col("r") + 1).otherwise(F.col("r")).alias("right"))


def axis_modes(members: DataFrame) -> DataFrame:
    """How the axes of a group's members go together: group, mode, left, right, unit.

    members: group, kind (None, FFT, YT, Time or Affine), unit, log, left, right. All None, all FFT or all YT: Stretch. All Time or
    Affine of one unit: ValueAlign over the union of their ranges, if none is logarithmic, or all are with the same range.
    Anything else: Incompatible.
    """
    only = lambda *k: F.bool_and(F.col("kind").isin(*k))
    same_range = (F.min("left") == F.max("left")) & (F.min("right") == F.max("right"))
    logs = ~F.bool_or("log") | (F.bool_and("log") & same_range)
    aligned = only("Time", "Affine") & (F.min("unit") == F.max("unit")) & logs
    mode = F.when(only("None") | only("FFT") | only("YT"), "Stretch").when(aligned, "ValueAlign").otherwise("Incompatible")
    return members.groupBy("group").agg(mode.alias("mode"), F.when(aligned, F.min("left")).alias("left"), F.when(aligned, F.max("right")).alias("right"), F.when(aligned, F.min("unit")).otherwise("").alias("unit"))


def match_names(saved: DataFrame, live: DataFrame, strip) -> DataFrame:
    """(saved, live) pairs: equal names; for saved names without any, names that are equal once stripped."""
    exact = saved.join(live, saved["name"] == live["name"]).select(saved["name"].alias("saved"), live["name"].alias("live"))
    rest = saved.join(live.select("name").distinct(), "name", "left_anti")
    loose = rest.select(F.col("name").alias("saved"), strip(F.col("name")).alias("s")).join(live.select(F.col("name").alias("live"), strip(F.col("name")).alias("s")), "s")
    return exact.unionByName(loose.select("saved", "live"))


def shared_window(modes: DataFrame, zoom: float, pan: float) -> DataFrame:
    """axis_modes() with the range of ValueAlign groups cut to zoom of its span from pan on; both are clamped so that the window stays inside."""
    zoom = min(max(zoom, 0.0), 1.0)
    pan = min(max(pan, 0.0), 1.0 - zoom)
    span, aligned = F.col("right") - F.col("left"), F.col("mode") == "ValueAlign"
    lo = F.when(aligned, F.col("left") + span * pan).otherwise(F.col("left"))
    return modes.select("group", "mode", lo.alias("left"), F.when(aligned, lo + span * zoom).otherwise(F.col("right")).alias("right"), "unit")


def sub_window(members: DataFrame, pane_left: float, pane_width: float) -> DataFrame:
    """Adds x and width: where a member's range (left, right) lies on a pane that shows h_left to h_right; a flat range gets the whole pane."""
    scale = pane_width / F.when(F.col("h_right") != F.col("h_left"), F.col("h_right") - F.col("h_left"))
    x = F.coalesce(pane_left + (F.col("left") - F.col("h_left")) * scale, F.lit(pane_left))
    return members.withColumn("x", x).withColumn("width", F.coalesce((F.col("right") - F.col("left")) * scale, F.lit(pane_width)))
