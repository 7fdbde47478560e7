"""Samples of named traces as DataFrames, with an order key that doesn't need a whole trace in one task.

A trace is rows (trace, idx, value) with idx from 0 without gaps; t, in seconds, is there for traces with times of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples of one trace that a task takes as one block.
BLOCK = 1 << 16


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS TIMESTAMP_NTZ))") / 1e6


def with_index(df: DataFrame, trace: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds idx, the place of each row in its trace by `order`.

    bucket must rise with the first order column (a day, say). Rows are counted by trace and bucket, the counts are summed up
    to each bucket, and rows are numbered within their bucket only: a hot trace is spread over its buckets.
    """
    rows = df.withColumn("__b", bucket)
    counts = rows.groupBy(trace, "__b").agg(F.count("*").alias("__n"))
    passed = F.sum("__n").over(Window.partitionBy(trace).orderBy("__b")) - F.col("__n")
    starts = counts.select(trace, "__b", passed.alias("__passed"))
    at = F.row_number().over(Window.partitionBy(trace, "__b").orderBy(*order))
    return rows.withColumn("__at", at).join(starts, [trace, "__b"]).withColumn("idx", F.col("__passed") + F.col("__at") - 1).drop("__b", "__at", "__n", "__passed")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as traces by event type: trace, event_id, t, value, idx."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("trace"), "event_id", seconds("ts").alias("t"), "value")
    return with_index(events, "trace", ["t", "event_id"], F.floor(F.col("t") / 86400))


def blocks(samples: DataFrame, before: int = 0, after: int = 0, size: int = BLOCK) -> DataFrame:
    """Adds block and own: each block also gets the samples that its windows reach, `before` ahead of it and `after` behind, as rows that aren't its own."""
    if max(before, after) > size:
        raise ValueError("a window can't reach beyond the neighbouring block")
    b, place = F.floor(F.col("idx") / size), F.col("idx") % size
    goes = [F.struct(b.alias("block"), F.lit(True).alias("own"))]
    if before:
        goes.append(F.when(place >= size - before, F.struct((b + 1).alias("block"), F.lit(False).alias("own"))))
    if after:
        goes.append(F.when((place < after) & (b > 0), F.struct((b - 1).alias("block"), F.lit(False).alias("own"))))
    if len(goes) == 1:
        return samples.withColumn("block", b).withColumn("own", F.lit(True))
    spread = samples.withColumn("__g", F.explode(F.filter(F.array(*goes), lambda g: g.isNotNull())))
    return spread.withColumn("block", F.col("__g.block")).withColumn("own", F.col("__g.own")).drop("__g")


def framed(samples: DataFrame, before: int, after: int, columns: dict, size: int = BLOCK) -> DataFrame:
    """Adds columns made by functions of a window with a frame from `before` rows ahead to `after` rows behind, block by block."""
    w = Window.partitionBy("trace", "block").orderBy("idx").rowsBetween(-before, after)
    out = blocks(samples, before, after, size)
    for name, f in columns.items():
        out = out.withColumn(name, f(w))
    return out.where("own").drop("block", "own")


def running_sum(samples: DataFrame, value: Column, name: str, size: int = BLOCK) -> DataFrame:
    """Adds the sum of value over all samples of the trace up to each row: block sums, their running sums, then sums within blocks."""
    rows = blocks(samples.withColumn("__v", value), size=size)
    sums = rows.groupBy("trace", "block").agg(F.sum("__v").alias("__s"))
    passed = F.coalesce(F.sum("__s").over(Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    carried = sums.select("trace", "block", passed.alias("__passed"))
    inside = F.sum("__v").over(Window.partitionBy("trace", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__i", inside).join(carried, ["trace", "block"]).withColumn(name, F.col("__passed") + F.col("__i")).drop("block", "own", "__v", "__i", "__passed", "__s")


def time_of(sps: Column, leftmost: Column, offset: Column, mult: Column) -> Column:
    """Horizontal place of a sample: (idx + offset) / sps where sps isn't 0, else (idx + offset) * mult; idx where the offset isn't finite or mult isn't above 0."""
    at = F.col("idx") + offset
    bad = F.isnan(offset) | (F.abs(offset) == float("inf")) | ((sps == 0) & (mult <= 0))
    return F.when(bad, F.col("idx").cast("double")).when(sps != 0, leftmost + at / sps).otherwise(leftmost + at * mult)


def from_arrays(df: DataFrame, trace: str, values: str) -> DataFrame:
    """Samples from a row a trace with an array of values."""
    return df.select(F.col(trace).alias("trace"), F.posexplode(values).alias("idx", "value")).withColumn("idx", F.col("idx").cast("long")).withColumn("value", F.col("value").cast("double"))


def from_wide(df: DataFrame, order: str, traces: list[str]) -> DataFrame:
    """Samples from a column a trace."""
    return df.unpivot([order], traces, "trace", "value").select("trace", F.col(order).cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


def lagged_time(samples: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds before: the time of the sample before, null at the start."""
    rows = blocks(samples, before=1, size=size)
    return rows.withColumn("before", F.lag("t").over(Window.partitionBy("trace", "block").orderBy("idx"))).where("own").drop("block", "own")


def updated(values: DataFrame, times: DataFrame | None = None, sps: float | None = None) -> DataFrame:
    """New samples of traces: trace, idx, value, t, sps, from values (trace, idx, value) and times (trace, idx, t).

    Times of a trace that are more or fewer than its values are left out; a trace with times but without a finite rate has the
    rate 0, which says that its times count.
    """
    rate = F.lit(sps if sps is not None and abs(sps) != float("inf") and sps == sps else None).cast("double")
    rows = values.select("trace", "idx", "value")
    if times is None:
        return rows.select("*", F.lit(None).cast("double").alias("t"), rate.alias("sps"))
    n = rows.groupBy("trace").agg(F.count("*").alias("n")).join(times.groupBy("trace").agg(F.count("*").alias("k")), "trace").where("n = k").select("trace", F.lit(True).alias("timed"))
    joined = rows.join(times.select("trace", "idx", "t"), ["trace", "idx"], "left").join(n, "trace", "left")
    return joined.select("trace", "idx", "value", F.when(F.col("timed"), F.col("t")).alias("t"), F.when(F.col("timed"), F.coalesce(rate, F.lit(0.0))).otherwise(rate).alias("sps"))
