"""Summaries of samples at all zooms: any range of a trace is a few cells, however long it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import few, written

#: Cells of one level that make one of the next.
FAN = 1 << 12


def _summed(rows: DataFrame, cell: Column, size: int) -> DataFrame:
    return rows.groupBy("trace", cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).withColumn("level", F.lit(size))


def pyramid(s: DataFrame, fan: int = FAN) -> DataFrame:
    """trace, level, cell, n, low, high, total, squares, written once: cells of level k cover fan ** k samples; level 0 are the samples. Levels end where each trace is one cell."""
    level = written(s.select("trace", F.col("idx").alias("cell"), "value"), "pyramid_0")
    level = level.select("trace", "cell", F.lit(1).cast("long").alias("n"), F.col("value").alias("low"), F.col("value").alias("high"), F.col("value").alias("total"), (F.col("value") * F.col("value")).alias("squares"), F.lit(0).alias("level"))
    out, k = level, 0
    while (level.agg(F.max("cell")).first()[0] or 0) > 0:
        k += 1
        level = written(_summed(level, F.floor(F.col("cell") / fan), k), f"pyramid_{k}")
        out = out.unionByName(level)
    return out


def runs(ranges: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """The runs of cells (level, a, b; b left out) that each range (its columns, trace, lo, hi; hi left out) is made of: at most two of each level, each within the cells that make one of the next level.

    Cells of a level that the next level's cells don't cover lie at both ends of the range; the level from which no larger cell
    fits gives all that is left. Levels are those of the longest trace; a range must not go beyond its trace.
    """
    per = []
    for k in range(levels + 1):
        size, large = fan**k, fan ** (k + 1)
        lo, hi = F.ceil(F.col("lo") / size), F.floor(F.col("hi") / size)
        a, b = F.ceil(F.col("lo") / large) * fan, F.floor(F.col("hi") / large) * fan
        end = F.least(a, hi)
        per += [F.struct(F.lit(k).alias("level"), x.alias("a"), y.alias("b")) for x, y in ((lo, end), (F.greatest(b, end), hi))]
    some = F.filter(F.array(*per), lambda r: r["a"] < r["b"])
    return ranges.withColumn("__r", F.explode(some)).select(*ranges.columns, "__r.level", "__r.a", "__r.b")


def pieces(ranges: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """The single cells of the runs: at most 2 (fan - 1) of each level."""
    return runs(ranges, levels, fan).withColumn("cell", F.explode(F.sequence("a", F.col("b") - 1))).drop("a", "b")


SUMS = ("n", "low", "high", "total", "squares")
#: How a column of cells is put together, and what a missing cell or null counts as: null is left out, NaN is the greatest value.
MERGED = {"n": (np.add, 0), "low": (np.fmin, np.nan), "high": (np.maximum, -np.inf), "total": (np.add, 0.0), "squares": (np.add, 0.0), "some": (np.maximum, 0)}


def over_runs(cells: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """The cells' columns put together over runs from a to b, b left out, none empty. The cells' number is a power of two.

    A run of more than one cell crosses the middle of just one block of 2, 4, 8... cells: it is what leads up to the middle and
    what follows it. Nothing is taken away from a sum, so no rounding of other cells comes in.
    """
    last = b - 1
    out = {c: v[a] for c, v in cells.items()}
    bits = np.frexp((a ^ last).astype(float))[1]  # 0 for a single cell
    for bit in np.unique(bits[bits > 0]).tolist():
        here = np.flatnonzero(bits == bit)
        for c, v in cells.items():
            merge, half = MERGED[c][0], 1 << (bit - 1)
            block = v.reshape(-1, 2, half)
            both = np.stack([merge.accumulate(block[:, 0, ::-1], axis=1)[:, ::-1], merge.accumulate(block[:, 1], axis=1)], axis=1).ravel()
            out[c][here] = merge(both[a[here]], both[last[here]])
    return out


def range_stats(cells: DataFrame, ranges: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """keys, n, low, high, total, mean, rms, std of each of many ranges (keys, trace, lo, hi; hi left out), from the pyramid's cells.

    A range is two runs of cells a level. Tasks take the cells of a group, then its runs in a stream, however many there are.
    Ranges are cut to their trace; those that have no sample there are left out.
    """
    last = cells.where("level = 0").groupBy("trace").agg(F.max("cell").alias("__last"))
    levels = cells.agg(F.max("level")).first()[0] or 0
    inside = ranges.join(F.broadcast(last) if few(last) else last, "trace").withColumn("lo", F.greatest("lo", F.lit(0))).withColumn("hi", F.least("hi", F.col("__last") + 1)).drop("__last").where("lo < hi")
    keyed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    asked = runs(inside, levels, fan).select("trace", "level", F.floor(F.col("a") / fan).alias("group"), F.lit(1).alias("kind"), "a", "b", *[F.lit(None).cast("long" if c == "n" else "double").alias(c) for c in SUMS], *keyed)
    nothing = [F.lit(None).cast(inside.schema[k].dataType).alias(f"__k{i}") for i, k in enumerate(keys)]
    held = cells.where("trace IS NOT NULL").select("trace", "level", F.floor(F.col("cell") / fan).alias("group"), F.lit(0).alias("kind"), F.col("cell").alias("a"), F.col("cell").alias("b"), *SUMS, *nothing)
    both = held.unionByName(asked).repartition("trace", "level", "group").sortWithinPartitions("group", "level", "trace", "kind")
    size = 1 << (fan - 1).bit_length()
    names = [f"__k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, {}
        for batch in batches:
            trace = batch.column("trace").dictionary_encode()
            code = trace.indices.to_numpy()
            level, group, kind, a, b = (batch.column(c).to_numpy() for c in ("level", "group", "kind", "a", "b"))
            turns = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (code, level, group, kind)], axis=0)) + 1
            cuts = [0, *turns.tolist(), len(code)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                here = (level[i], group[i], trace.dictionary[code[i]].as_py())
                if here != at:
                    at, table = here, {c: np.full(size, none) for c, (_, none) in MERGED.items()}
                part, start = batch.slice(i, j - i), group[i] * fan
                if kind[i] == 0:
                    place = a[i:j] - start
                    for c in SUMS:
                        values = part.column(c)
                        table[c][place] = values.fill_null(MERGED[c][1]).to_numpy(zero_copy_only=False)
                    table["some"][place] = part.column("low").is_valid().to_numpy(zero_copy_only=False)
                else:
                    got = over_runs(table, a[i:j] - start, b[i:j] - start)
                    none = got["some"] == 0
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], pa.array(got["n"], pa.int64()), *[pa.array(got[c], pa.float64(), mask=none) for c in SUMS[1:]]], names=[*names, *SUMS])

    schema = StructType([both.schema[k] for k in (*names, *SUMS)])
    met = both.mapInArrow(run, schema).toDF(*keys, *SUMS)
    sums = met.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    mean, square = F.col("total") / F.col("n"), F.col("squares") / F.col("n")
    spread = F.when(square - mean * mean > 1e-12 * square, F.sqrt(square - mean * mean)).otherwise(0.0)
    return sums.select(*keys, "n", "low", "high", "total", mean.alias("mean"), F.sqrt(square).alias("rms"), spread.alias("std"))


def zoomed(cells: DataFrame, views: DataFrame, width: int, fan: int = FAN) -> DataFrame:
    """trace, view, pixel, low, high, mean: views (view, trace, lo, hi) drawn on width pixels, each pixel of a view at least one sample, whatever the zoom."""
    p = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))
    n = F.col("hi") - F.col("lo")
    rows = views.where("lo < hi").withColumn("pixel", p).withColumn("__n", n).withColumn("__lo", F.col("lo"))
    start = F.expr(f"__lo + (pixel * __n) DIV {width}")
    end = F.greatest(F.expr(f"__lo + ((pixel + 1) * __n) DIV {width}"), start + 1)
    ranges = rows.select("view", "trace", "pixel", start.alias("lo"), end.alias("hi"))
    return range_stats(cells, ranges, ["trace", "view", "pixel"], fan).select("trace", "view", "pixel", "low", "high", "mean")


def upsampled(s: DataFrame, views: DataFrame, width: int) -> DataFrame:
    """trace, view, pixel, nearest, linear: the samples under width pixels of views (view, trace, lo, hi), for views of fewer samples than pixels.

    Pixel p lies at p n / width. nearest is the sample at or before it. linear goes on from there to the next one, except for the
    first pixel on a sample, which shows the sample exactly; beyond the last sample it stays there.
    """
    p = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))
    rows = views.where("lo < hi").withColumn("pixel", p).withColumn("__n", F.col("hi") - F.col("lo"))
    at = F.expr(f"(pixel * __n) DIV {width}")
    rest = F.expr(f"(pixel * __n) % {width}") / width
    first = (F.col("pixel") == 0) | (F.expr(f"((pixel - 1) * __n) DIV {width}") != at)
    rows = rows.select("trace", "view", "pixel", (F.col("lo") + at).alias("idx"), F.least(F.col("lo") + at + 1, F.col("hi") - 1).alias("next"), F.when(first, 0.0).otherwise(rest).alias("ratio"))
    own, after = s.select("trace", "idx", F.col("value").alias("x")), s.select("trace", F.col("idx").alias("next"), F.col("value").alias("y"))
    met = rows.join(own, ["trace", "idx"]).join(after, ["trace", "next"])
    return met.select("trace", "view", "pixel", F.col("x").alias("nearest"), (F.col("x") * (1 - F.col("ratio")) + F.col("y") * F.col("ratio")).alias("linear"))
