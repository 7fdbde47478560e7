"""All queries of the library by name, with SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, vector
from ..model import event_samples
from ..operators import calc, lookup, registry, sequential, spectral, stats, triggers, windows
from ..session import shared_dir, shipped, written
from ..sources import datasource, files, generators
from ..streaming import live
from .grid import Grid, placed, reachable
from .view import View, offset_and_length, set_range

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The events table as samples.
S = "WITH s AS (SELECT event_type AS trace, event_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def out(df: DataFrame, *names: str) -> DataFrame:
    """trace, event_id and rounded columns."""
    return df.select("trace", "event_id", *[r(n).alias(n) for n in names or ("out",)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(frame: str) -> str:
    return f"OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN {frame})"


def primed(value: str, n: int) -> str:
    f = over(f"{n - 1} PRECEDING AND CURRENT ROW")
    return f"((sum({value}) {f} + first_value({value}) OVER (PARTITION BY trace ORDER BY idx) * ({n} - count(*) {f})) / {n})"


def one(expression: str, source: str = "s") -> str:
    return f"{S} SELECT trace, event_id, round({expression}, 6) AS out FROM {source}"


# Windows


@query(one(f"avg(value) {over('2 PRECEDING AND 2 FOLLOWING')}"))
def rolling_mean(spark, sf_dir):
    return out(windows.rolling_mean(event_samples(spark, sf_dir), 5))


@query(one(f"sqrt(avg(value * value) {over('2 PRECEDING AND 2 FOLLOWING')})"))
def rolling_rms(spark, sf_dir):
    return out(windows.rolling_rms(event_samples(spark, sf_dir), 5))


@query(one(f"max(value) {over('2 PRECEDING AND 2 FOLLOWING')}"))
def rolling_max(spark, sf_dir):
    return out(windows.rolling_max(event_samples(spark, sf_dir), 5))


@query(one("coalesce(value - lag(value) OVER (PARTITION BY trace ORDER BY idx), 0)"))
def differentiate(spark, sf_dir):
    return out(windows.differentiated(event_samples(spark, sf_dir)))


@query(one(f"sum(value) {over('UNBOUNDED PRECEDING AND CURRENT ROW')}"))
def integrate(spark, sf_dir):
    return out(windows.integrated(event_samples(spark, sf_dir)))


@query(one("coalesce(lag(value, 3) OVER (PARTITION BY trace ORDER BY idx), 0)"))
def delay(spark, sf_dir):
    return out(windows.delay(event_samples(spark, sf_dir), 3))


@query(
    f"""{S}, d AS (SELECT *, lag(value) OVER (PARTITION BY trace ORDER BY idx) - value AS j FROM s)
SELECT trace, event_id, round(value + sum(CASE WHEN j > 180 THEN 360.0 WHEN j < -180 THEN -360.0 ELSE 0.0 END) {over("UNBOUNDED PRECEDING AND CURRENT ROW")}, 6) AS out FROM d"""
)
def unwrap_degrees(spark, sf_dir):
    return out(windows.unwrapped(event_samples(spark, sf_dir), 360.0, 180.0))


@query(one(primed("value", 4)))
def moving_average(spark, sf_dir):
    return out(windows.moving_average(event_samples(spark, sf_dir), 4))


@query(one(f"sqrt({primed('value * value', 4)})"))
def moving_rms(spark, sf_dir):
    return out(windows.moving_rms(event_samples(spark, sf_dir), 4))


@query(one(f"value - {primed('value', 8)}"))
def dc_block(spark, sf_dir):
    return out(windows.dc_block(event_samples(spark, sf_dir), 8))


HISTORY = f"""{S}, h AS (SELECT *, {primed("value", 4)} AS mean, {primed("value * value", 4)} AS ms, coalesce(lag(value, 3) OVER (PARTITION BY trace ORDER BY idx), first_value(value) OVER (PARTITION BY trace ORDER BY idx)) AS oldest FROM s)"""


@query(
    f"{HISTORY} SELECT trace, event_id, round(oldest, 6) AS out, round(mean * 4, 6) AS sum, round(ms * 4, 6) AS sum_square, round(mean, 6) AS mean, round(sqrt(ms), 6) AS rms, "
    "round(CASE WHEN ms - mean * mean > 1e-12 * ms THEN sqrt(ms - mean * mean) ELSE 0 END, 4) AS std FROM h"
)
def history_stats(spark, sf_dir):
    s = windows.history_stats(event_samples(spark, sf_dir), 4)
    return s.select("trace", "event_id", *[r(c).alias(c) for c in ("out", "sum", "sum_square", "mean", "rms")], r("std", 4).alias("std"))


FIXED = primed("q", 4).replace(") / 4)", "))")


@query(
    f"""{S}, f AS (SELECT *, trunc(value * 16)::BIGINT AS q FROM s), h AS (SELECT trace, event_id, {FIXED} AS sq, {FIXED.replace("(q)", "(q * q)")} AS sqq FROM f)
SELECT trace, event_id, round(sq / 16.0, 6) AS sum, round(sqq / 256.0, 6) AS sum_square, round(sq / 64.0, 6) AS mean FROM h"""
)
def fixed_point_stats(spark, sf_dir):
    return out(windows.fixed_point_stats(event_samples(spark, sf_dir), 4, 4), "sum", "sum_square", "mean")


@query(
    f"""{HISTORY}, g AS (SELECT *, CASE WHEN idx >= 3 AND (ms - mean * mean <= 0 OR sqrt(greatest(ms - mean * mean, 0)) < 20) THEN value END AS steady FROM h)
SELECT trace, event_id, round(coalesce(last_value(steady IGNORE NULLS) {over("UNBOUNDED PRECEDING AND CURRENT ROW")}, 0), 6) AS out FROM g"""
)
def steady_state(spark, sf_dir):
    return out(windows.steady_state(event_samples(spark, sf_dir), 4, 20.0))


TAPS = [0.1, 0.2, 0.4, 0.2, 0.1]


def fir_sql(taps: list[float]) -> str:
    n, w = len(taps), "OVER (PARTITION BY trace ORDER BY idx)"
    return one(" + ".join(f"coalesce(lag(value, {n - 1 - k}) {w}, first_value(value) {w}) * ({c!r})::DOUBLE" for k, c in enumerate(taps)))


@query(fir_sql(TAPS))
def fir(spark, sf_dir):
    return out(windows.fir(event_samples(spark, sf_dir), TAPS))


_W = "OVER (PARTITION BY trace ORDER BY idx)"
_LAST = "last_value(value) OVER (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(
    one(" + ".join(f"coalesce({'lead' if k > 2 else 'lag'}(value, {abs(k - 2)}) {_W}, {_LAST if k > 2 else f'first_value(value) {_W}'}) * {c}" for k, c in enumerate(TAPS)))
)
def fir_centred(spark, sf_dir):
    return out(windows.centred_fir(event_samples(spark, sf_dir), TAPS))


#: The parabola through five samples at its middle, by the normal equations: the sums of x ** 2 and x ** 4 over -2 to 2 are 10 and 34.
PARABOLA = [(34 - 10 * x * x) / (5 * 34 - 10 * 10) for x in range(-2, 3)]


@query(fir_sql(PARABOLA))
def savitzky_golay(spark, sf_dir):
    return out(windows.savitzky_golay(event_samples(spark, sf_dir), 5, 2))


@query(f"{S} SELECT trace, event_id, greatest(least(value, 60.0), 20.0) AS limited, round(value * 2.5, 6) AS gained FROM s")
def limiter_and_gain(spark, sf_dir):
    s = windows.limiter(event_samples(spark, sf_dir), 20.0, 60.0).withColumnRenamed("out", "limited")
    return out(windows.gain(s, 2.5).withColumnRenamed("out", "gained"), "limited", "gained")


@query(
    f"""{S}, v AS (SELECT trace, event_id, value / 50 - 1 AS v FROM s), d AS (SELECT *, 1 - (abs(v) - 0.5) / 0.5 AS d FROM v)
SELECT trace, event_id, round(CASE WHEN abs(v) > 1 THEN 0.8 WHEN abs(v) < 0.5 THEN abs(v) ELSE sign(v) * (0.5 + (1 - d * d) * 0.3) END, 6) AS out FROM d"""
)
def progressive_limiter(spark, sf_dir):
    s = event_samples(spark, sf_dir).withColumn("value", F.col("value") / 50 - 1)
    return out(windows.progressive_limiter(s))


@query()
def noise_added(spark, sf_dir):
    return out(windows.noise_added(event_samples(spark, sf_dir), 0.1, 7))


# Aggregates


@query(
    f"""{S} SELECT trace, count(*) AS count, min(value) AS min, max(value) AS max, round(max(value) - min(value), 6) AS range, round(sum(value), 4) AS sum, round(sum(value * value), 3) AS sum_square, round(avg(value), 6) AS mean,
round(sqrt(avg(value * value)), 6) AS rms, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS std, arg_max(value, idx) AS last FROM s GROUP BY trace"""
)
def trace_stats(spark, sf_dir):
    s = stats.trace_stats(event_samples(spark, sf_dir))
    digits = {"range": 6, "sum": 4, "sum_square": 3, "mean": 6, "rms": 6, "variance": 4, "std": 6}
    return s.select([r(c, digits[c]).alias(c) if c in digits else F.col(c) for c in s.columns])


@query(f"{S} SELECT trace, round(regr_slope(value, idx), 9) AS slope, round(regr_intercept(value, idx), 6) AS intercept, round(regr_r2(value, idx), 9) AS r_squared FROM s GROUP BY trace")
def linear_regression(spark, sf_dir):
    s = stats.linear_regression(event_samples(spark, sf_dir))
    return s.select("trace", r("slope", 9).alias("slope"), r("intercept").alias("intercept"), r("r_squared", 9).alias("r_squared"))


@query(
    f"""{S}, m AS (SELECT trace, avg(value) AS mean, median(value) AS med FROM s GROUP BY trace)
SELECT trace, round(any_value(med), 6) AS median, round(avg(abs(value - mean)), 6) AS mad_mean, round(median(abs(value - med)), 6) AS mad_median FROM s JOIN m USING (trace) GROUP BY trace"""
)
def medians(spark, sf_dir):
    return stats.medians(event_samples(spark, sf_dir)).select("trace", *[r(c).alias(c) for c in ("median", "mad_mean", "mad_median")])


@query("SELECT user_id::VARCHAR AS trace, round(product(value / 50), 9) AS product, round(sqrt(sum(value / 50 * value / 50)), 6) AS magnitude FROM events GROUP BY user_id")
def product_and_norm(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trace"), (F.col("value") / 50).alias("value"))
    return stats.products(e).select("trace", r("product", 9).alias("product"), r("magnitude").alias("magnitude"))


@query(
    f"""{S} SELECT trace, CASE WHEN min(abs(value)) = 0 THEN 0 WHEN count(*) FILTER (value < 0) % 2 = 1 THEN -1 ELSE 1 END::INTEGER AS sign, CASE WHEN min(abs(value)) > 0 THEN round(sum(log10(abs(value) / 50)), 6) END AS log10,
round(sqrt(sum(value / 50 * value / 50)), 6) AS magnitude FROM s GROUP BY trace"""
)
def product_and_norm_whole(spark, sf_dir):
    s = event_samples(spark, sf_dir).withColumn("value", F.col("value") / 50)
    return stats.log_products(s).select("trace", "sign", r("log10").alias("log10"), r("magnitude").alias("magnitude"))


@query(f"{S} SELECT a.trace AS trace, round(sum(a.value * b.value), 3) AS dot FROM s a JOIN s b ON a.idx = b.idx AND b.trace = 'click' GROUP BY a.trace")
def dot_product(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    other = s.where("trace = 'click'").select("idx", F.col("value").alias("b"))
    return s.join(other, "idx").groupBy("trace").agg(r(F.sum(F.col("value") * F.col("b")), 3).alias("dot"))


@query(
    f"""{S}, e AS (SELECT trace, min(value) AS lo, max(value) AS hi, count(*) AS n FROM s GROUP BY trace), b AS (SELECT trace, unnest(range(10))::INTEGER AS bin, lo, hi, n FROM e),
c AS (SELECT s.trace, floor(9 * (value - lo) / (hi - lo))::INTEGER AS bin, count(*) AS k FROM s JOIN e USING (trace) GROUP BY 1, 2)
SELECT b.trace, b.bin, round(lo + (hi - lo) / 10 * (b.bin + 0.5), 6) AS centre, coalesce(k, 0) AS count, round(coalesce(k, 0) / n, 6) AS fraction FROM b LEFT JOIN c ON b.trace = c.trace AND b.bin = c.bin"""
)
def histogram(spark, sf_dir):
    return stats.histogram(event_samples(spark, sf_dir), 10).select("trace", "bin", r("centre").alias("centre"), "count", r("fraction").alias("fraction"))


@query(f"{S} SELECT trace, idx % 64 AS idx, min(value) AS low, max(value) AS high FROM s GROUP BY 1, 2")
def peak_hold(spark, sf_dir):
    return stats.peak_hold(event_samples(spark, sf_dir).withColumn("idx", F.col("idx") % 64))


@query(f"{S} SELECT trace, idx % 64 AS place, round(sum(value) / any_value(n), 9) AS value FROM s JOIN (SELECT trace, count(DISTINCT idx // 64) AS n FROM s GROUP BY trace) USING (trace) GROUP BY 1, 2")
def slice_mean(spark, sf_dir):
    s = event_samples(spark, sf_dir).select("trace", F.floor(F.col("idx") / 64).alias("slice"), (F.col("idx") % 64).alias("place"), "value")
    return stats.slice_mean(s).withColumn("value", r("value", 9))


@query(
    f"""{S}, n AS (SELECT trace, count(*) AS n FROM s GROUP BY trace), p AS (SELECT trace, n, unnest(range(100)) AS pixel FROM n)
SELECT p.trace, pixel, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM p JOIN s ON s.trace = p.trace AND idx >= pixel * n // 100 AND idx < greatest((pixel + 1) * n // 100, pixel * n // 100 + 1) GROUP BY 1, 2"""
)
def pixels(spark, sf_dir):
    return stats.pixels(event_samples(spark, sf_dir), 100).withColumn("mean", r("mean"))


@query("SELECT c_nationkey::VARCHAR AS trace FROM customer GROUP BY 1 HAVING count(*) < 2 OR min(CASE WHEN c_nationkey % 2 = 0 THEN 1.0 ELSE c_acctbal END) = max(CASE WHEN c_nationkey % 2 = 0 THEN 1.0 ELSE c_acctbal END)")
def flat_traces(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return stats.flat_traces(c.select(F.col("c_nationkey").cast("string").alias("trace"), F.when(F.col("c_nationkey") % 2 == 0, 1.0).otherwise(F.col("c_acctbal")).alias("value")))


@query()
def auto_range(spark, sf_dir):
    return stats.auto_range(event_samples(spark, sf_dir)).select("trace", r("low").alias("low"), r("high").alias("high"))


@query(f"{S} SELECT trace, count(*) AS count, round(avg(value), 6) AS mean FROM s WHERE t >= 1704500000 AND t < 1705000000 GROUP BY trace")
def stats_between_times(spark, sf_dir):
    return stats.between_times(event_samples(spark, sf_dir), 1704500000.0, 1705000000.0).select("trace", "count", r("mean").alias("mean"))


@query(
    f"""{S}, d AS (SELECT trace, t - lag(t) OVER (PARTITION BY trace ORDER BY idx) AS g FROM s)
SELECT trace, round(stddev_pop(g), 3) AS gap_std, round(1 / min(CASE WHEN g > 0 THEN g END), 3) AS samples_per_second FROM d GROUP BY trace"""
)
def time_stats(spark, sf_dir):
    return stats.time_stats(event_samples(spark, sf_dir)).select("trace", r("gap_std", 3).alias("gap_std"), r("samples_per_second", 3).alias("samples_per_second"))


# Calculations across traces


def many_sql(expression: str) -> str:
    return f"{S} SELECT idx, round({expression}, 6) AS out FROM s WHERE trace IN ('click', 'view', 'error') GROUP BY idx"


def pair_sql(expression: str, source: str = "s", before: str = "") -> str:
    return f"{S}{before} SELECT a.idx AS idx, round({expression}, 6) AS out FROM {source} a JOIN {source} b ON a.idx = b.idx AND a.trace = 'click' AND b.trace = 'view'"


def add_calculations() -> None:
    for kind, expression in (("Magnitude", "sqrt(sum(value * value))"), ("Sum", "sum(value)"), ("Mean", "avg(value)"), ("Product", "product(value)")):

        def many(spark, sf_dir, kind=kind):
            return calc.calculate(kind, event_samples(spark, sf_dir), ["click", "view", "error"]).select("idx", r("out").alias("out"))

        many.__name__ = f"calc_{kind.lower()}"
        query(many_sql(expression))(many)
    scaled = ", w AS (SELECT trace, idx, {} AS value FROM s WHERE trace IN ('click', 'view'))"
    rescaled = scaled.format("(value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p)").replace("'view'))", "'view') WINDOW p AS (PARTITION BY trace))")
    normalised = scaled.format("value / sqrt(sum(value * value) OVER (PARTITION BY trace))")
    for kind, sql in (
        ("Atan2", pair_sql("atan2(a.value, b.value)")),
        ("Difference", pair_sql("abs(a.value - b.value)")),
        ("Subtract", pair_sql("a.value - b.value")),
        ("RescaledError", pair_sql("a.value - b.value", "w", rescaled)),
        ("NormalisedError", pair_sql("a.value - b.value", "w", normalised)),
    ):

        def pair(spark, sf_dir, kind=kind):
            return calc.calculate(kind, event_samples(spark, sf_dir), ["click", "view"]).select("idx", r("out").alias("out"))

        pair.__name__ = f"calc_{kind.lower()}"
        query(sql)(pair)
    for kind, expression in (
        ("Abs", "abs(value)"),
        ("SubtractOffset", "value - 1"),
        ("ProductSimple", "value * 1"),
        ("Rescale", "(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())"),
        ("Normalised", "value / sqrt(sum(value * value) OVER ())"),
        ("Differentiate", "coalesce(value - lag(value) OVER (ORDER BY idx), 0)"),
        ("Integrate", "sum(value) OVER (ORDER BY idx)"),
        ("Quantize", "round((value - 1) * 32767) / 32767"),
        ("RollingRMS", "sqrt(avg(value * value) OVER (ORDER BY idx ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING))"),
        ("RollingMean", "avg(value) OVER (ORDER BY idx ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)"),
    ):

        def single(spark, sf_dir, kind=kind):
            return calc.calculate(kind, event_samples(spark, sf_dir), ["click"]).select("trace", "event_id", r("out", 9).alias("out"))

        single.__name__ = f"calc_{kind.lower()}"
        query(one(expression, "s WHERE trace = 'click'").replace(", 6) AS out", ", 9) AS out"))(single)


add_calculations()


@query(one("value * 10 / greatest(-min(value) OVER (PARTITION BY trace), max(value) OVER (PARTITION BY trace))"))
def rescale_to_peak(spark, sf_dir):
    return out(calc.rescaled_to_peak(event_samples(spark, sf_dir), 10.0))


@query(f"{S} SELECT a.idx AS idx, a.value AS x, b.value AS y FROM s a JOIN s b ON a.idx = b.idx AND a.trace = 'click' AND b.trace = 'view'")
def xy_pairs(spark, sf_dir):
    return calc.xy(event_samples(spark, sf_dir), "click", "view")


@query()
def calc_polyfilter(spark, sf_dir):
    return calc.calculate("PolyFilter", event_samples(spark, sf_dir), ["click"]).withColumn("out", r("out"))


@query(
    f"""{S}, k AS (SELECT idx AS k, value AS tap, count(*) OVER () AS m FROM s WHERE trace = 'view'), c AS (SELECT idx, value, count(*) OVER () AS n FROM s WHERE trace = 'click')
SELECT c.idx, round(CASE WHEN any_value(c.n) < any_value(c.m) // 2 THEN 0 ELSE sum(tap * x.value) END, 4) AS out
FROM (SELECT c.idx, n, m, tap, greatest(0, least(n - 1, c.idx + k - (m - 1 - m // 2))) AS place FROM c, k) c JOIN c x ON x.idx = c.place GROUP BY c.idx"""
)
def calc_fir(spark, sf_dir):
    return calc.calculate("FIR", event_samples(spark, sf_dir), ["click", "view"]).select("idx", r("out", 4).alias("out"))


@query()
def named_filters(spark, sf_dir):
    s, parts = written(event_samples(spark, sf_dir).select("trace", "idx", "value"), "named_samples"), None
    for name in ("Box 10", "Delay 5", "Lpf 0.1", "Hpf 0.1", "Notch 0.1", "SG 10/3", "RMS 100", "A 48k", "Bessel"):
        p = registry.filtered(s, name).select(F.lit(name).alias("filter"), "trace", "idx", (r("out", {"Bessel": 4, "SG 10/3": 9}.get(name, 6)) + F.lit(0.0)).alias("out"))
        p = written(p, "named_filter")  # each in a job of its own: in one stage all would share few tasks, with large sorts
        parts = p if parts is None else parts.unionByName(p)
    return parts


@query(
    f"""{S}, v AS (SELECT trace, idx, t, floor(value / 50) AS v FROM s), c AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL OR lag(v) OVER w <> v THEN t END AS since FROM v WINDOW w AS (PARTITION BY trace ORDER BY idx))
SELECT trace, idx, round(t - max(since) OVER (PARTITION BY trace ORDER BY idx), 4) AS out FROM c"""
)
def since_change(spark, sf_dir):
    s = event_samples(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return triggers.since_change(s).select("trace", "idx", r("out", 4).alias("out"))


@query(f"{S} SELECT idx, trace || '.Value' AS \"column\", value FROM s UNION ALL SELECT idx, trace || '.Time', t FROM s")
def export_columns(spark, sf_dir):
    return files.export_columns(event_samples(spark, sf_dir), True)


# Lookups


@query(
    f"""{S}, q AS (SELECT 'click' AS trace, t, event_id FROM s WHERE trace = 'error'), c AS (SELECT * FROM s WHERE trace = 'click')
SELECT q.trace, q.t, q.event_id, coalesce(c.idx, 0) AS idx, coalesce(c.value, (SELECT value FROM c WHERE idx = 0)) AS value, coalesce(c.t, (SELECT t FROM c WHERE idx = 0)) AS time FROM q ASOF LEFT JOIN c ON q.t > c.t"""
)
def as_of_strict(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    return lookup.as_of(s, s.where("trace = 'error'").select(F.lit("click").alias("trace"), "t", "event_id"), 86400.0)


@query(
    f"""{S}, q AS (SELECT 'click' AS trace, t, event_id FROM s WHERE trace = 'error'), c AS (SELECT * FROM s WHERE trace = 'click'),
i AS (SELECT q.*, least(greatest(round((t - 1704067200) * 0.001), 0), (SELECT max(idx) FROM c))::BIGINT AS idx FROM q)
SELECT i.trace, i.t, i.event_id, i.idx, c.value FROM i JOIN c USING (idx)"""
)
def at_uniform_time(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    q = s.where("trace = 'error'").select(F.lit("click").alias("trace"), "t", "event_id")
    return lookup.at_uniform(s, q, 0.001, 1704067200.0).select("trace", "t", "event_id", "idx", "value")


@query(
    f"""{S}, e AS (SELECT trace, max(CASE WHEN t < 1704500000 THEN idx END) AS lo, min(CASE WHEN t > 1704600000 THEN idx END) AS hi FROM s GROUP BY trace)
SELECT s.trace, idx, value FROM s JOIN e ON s.trace = e.trace AND (lo IS NULL OR idx >= lo) AND (hi IS NULL OR idx <= hi)"""
)
def time_slice(spark, sf_dir):
    return lookup.time_slice(event_samples(spark, sf_dir), 1704500000.0, 1704600000.0).select("trace", "idx", "value")


@query(
    f"""{S}, q AS (SELECT trace, unnest([1.0, 50.0, 123.4, 250.0, 1000.0]::DOUBLE[]) AS level FROM (SELECT DISTINCT trace FROM s))
SELECT q.trace, level, coalesce(min(idx), -1) AS idx FROM q LEFT JOIN s ON s.trace = q.trace AND value >= level GROUP BY 1, 2"""
)
def first_at_least(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    levels = s.select("trace").distinct().withColumn("level", F.explode(F.array(*[F.lit(x) for x in (1.0, 50.0, 123.4, 250.0, 1000.0)])))
    return lookup.first_at_least(s, levels, "level")


@query(
    f"""{S}, g AS (SELECT trace, unnest(range(300)) AS i FROM (SELECT DISTINCT trace FROM s)), p AS (SELECT trace, t AS x0, value AS y0, lead(t) OVER w AS x1, lead(value) OVER w AS y1 FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx))
SELECT g.trace, g.i, round(coalesce(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (1704060000 + 9000.0::DOUBLE * g.i - x0) / (x1 - x0) END, 'nan'::DOUBLE), 5) AS value
FROM g LEFT JOIN p ON g.trace = p.trace AND 1704060000 + 9000.0::DOUBLE * g.i >= x0 AND (1704060000 + 9000.0::DOUBLE * g.i < x1 OR (x1 IS NULL AND 1704060000 + 9000.0::DOUBLE * g.i = x0))"""
)
def linear_onto_grid(spark, sf_dir):
    return lookup.linear_onto_grid(event_samples(spark, sf_dir), "t", 300, 1704060000.0, 9000.0).select("trace", "i", r("value", 5).alias("value"))


@query()
def to_uniform(spark, sf_dir):
    s = event_samples(spark, sf_dir).withColumn("t", F.col("idx") + (F.col("event_id") % 3) * 0.1)
    return lookup.to_uniform(s).withColumn("value", r("value"))


@query(
    f"""{S}, n AS (SELECT trace, count(*) AS n FROM s GROUP BY trace), g AS (SELECT trace, n, unnest(range(500)) AS i FROM n)
SELECT g.trace, i, round(a.value + (coalesce(b.value, a.value) - a.value) * (i * n / 500 - i * n // 500), 6) AS value
FROM g JOIN s a ON a.trace = g.trace AND a.idx = i * n // 500 LEFT JOIN s b ON b.trace = g.trace AND b.idx = i * n // 500 + 1"""
)
def resample(spark, sf_dir):
    return lookup.resampled(event_samples(spark, sf_dir), 500).withColumn("value", r("value"))


@query(f"{S} SELECT min(t) AS \"left\", max(t) AS \"right\" FROM s")
def time_range(spark, sf_dir):
    return lookup.time_range(event_samples(spark, sf_dir))


MEMBERS = "SELECT p_brand AS \"group\", CASE WHEN p_size < 20 THEN 'Time' WHEN p_brand < 'Brand#15' THEN 'Time' ELSE 'YT' END AS kind, 's' AS unit, false AS log, p_size::DOUBLE AS l, p_retailprice AS rr FROM part"


@query(
    f"""WITH m AS ({MEMBERS}), g AS (SELECT "group", bool_and(kind = 'YT') AS yt, bool_and(kind = 'Time') AS al, min(l) AS l, max(rr) AS rr FROM m GROUP BY 1)
SELECT "group", CASE WHEN yt THEN 'Stretch' WHEN al THEN 'ValueAlign' ELSE 'Incompatible' END AS mode, CASE WHEN al THEN l END AS "left", CASE WHEN al THEN rr END AS "right", CASE WHEN al THEN 's' ELSE '' END AS unit FROM g"""
)
def axis_modes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when((F.col("p_size") < 20) | (F.col("p_brand") < "Brand#15"), "Time").otherwise("YT")
    return lookup.axis_modes(p.select(F.col("p_brand").alias("group"), kind.alias("kind"), F.lit("s").alias("unit"), F.lit(False).alias("log"), F.col("p_size").cast("double").alias("left"), F.col("p_retailprice").alias("right")))


@query(
    """WITH l AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 10), a AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'CH1.' || p_name ELSE p_name END AS name FROM part),
e AS (SELECT a.name AS saved, l.name AS live FROM a JOIN l USING (name))
SELECT * FROM e UNION ALL SELECT a.name, l.name FROM a JOIN l ON regexp_replace(a.name, '^CH1\\.', '') = regexp_replace(l.name, '^CH1\\.', '') WHERE a.name NOT IN (SELECT name FROM l)"""
)
def match_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    saved = p.select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("CH1."), "p_name")).otherwise(F.col("p_name")).alias("name")).distinct()
    return lookup.match_names(saved, p.where("p_size > 10").select(F.col("p_name").alias("name")).distinct(), lambda c: scalar.strip_decoration(c, ["CH1."], []))


# Triggers

CROSSED = f"{S}, c AS (SELECT *, lag(value) OVER (PARTITION BY trace ORDER BY idx) AS p FROM s), x AS (SELECT trace, idx FROM c WHERE p < 60 AND value >= 60)"


@query(f"{CROSSED} SELECT trace, idx FROM x")
def crossings(spark, sf_dir):
    return triggers.crossings(event_samples(spark, sf_dir), 60.0).select("trace", "idx")


@query(f"{CROSSED} SELECT trace, greatest(min(idx) - 5, 0) AS start FROM x GROUP BY trace")
def trigger_start(spark, sf_dir):
    return triggers.trigger_start(event_samples(spark, sf_dir), 60.0, back=5)


@query(
    f"""{CROSSED}, n AS (SELECT trace, count(*) AS n FROM s GROUP BY trace), k AS (SELECT trace, row_number() OVER w AS slice, idx AS a, coalesce(lead(idx) OVER w, n) AS b FROM x JOIN n USING (trace) WINDOW w AS (PARTITION BY trace ORDER BY idx)),
p AS (SELECT trace, slice, a, unnest(range(a - 2, b)) AS i FROM k)
SELECT p.trace, slice::INTEGER AS slice, i - a + 2 AS place, coalesce(s.value, 0) AS value FROM p LEFT JOIN s ON s.trace = p.trace AND s.idx = p.i"""
)
def triggered_slices(spark, sf_dir):
    return triggers.triggered_slices(event_samples(spark, sf_dir), 60.0, back=2)


@query(f"{S}, c AS (SELECT *, lag(floor(value / 50)) OVER (PARTITION BY trace ORDER BY idx) AS p FROM s) SELECT trace, idx, floor(value / 50) AS value FROM c WHERE p <> floor(value / 50)")
def changed_points(spark, sf_dir):
    s = event_samples(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return triggers.changed_points(s).select("trace", "idx", "value")


# Views


@query(
    f"""{S}, g AS (SELECT trace, unnest(range(50)) AS i FROM (SELECT DISTINCT trace FROM s))
SELECT g.trace, i AS idx, coalesce(s.value, f.value) AS value FROM g LEFT JOIN s ON s.trace = g.trace AND s.idx = i - 5 JOIN s f ON f.trace = g.trace AND f.idx = 0"""
)
def view_offset(spark, sf_dir):
    return offset_and_length(event_samples(spark, sf_dir), -5, 50, "first")


@query(f"{S} SELECT trace, idx, CASE WHEN idx >= 10 AND idx < 20 THEN 0.5 ELSE value END AS value FROM s")
def set_selected(spark, sf_dir):
    return set_range(event_samples(spark, sf_dir), 10, 20, 0.5).select("trace", "idx", "value")


@query(
    f"""{S}, a AS (SELECT trace, idx, {primed("value", 8)} AS value FROM s), c AS (SELECT *, lag(value) OVER (PARTITION BY trace ORDER BY idx) AS p FROM a),
x AS (SELECT trace, min(idx) AS start FROM c WHERE p < 55 AND value >= 55 GROUP BY trace), z AS (SELECT a.trace, idx - start AS idx, value FROM a JOIN x ON a.trace = x.trace AND idx >= start AND idx - start < 400),
n AS (SELECT trace, max(idx) + 1 AS n, count(*) AS k FROM z GROUP BY trace), p AS (SELECT trace, k AS n, unnest(range(100)) AS pixel FROM n)
SELECT p.trace, pixel, round(min(value), 9) AS low, round(max(value), 9) AS high, round(avg(value), 9) AS mean FROM p JOIN z ON z.trace = p.trace AND idx >= pixel * n // 100 AND idx < greatest((pixel + 1) * n // 100, pixel * n // 100 + 1) GROUP BY 1, 2"""
)
def view_pipeline(spark, sf_dir):
    view = View(filter=lambda s: windows.moving_average(s, 8), trigger=55.0, zoom=(0, 400), width=100)
    return view(event_samples(spark, sf_dir)).select("trace", "pixel", *[r(c, 9).alias(c) for c in ("low", "high", "mean")])


# Recursive filters


def recursive_sql(first: str, step: str) -> str:
    return f"""{S.replace("WITH", "WITH RECURSIVE")}, q AS MATERIALIZED (SELECT * FROM s), f AS (SELECT trace, idx, value, {first} AS state FROM q WHERE idx = 0 UNION ALL SELECT q.trace, q.idx, q.value, {step} FROM f JOIN q ON q.trace = f.trace AND q.idx = f.idx + 1)
SELECT trace, idx, round(state, 6) AS out FROM f"""


def state(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("trace", "idx", r("out", digits).alias("out"))


@query(recursive_sql("value", "f.state + (q.value - f.state) * 0.2371"))
def rc_low_pass(spark, sf_dir):
    return state(sequential.linear_filter(event_samples(spark, sf_dir), sequential.rc(0.2371)))


@query(recursive_sql("value", "f.state + (q.value - f.state) * 0.2371").replace("round(state, 6)", "round(value - state, 6)"))
def cr_high_pass(spark, sf_dir):
    return state(sequential.linear_filter(event_samples(spark, sf_dir), sequential.cr(0.2371)))


@query(recursive_sql("value", "greatest(q.value, f.state + (q.value - f.state) * 0.2371)"))
def drc_envelope(spark, sf_dir):
    return state(sequential.drc(event_samples(spark, sf_dir), 0.2371))


@query(recursive_sql("value / 3", "(f.state * 2 + q.value) / 3"))
def rolling_average(spark, sf_dir):
    return state(sequential.linear_filter(event_samples(spark, sf_dir), sequential.rolling_average(3)))


@query(recursive_sql("value", "f.state + greatest(least(q.value - f.state, 10), -10) * 0.2371"))
def rc_slew_limited(spark, sf_dir):
    return state(sequential.sequential(event_samples(spark, sf_dir), ["value"], lambda: sequential.Rc(0.2371, 10.0)))


@query()
def iir_band_pass(spark, sf_dir):
    return state(sequential.linear_filter(event_samples(spark, sf_dir), sequential.bessel_band_pass()), 4)


def two(spark, sf_dir) -> DataFrame:
    """click with view as the wanted signal."""
    s = event_samples(spark, sf_dir)
    wanted = s.where("trace = 'view'").select("idx", F.col("value").alias("wanted"))
    return s.where("trace = 'click'").join(wanted, "idx").select("trace", "idx", "value", "wanted")


@query()
def nlms(spark, sf_dir):
    return state(sequential.sequential(two(spark, sf_dir), ["value", "wanted"], lambda: sequential.Nlms(8, 0.5)))


@query()
def rls(spark, sf_dir):
    return state(sequential.sequential(two(spark, sf_dir), ["value", "wanted"], lambda: sequential.Rls(8, 1.0, 0.02)), 4)


@query()
def echo_cancel(spark, sf_dir):
    return state(sequential.sequential(two(spark, sf_dir), ["value", "wanted"], lambda: sequential.EchoCancel(8)))


@query()
def kalman(spark, sf_dir):
    s = sequential.sequential(two(spark, sf_dir), ["value", "wanted"], lambda: sequential.Kalman([10.0, 10.0], [0.1, 0.1]), width=2)
    return s.select("trace", "idx", r(F.col("out")[0]).alias("x"), r(F.col("out")[1]).alias("y"))


@query()
def pid(spark, sf_dir):
    return state(sequential.sequential(two(spark, sf_dir), ["value", "wanted"], lambda: sequential.Pid(0.5, 0.1, 0.05, -100.0, 100.0)))


# Spectra


def vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as frames of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("trace"), F.lit(0).cast("long").alias("frame"), F.col("embedding").cast("array<double>").alias("samples"))


DFT = """WITH e AS (SELECT vec_id::VARCHAR AS trace, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
z AS (SELECT trace, k, sum(v * cos(-2 * pi() * i * k / 64)) / 64 AS re, sum(v * sin(-2 * pi() * i * k / 64)) / 64 AS im FROM e, (SELECT unnest(range(33)) AS k) GROUP BY trace, k)"""


@query(f"{DFT} SELECT trace, k::INTEGER AS bin, round(sqrt(re * re + im * im), 6) AS magnitude FROM z")
def fft_magnitude(spark, sf_dir):
    return spectral.spectrum(vectors(spark, sf_dir)).select("trace", "bin", r("magnitude").alias("magnitude"))


@query("SELECT vec_id::VARCHAR AS trace, unnest(range(64))::INTEGER AS idx, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def fft_round_trip(spark, sf_dir):
    back = spectral.to_time(spectral.spectrum(vectors(spark, sf_dir)), 64)
    return back.select("trace", F.posexplode("samples").alias("idx", "value")).withColumn("value", r("value"))


@query(f"{DFT}, b AS (SELECT trace, k, 20 * log10(sqrt(re * re + im * im)) AS db FROM z) SELECT trace, k::INTEGER AS bin, round(db, 4) AS db FROM b")
def fft_decibel(spark, sf_dir):
    z = spectral.spectrum(vectors(spark, sf_dir))
    return spectral.decibel(z, "magnitude").select("trace", "bin", r("out", 4).alias("db"))


@query(
    f"""{DFT}, t AS (SELECT z.trace, i, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * i * k / 64) - im * sin(2 * pi() * i * k / 64))) AS value FROM z, (SELECT unnest(range(64)) AS i) WHERE k BETWEEN 4 AND 12 GROUP BY z.trace, i)
SELECT trace, i::INTEGER AS idx, round(value, 6) AS value FROM t"""
)
def fft_band_pass(spark, sf_dir):
    f = spectral.filtered(vectors(spark, sf_dir), lambda n: spectral.band_pass(n, 4, 12))
    return f.select("trace", F.posexplode("samples").alias("idx", "value")).withColumn("value", r("value"))


@query()
def fft_shaped_filters(spark, sf_dir):
    shapes = {
        "band": lambda n: spectral.band_pass_3db(n, 4.0, 12.0, "RaisedCosine"), "notch": lambda n: spectral.notch_3db(n, 4.0, 12.0, "RaisedCosine"),
        "low": lambda n: spectral.low_pass(n, 0.7071, 8.0, 0.5, 10.0, "RaisedCosine"), "high": lambda n: spectral.high_pass(n, 0.5, 8.0, 0.7071, 10.0, "RaisedCosine"),
        "A": lambda n: spectral.weighting("A", spectral.np.arange(n) * 625.0), "curve": lambda n: spectral.arbitrary(n, 40000.0, [(20.0, -50.0), (1000.0, 0.0), (20000.0, -9.0)]),
    }
    parts = [spectral.filtered(vectors(spark, sf_dir), f).select(F.lit(k).alias("shape"), "trace", F.posexplode("samples").alias("idx", "value")) for k, f in shapes.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("value", r("value"))


@query()
def overlap_add(spark, sf_dir):
    s = spectral.overlap_added(event_samples(spark, sf_dir), 128, lambda n: spectral.band_pass(n, 0, 16))
    return s.select("trace", "idx", r("out").alias("out"))


@query()
def spectrogram(spark, sf_dir):
    return spectral.spectrogram(event_samples(spark, sf_dir), 64).withColumn("db", r("db"))


@query()
def spectrum_analysis(spark, sf_dir):
    a = spectral.analyse(spectral.frames(event_samples(spark, sf_dir), 128), 1000.0)
    return a.select("trace", "frame", *[r(c, 9 if c in ("dc", "peak") else 6).alias(c) for c in a.columns[2:]])


@query()
def poly_filter(spark, sf_dir):
    f = spectral.poly_filtered(spectral.frames(event_samples(spark, sf_dir), 200, short=True), 5)
    return f.select("trace", "frame", F.posexplode("samples").alias("place", "value")).withColumn("value", r("value"))


@query(
    """WITH k AS (SELECT unnest(range(64)) AS i), x AS (SELECT i, least(i, 63 - i) / 63.0::DOUBLE AS x FROM k)
SELECT i AS idx, round(0.42 - 0.5 * cos(x * pi() * 2) + 0.08 * cos(x * pi() * 4), 9) AS blackman, round(0.54 - 0.46 * cos(x * pi() * 2), 9) AS hamming, round(0.5 * (1 - cos(x * pi() * 2)), 9) AS raisedcosine,
round(pow(0.5 * (1 - cos(x * pi() * 2)), 2), 9) AS raisedcosinesquared, round(CASE WHEN x < 0.25 OR x > 0.75 THEN 0.5 * (1 - cos(x * pi() * 4)) ELSE 1 END, 9) AS frontbackquarterraisedcosine,
round(pow(10, (CASE WHEN x > 0.5 THEN 1 - x ELSE x END * 2 - 1) * 6), 9) AS log60db, CASE WHEN x >= 0 AND x < 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS rectangular FROM x"""
)
def window_shapes(spark, sf_dir):
    x = F.least(F.col("id"), 63 - F.col("id")) / 63.0
    return spark.range(64).select(F.col("id").alias("idx"), *[F.round(spectral.window_value(x, k), 9).alias(k.lower()) for k in spectral.WINDOWS])


# Generators


@query("SELECT 'tone' AS trace, i AS idx, round(2 * sin(2 * pi() * 1000 / 10000 * i), 6) AS value FROM (SELECT unnest(range(10000)) AS i)")
def tone(spark, sf_dir):
    return generators.tone(spark, 10000, 1000.0, 10000.0, 2.0).withColumn("value", r("value"))


@query("SELECT 'tone' AS trace, i AS idx, round(3 * sin(2 * pi() * 50 / 8000 * i), 6) AS value FROM (SELECT unnest(range(5000)) AS i)")
def signal_source(spark, sf_dir):
    datasource.register(spark)
    s = spark.read.format("signal").options(kind="tone", count=5000, hz=50, sps=8000, amplitude=3, run=1000).load()
    return s.withColumn("value", r("value"))


@query()
def sweep(spark, sf_dir):
    return generators.sweep(spark, 10000, 1000.0, 2000.0, 4.0, 10000.0).withColumn("value", r("value"))


@query("SELECT 'sinc' AS trace, i AS idx, round(CASE WHEN x = 0 THEN 1 ELSE sin(x) / x END, 6) AS value FROM (SELECT i, -10 + 20 * i / 200.0::DOUBLE AS x FROM (SELECT unnest(range(201)) AS i))")
def sinc(spark, sf_dir):
    return generators.sinc(spark, 201, 1.0, -10.0, 10.0).withColumn("value", r("value"))


@query(
    """WITH k AS (SELECT i, i / 1024.0::DOUBLE AS x FROM (SELECT unnest(range(1024)) AS i))
SELECT 'Square' AS trace, i AS idx, CASE WHEN x < 0.5 THEN 1.0 ELSE -1.0 END::DOUBLE AS value FROM k UNION ALL SELECT 'RisingSawtooth', i, 2 * x - 1 FROM k UNION ALL SELECT 'FallingSawtooth', i, 1 - 2 * x FROM k
UNION ALL SELECT 'Triangle', i, 1 - 4 * abs((x + 0.25::DOUBLE) % 1 - 0.5::DOUBLE) FROM k UNION ALL SELECT 'Sine', i, round(sin(x * 2 * pi()), 9) FROM k"""
)
def wave_tables(spark, sf_dir):
    out = None
    for kind in ("Square", "RisingSawtooth", "FallingSawtooth", "Triangle", "Sine"):
        w = generators.wave(spark, kind, 1024)
        w = w.withColumn("value", r("value", 9)) if kind == "Sine" else w
        out = w if out is None else out.unionByName(w)
    return out


@query("SELECT 'range' AS trace, i AS idx, 5 + i * 0.25::DOUBLE AS value FROM (SELECT unnest(range(1000)) AS i)")
def ramp(spark, sf_dir):
    return generators.ramp(spark, 5.0, 1000, 0.25)


@query()
def noise(spark, sf_dir):
    return generators.noise(spark, 1000, 1.0, 3).withColumn("value", r("value"))


# Grid


def parts(spark, sf_dir) -> Grid:
    return Grid.of(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), "p_partkey")


def shown(g: Grid) -> DataFrame:
    return g.rows().withColumnRenamed("_pos", "pos").drop("_index")


P = "WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)"
COLS = "p_partkey, p_name, p_brand, p_size, p_retailprice"


@query(f"{P}, f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM p) SELECT {COLS}, n AS \"p_brand count\", row_number() OVER (ORDER BY pos) - 1 AS pos FROM f WHERE k = 1")
def grid_unique_count(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("unique_count", "p_brand"))


@query(f"{P} SELECT {COLS}, pos // 10 AS pos FROM p WHERE pos % 10 = 0")
def grid_decimate(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("decimate", 10))


@query(f"{P} SELECT {COLS}, row_number() OVER (ORDER BY pos) - 1 AS pos FROM p WHERE regexp_matches(p_name, 'ring|BOLT', 'i') AND NOT regexp_matches(p_brand, '#1\\d', 'i')")
def grid_regex(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("show_regex", "p_name", "ring|BOLT").apply("hide_regex", "p_brand", r"#1\d"))


@query(f"{P} SELECT {COLS}, row_number() OVER (ORDER BY pos) - 1 AS pos FROM p WHERE lower(p_brand) IN ('brand#2', 'brand#17', 'brand#4') AND p_size NOT IN (1, 2, 3)")
def grid_match(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("keep_matching", "p_brand", ["Brand#2", "BRAND#17", "brand#4"]).apply("hide_matching", "p_size", [1, 2, 3]))


@query(f"{P} SELECT {COLS}, row_number() OVER (ORDER BY p_size DESC, pos DESC) - 1 AS pos FROM p")
def grid_sort_numeric(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("sort_by", "p_size", descending=True))


@query(f"{P} SELECT {COLS}, row_number() OVER (ORDER BY CAST(substr(p_brand, 7) AS INTEGER), p_size, pos) - 1 AS pos FROM p")
def grid_sort_natural(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("sort_by", "p_size").apply("sort_by", "p_brand"))


@query(f"{P} SELECT {COLS}, row_number() OVER (ORDER BY pos) - 1 AS pos FROM p WHERE pos >= 20 AND pos < 120 AND p_partkey NOT IN (30, 31)")
def grid_above_below(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("hide_above", 20).apply("hide_below", 99).apply("hide_rows", [30, 31]))


@query(f"{P} SELECT {COLS}, row_number() OVER (ORDER BY p_retailprice, pos) - 1 AS pos FROM p WHERE p_size > 0 AND regexp_matches(p_name, 'red', 'i')")
def grid_history(spark, sf_dir):
    g = parts(spark, sf_dir).apply("show_regex", "p_name", "red").apply("decimate", 3).undo().apply("sort_by", "p_retailprice").apply("hide_rows", [0]).undo().undo().redo()
    return shown(g)


@query(f"{P} SELECT p_brand, p_partkey, p_name, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second, p_size, pos FROM p")
def grid_columns(spark, sf_dir):
    split = lambda c: {"first": F.split_part(c, F.lit(" "), F.lit(1)), "second": F.split_part(c, F.lit(" "), F.lit(2))}
    g = parts(spark, sf_dir).apply("split_column", "p_name", split).apply("remove_column", "p_retailprice").apply("move_column", "p_brand", "")
    return shown(g)


@query(
    """WITH p AS (SELECT r_regionkey::VARCHAR AS a, r_name AS b, row_number() OVER (ORDER BY r_regionkey) AS k FROM region)
SELECT 'r_regionkey' AS headers, max(CASE WHEN k = 1 THEN a END) AS "row 1", max(CASE WHEN k = 2 THEN a END) AS "row 2", max(CASE WHEN k = 3 THEN a END) AS "row 3", max(CASE WHEN k = 4 THEN a END) AS "row 4", max(CASE WHEN k = 5 THEN a END) AS "row 5", 0::BIGINT AS pos FROM p
UNION ALL SELECT 'r_name', max(CASE WHEN k = 1 THEN b END), max(CASE WHEN k = 2 THEN b END), max(CASE WHEN k = 3 THEN b END), max(CASE WHEN k = 4 THEN b END), max(CASE WHEN k = 5 THEN b END), 1 FROM p"""
)
def grid_transpose(spark, sf_dir):
    g = Grid.of(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")
    return shown(g.apply("transpose"))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_regionkey + 100 AS b FROM nation UNION ALL SELECT n_regionkey + 100, n_nationkey FROM nation), k AS (SELECT 0::BIGINT AS node UNION SELECT e.b::BIGINT FROM k JOIN e ON e.a = k.node) SELECT node FROM k"""
)
def graph_reachable(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 100).cast("long").alias("b"))
    return reachable(edges, spark.range(1).select(F.col("id").alias("node")))


# Vectors


def arrays(spark, sf_dir) -> DataFrame:
    """a and b: the two halves of all components times 10."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10).alias("v"))
    n = F.floor(F.size("v") / 2).cast("int")
    return e.select("vec_id", F.slice("v", F.lit(1), n).alias("a"), F.slice("v", n + 1, n).alias("b"))


A = "WITH e AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE * 10) AS a, list_transform(embedding[33:64], lambda x: x::DOUBLE * 10) AS b FROM embeddings)"


def places(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A row for each place of arrays of one length."""
    made = df.select("vec_id", *[c.alias(k) for k, c in columns.items()])
    return made.select("vec_id", F.posexplode(F.arrays_zip(*columns)).alias("i", "z")).select("vec_id", "i", *[r(F.col(f"z.{k}").cast("double")).alias(k) for k in columns])


def places_sql(columns: dict[str, str], end: int = 33) -> str:
    cols = ", ".join(f"round(({c})::DOUBLE, 6) AS {k}" for k, c in columns.items())
    return f"{A} SELECT vec_id, (i - 1)::INTEGER AS i, {cols} FROM e, (SELECT unnest(range(1, {end})) AS i)"


@query(
    places_sql({"abs": "abs(a[i])", "ceil": "ceil(a[i])", "floor": "floor(a[i])", "trunc": "trunc(a[i])", "sqrt": "sqrt(abs(a[i]))", "neg": "-a[i]", "square": "a[i] * a[i]", "complement": "1 - a[i]", "reversed": "a[33 - i]", "rotated": "a[(i + 1) % 32 + 1]", "diff": "CASE WHEN i = 1 THEN 0 ELSE a[i] - a[i - 1] END", "wrapped": "a[i] - 2 * round(a[i] / 2)", "sorted": "list_sort(a)[i]", "quantised": "round((least(greatest(a[i], -1), 1) + 1) / 0.5) * 0.5 - 1"})
)
def vector_unary(spark, sf_dir):
    a = F.col("a")
    return places(arrays(spark, sf_dir), {
        "abs": vector.absolute(a), "ceil": vector.ceil(a), "floor": vector.floor(a), "trunc": vector.trunc(a), "sqrt": vector.sqrt(vector.absolute(a)), "neg": vector.negated(a), "square": vector.power(a, 2), "complement": vector.complement(a),
        "reversed": F.reverse(a), "rotated": vector.rotated(a, 2), "diff": vector.differentiated(a), "wrapped": vector.wrapped(a, 1.0), "sorted": F.array_sort(a), "quantised": vector.quantised(a, -1.0, 1.0, 5),
    })


@query(places_sql({"plus": "a[i] + b[i]", "minus": "a[i] - b[i]", "times": "a[i] * b[i]", "over": "a[i] / b[i]", "plus_2": "a[i] + 2", "integral": "list_sum(a[1:i])", "mean_3": "list_avg(a[greatest(i - 1, 1):least(i + 1, 32)])", "rescaled": "(a[i] - list_min(a)) / (list_max(a) - list_min(a))", "unit": "a[i] / sqrt(list_sum(list_transform(a, lambda x: x * x)))"}))
def vector_binary(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return places(arrays(spark, sf_dir), {
        "plus": vector.add(a, b), "minus": vector.subtract(a, b), "times": vector.multiply(a, b), "over": vector.divide(a, b), "plus_2": vector.add(a, 2), "integral": vector.integrated(a), "mean_3": vector.rolling(a, 3, vector.mean), "rescaled": vector.rescaled(a), "unit": vector.normalised(a),
    })


@query(
    f"""{A}, m AS (SELECT *, list_avg(a) AS mean, list_median(a) AS med, list_sum(list_transform(a, lambda x: x * x)) AS sq FROM e)
SELECT vec_id, round(list_sum(a), 6) AS sum, round(sq, 6) AS sum_square, round(list_product(a), 6) AS product, round(mean, 6) AS mean, round(med, 6) AS median, round(sqrt(sq / 32), 6) AS rms, round(sq / 32 - mean * mean, 5) AS variance,
round(list_avg(list_transform(a, lambda x: abs(x - mean))), 6) AS mad_mean, round(list_median(list_transform(a, lambda x: abs(x - med))), 6) AS mad_median, round(list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])), 6) AS dot, round(sqrt(sq), 6) AS norm FROM m"""
)
def vector_reduce(spark, sf_dir):
    e, a, b = arrays(spark, sf_dir), F.col("a"), F.col("b")
    cols = {"sum": vector.total(a), "sum_square": vector.sum_square(a), "product": vector.product(a), "mean": vector.mean(a), "median": vector.median(a), "rms": vector.rms(a), "variance": vector.variance(a), "mad_mean": vector.mad_mean(a), "mad_median": vector.mad_median(a), "dot": vector.dot(a, b), "norm": vector.magnitude(a)}
    return e.select("vec_id", *[r(c, 5 if k == "variance" else 6).alias(k) for k, c in cols.items()])


@query(
    f"""{A}, c AS (SELECT vec_id, a[1:3] AS a, b[1:3] AS b FROM e)
SELECT vec_id, round(a[2] * b[3] - a[3] * b[2], 6) AS cx, round(a[3] * b[1] - a[1] * b[3], 6) AS cy, round(a[1] * b[2] - a[2] * b[1], 6) AS cz,
round(acos((a[1] * b[1] + a[2] * b[2] + a[3] * b[3]) / (sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]) * sqrt(b[1] * b[1] + b[2] * b[2] + b[3] * b[3]))), 5) AS angle, round((a[1] * 2 + a[2]) * 2 + a[3], 6) AS polynomial FROM c"""
)
def vector_geometry(spark, sf_dir):
    e = arrays(spark, sf_dir).select("vec_id", F.slice("a", 1, 3).alias("a"), F.slice("b", 1, 3).alias("b"))
    c = vector.cross(F.col("a"), F.col("b"))
    return e.select("vec_id", r(c[0]).alias("cx"), r(c[1]).alias("cy"), r(c[2]).alias("cz"), r(vector.radians_between(F.col("a"), F.col("b")), 5).alias("angle"), r(vector.polyval(F.col("a"), F.lit(2.0))).alias("polynomial"))


@query(
    f"""{A} SELECT vec_id, round(a[1] * b[1] + a[2] * b[3], 6) AS p11, round(a[1] * b[2] + a[2] * b[4], 6) AS p12, round(a[3] * b[1] + a[4] * b[3], 6) AS p21, round(a[3] * b[2] + a[4] * b[4], 6) AS p22,
round(a[2], 6) AS t21, round(a[1] * a[4] - a[2] * a[3], 6) AS det, round(sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3] + a[4] * a[4]), 6) AS norm, round(a[1] * b[2], 6) AS outer12 FROM e"""
)
def matrix_operations(spark, sf_dir):
    m = lambda c: F.array(F.slice(c, 1, 2), F.slice(c, 3, 2))
    e = arrays(spark, sf_dir).select("vec_id", "a", "b", m("a").alias("m"), m("b").alias("n"))
    p = vector.matrix_product(F.col("m"), F.col("n"))
    cols = {"p11": p[0][0], "p12": p[0][1], "p21": p[1][0], "p22": p[1][1], "t21": vector.transposed(F.col("m"))[1][0], "det": vector.determinant_2(F.col("m")), "norm": vector.frobenius(F.col("m")), "outer12": vector.outer(F.col("a"), F.col("b"))[0][1]}
    return e.select("vec_id", *[r(c).alias(k) for k, c in cols.items()])


@query()
def matrix_inverse(spark, sf_dir):
    m = F.array(F.slice("a", 1, 2), F.slice("a", 3, 2))
    e = arrays(spark, sf_dir).select("vec_id", vector.inverted(m).alias("m"))
    return e.select("vec_id", *[r(F.col("m")[i][j], 4).alias(f"m{i}{j}") for i in (0, 1) for j in (0, 1)])


# Scalars


@query(
    """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, hex(encode(c_name)) AS h FROM customer)
SELECT c_custkey, coalesce(try_cast(substr(c_name, 10) AS DOUBLE), 0) AS number, coalesce(try_cast(c_mktsegment AS INTEGER), 0) AS nothing, regexp_matches(c_mktsegment, '^[yYtT1]') AS flag,
('0x' || right(h, 8))::BIGINT AS bytes, row_number() OVER (ORDER BY c_custkey) AS rank FROM c"""
)
def text_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = scalar.natural_key(F.concat(F.lit("n"), F.regexp_replace(F.substring("c_name", 10, 9), "^0+(?=.)", "")))
    c = placed(c.withColumn("key", key), [F.asc("key")], "place")
    return c.select("c_custkey", scalar.to_double(F.substring("c_name", 10, 9)).alias("number"), scalar.to_int(F.col("c_mktsegment")).alias("nothing"), scalar.to_bool(F.col("c_mktsegment")).alias("flag"), scalar.hex_to_uint32(F.substring(F.hex("c_name"), -8, 8)).alias("bytes"), (F.col("place") + 1).alias("rank"))


@query("SELECT c_custkey, (ascii(c_name[1]) * 16 + ascii(c_name[2]) // 16)::BIGINT AS twelve, (ascii(c_name[1]) // 16 - CASE WHEN ascii(c_name[1]) >= 128 THEN 16 ELSE 0 END)::BIGINT AS four FROM customer")
def bit_fields(spark, sf_dir):
    b = scalar.bytes_of(F.col("c_name").cast("binary"))
    c = table(spark, sf_dir, "customer").withColumn("bytes", b)
    return c.select("c_custkey", scalar.read_bits(F.col("bytes"), 0, 12).alias("twelve"), scalar.read_bits_signed(F.col("bytes"), 0, 4).alias("four"))


@query()
def checksums(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("crc32"), scalar.crc16(F.col("c_name").cast("binary")).alias("crc16"), F.size(scalar.from_base32(F.col("c_mktsegment"))).alias("base32"))


# Files


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark)
    files.write_table(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), path, "gzip")
    return files.read_table(spark, path)


@query(f"{S} SELECT idx, max(CASE WHEN trace = 'click' THEN value END) AS click, max(CASE WHEN trace = 'view' THEN value END) AS view FROM s WHERE trace IN ('click', 'view') GROUP BY idx")
def wide_columns(spark, sf_dir):
    return files.samples_to_wide(event_samples(spark, sf_dir), ["click", "view"])


@query(
    f"""{S}, w AS (SELECT idx::DOUBLE AS idx, max(CASE WHEN trace = 'click' THEN value END) AS click, max(CASE WHEN trace = 'view' THEN value END) AS view FROM s WHERE trace IN ('click', 'view') GROUP BY idx)
SELECT idx, coalesce(click, 'nan'::DOUBLE) AS click, coalesce(view, 'nan'::DOUBLE) AS view, 8::DOUBLE AS sps FROM w"""
)
def parquet_round_trip(spark, sf_dir):
    path = scratch(spark)
    files.write_numeric(event_samples(spark, sf_dir), path, {"click": {"sps": 8.0, "offset": 0.0}, "view": {"sps": 4.0, "offset": 1.0}})
    df, _ = files.read_numeric(spark, path)
    return df.withColumn("sps", F.lit(df.schema["click"].metadata["sps"]))


@query("SELECT t AS trace, p_partkey AS idx, v AS value FROM (SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS t, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part)")
def table_to_samples(spark, sf_dir):
    return files.table_to_samples(table(spark, sf_dir, "part"), "p_partkey", "^p_(size|retail)")


@query("SELECT 'a' AS trace, event_id AS idx, epoch_us(ts) / 1e6 AS t, value FROM events UNION ALL SELECT 'user', event_id, NULL, user_id::DOUBLE FROM events")
def paired_times(spark, sf_dir):
    from ..model import seconds

    e = table(spark, sf_dir, "events").select("event_id", seconds("ts").alias("a.Time"), F.col("value").alias("a.Value"), F.col("user_id").alias("user"))
    return files.pair_times(e, "event_id")


@query(
    f"""{S}, b AS (SELECT trace, idx // 4 AS idx, k, (floor(value)::BIGINT % 256 >> k) & 1 AS bit FROM s, (SELECT unnest(range(8)) AS k))
SELECT trace || ' bit ' || k AS trace, idx, sum(bit)::DOUBLE AS value FROM b GROUP BY trace, k, idx"""
)
def bit_traces(spark, sf_dir):
    s = event_samples(spark, sf_dir).withColumn("value", F.floor("value") % 256)
    return files.bit_traces(s, 4)


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def json_round_trip(spark, sf_dir):
    path = scratch(spark)
    files.write_json(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    df = spark.read.json(path, primitivesAsString=True)
    return df.select("r_regionkey", "r_name")


# Streams


def live_events(spark, sf_dir) -> DataFrame:
    e = live.read_live(spark, sf_dir, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet")
    return e.select(F.col("event_type").alias("trace"), F.col("event_id").alias("idx"), "value")


@query("SELECT event_type AS trace, event_id % 64 AS idx, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def stream_peak_hold(spark, sf_dir):
    path = scratch(spark)
    live.run_updates(live.peak_hold(live_events(spark, sf_dir).withColumn("idx", F.col("idx") % 64)), ["trace", "idx"], f"{path}/out", f"{path}/state")
    return live.latest(spark.read.parquet(f"{path}/out"), ["trace", "idx"])


@query("SELECT event_id % 64 AS idx, round(sum(value * CASE WHEN event_type = 'click' THEN 0.5 ELSE 2 END), 4) AS value, count(*) AS sources FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def stream_mix(spark, sf_dir):
    path = scratch(spark)
    live.run_updates(live.mixed(live_events(spark, sf_dir).withColumn("idx", F.col("idx") % 64), {"click": 0.5, "view": 2.0}), ["idx"], f"{path}/out", f"{path}/state")
    return live.latest(spark.read.parquet(f"{path}/out"), ["idx"]).withColumn("value", r("value", 4))


@query(
    """WITH e AS (SELECT event_type AS trace, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events)
SELECT trace, 10 - k AS place, value FROM e WHERE k <= 10"""
)
def stream_last_samples(spark, sf_dir):
    path = scratch(spark)
    live.run_updates(live.last_samples(live_events(spark, sf_dir), 10), ["trace", "place"], f"{path}/out", f"{path}/state")
    return live.latest(spark.read.parquet(f"{path}/out"), ["trace", "place"])


@query()
def stream_low_pass(spark, sf_dir):
    path = scratch(spark)
    live.run(live.recursive(live_events(spark, sf_dir), live.low_pass(0.25)), "append", f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").withColumn("out", r("out", 9))
