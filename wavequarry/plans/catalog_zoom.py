"""Queries over whole traces: transforms, summaries of many ranges, views at any zoom, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import event_samples
from ..operators import pyramid, spectral, transform
from .catalog import ORACLE_SQL, S, query, r, table
from .catalog_sql import weighting_sql
from .grid import connected, connected_to

#: Whole transforms by their definition; places are reduced in whole numbers before they become angles.
WHOLE = f"""{S}, n AS (SELECT trace, count(*) AS n FROM s GROUP BY trace), b AS (SELECT trace, n, unnest(range(n // 2 + 1)) AS bin FROM n),
z AS (SELECT b.trace, bin, any_value(n) AS n, sum(value * cos(2 * pi() * ((bin * idx) % n) / n)) / any_value(n) AS re, -sum(value * sin(2 * pi() * ((bin * idx) % n) / n)) / any_value(n) AS im FROM b JOIN s ON s.trace = b.trace GROUP BY b.trace, bin)"""


def up(c: str, digits: int = 6):
    """Rounded with halves up, also where a sum in another order falls short of a half by its last bits."""
    return F.round(F.col(c) + F.lit(1e-9), digits)


def settled(c: str, digits: int = 6):
    """Rounded, and 0 without a sign."""
    return r(c, digits) + F.lit(0.0)


@query(f"{WHOLE} SELECT trace, bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(sqrt(re * re + im * im), 6) AS magnitude FROM z")
def whole_spectrum(spark, sf_dir):
    z = transform.whole_spectrum(event_samples(spark, sf_dir))
    return z.select("trace", "bin", *[settled(c).alias(c) for c in ("re", "im", "magnitude")])


def _gain(bin_, n):
    """1 up to an eighth of the rate, then falling, 0 above a quarter."""
    at = bin_ / n
    return F.when(at <= 0.125, 1.0).when(at <= 0.25, 1.0 - (at - 0.125) * 8).otherwise(0.0)


@query(
    f"""{WHOLE}, g AS (SELECT trace, n, bin, re * g AS re, im * g AS im FROM (SELECT *, CASE WHEN bin / n <= 0.125 THEN 1.0 WHEN bin / n <= 0.25 THEN 1.0 - (bin / n - 0.125) * 8 ELSE 0.0 END::DOUBLE AS g FROM z) WHERE g > 0)
SELECT s.trace, s.idx, round(sum(CASE WHEN bin = 0 THEN re ELSE 2 * (re * cos(2 * pi() * ((bin * idx) % n) / n) - im * sin(2 * pi() * ((bin * idx) % n) / n)) END), 6) + 0.0 AS out FROM s JOIN g ON g.trace = s.trace GROUP BY s.trace, s.idx"""
)
def whole_filtered(spark, sf_dir):
    return transform.whole_filtered(event_samples(spark, sf_dir), _gain).withColumn("out", settled("out"))


def _named(spark, sf_dir) -> DataFrame:
    """trace, k, n: the traces by name, from 0, with their lengths."""
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("trace")).agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.orderBy("trace")) - 1)


NAMED = f"{S}, m AS (SELECT trace, n, row_number() OVER (ORDER BY trace) - 1 AS k FROM (SELECT trace, count(*) AS n FROM s GROUP BY trace))"


@query(
    f"""{NAMED}, o AS (SELECT c_custkey, trace, (c_custkey * 37) % n AS lo, (c_custkey * 37) % n + 1 + (c_custkey * 101 + c_nationkey) % n AS hi FROM customer JOIN m ON c_custkey % (SELECT count(*) FROM m) = k)
SELECT c_custkey, count(*) AS n, min(value) AS low, max(value) AS high, round(sum(value), 4) AS total, round(avg(value) + 1e-9, 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms, round(CASE WHEN var_pop(value) > 1e-9 THEN stddev_pop(value) ELSE 0 END, 5) AS std
FROM o JOIN s ON s.trace = o.trace AND idx >= lo AND idx < hi GROUP BY c_custkey"""
)
def range_stats(spark, sf_dir):
    """Statistics of a range of a trace for each customer, from summaries."""
    named = _named(spark, sf_dir)
    k = F.col("c_custkey") % F.lit(named.count())
    c = table(spark, sf_dir, "customer").withColumn("k", k).join(F.broadcast(named), "k")
    lo = (F.col("c_custkey") * 37) % F.col("n")
    ranges = c.select("c_custkey", "trace", lo.alias("lo"), (lo + 1 + (F.col("c_custkey") * 101 + F.col("c_nationkey")) % F.col("n")).alias("hi"))
    got = pyramid.range_stats(pyramid.pyramid(event_samples(spark, sf_dir)), ranges, ["c_custkey"])
    return got.select("c_custkey", "n", "low", "high", r("total", 4).alias("total"), up("mean").alias("mean"), r("rms").alias("rms"), r("std", 5).alias("std"))


def _views(spark, sf_dir) -> DataFrame:
    """The whole of each trace, its middle half and 40 samples of it."""
    n = F.col("n")
    lo, hi = F.array(F.lit(0), F.floor(n / 4), F.floor(n / 3)), F.array(n, F.floor(n / 4) + F.floor(n / 2), F.floor(n / 3) + F.least(n - F.floor(n / 3), F.lit(40)))
    each = _named(spark, sf_dir).select("trace", F.posexplode(F.arrays_zip(lo.alias("lo"), hi.alias("hi"))).alias("view", "v"))
    return each.select("view", "trace", F.col("v.lo").alias("lo"), F.col("v.hi").alias("hi"))


VIEWS = f"{NAMED}, v AS (SELECT trace, 0 AS view, 0 AS lo, n AS hi FROM m UNION ALL SELECT trace, 1, n // 4, n // 4 + n // 2 FROM m UNION ALL SELECT trace, 2, n // 3, n // 3 + least(n - n // 3, 40) FROM m)"


@query(
    f"""{VIEWS}, p AS (SELECT *, lo + (pixel * (hi - lo)) // 300 AS a, greatest(lo + ((pixel + 1) * (hi - lo)) // 300, lo + (pixel * (hi - lo)) // 300 + 1) AS b FROM (SELECT *, unnest(range(300)) AS pixel FROM v))
SELECT p.trace, view, pixel, min(value) AS low, max(value) AS high, round(avg(value) + 1e-9, 6) AS mean FROM p JOIN s ON s.trace = p.trace AND idx >= a AND idx < b GROUP BY p.trace, view, pixel"""
)
def zoomed(spark, sf_dir):
    """Views of each trace at three zooms."""
    return pyramid.zoomed(pyramid.pyramid(event_samples(spark, sf_dir)), _views(spark, sf_dir), 300).withColumn("mean", up("mean"))


@query(
    f"""{VIEWS}, p AS (SELECT trace, view, lo, hi, pixel, pixel * (hi - lo) // 4000 AS a, pixel * (hi - lo) % 4000 / 4000 AS rest FROM (SELECT *, unnest(range(4000)) AS pixel FROM v)),
f AS (SELECT *, lag(a) OVER (PARTITION BY trace, view ORDER BY pixel) AS before FROM p)
SELECT f.trace, view, pixel, round(x.value, 6) AS nearest, round(CASE WHEN before IS DISTINCT FROM a THEN x.value ELSE x.value * (1 - rest) + y.value * rest END + 1e-9, 6) AS linear
FROM f JOIN s x ON x.trace = f.trace AND x.idx = lo + a JOIN s y ON y.trace = f.trace AND y.idx = least(lo + a + 1, hi - 1)"""
)
def upsampled(spark, sf_dir):
    """The samples under more pixels than there are."""
    u = pyramid.upsampled(event_samples(spark, sf_dir), _views(spark, sf_dir), 4000)
    return u.select("trace", "view", "pixel", r("nearest").alias("nearest"), up("linear").alias("linear"))


# Averages of spectra

#: Magnitudes m of bins k of frames of 128 samples, windowed and without their mean, averaged over the last four frames. 1000 Hz: a bin is 7.8125.
AVERAGED = f"""{S}, f AS (SELECT trace, idx // 128 AS frame, idx % 128 AS i, value * 0.5 * (1 - cos(2 * pi() * least(idx % 128, 127 - idx % 128) / 127)) AS v, count(*) OVER (PARTITION BY trace, idx // 128) AS n FROM s),
w AS (SELECT trace, frame, i, v - avg(v) OVER (PARTITION BY trace, frame) AS v FROM f WHERE n = 128),
z AS (SELECT trace, frame, k, sqrt(power(sum(v * cos(2 * pi() * ((i * k) % 128) / 128)), 2) + power(sum(v * sin(2 * pi() * ((i * k) % 128) / 128)), 2)) / 128 AS m FROM w, (SELECT unnest(range(65)) AS k) GROUP BY trace, frame, k),
a AS (SELECT trace, frame, k, avg(m) OVER (PARTITION BY trace, k ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM z)"""


#: From magnitudes a (trace, frame, k, m): the strongest tone, its harmonics, and the rest.
STEPS = """t AS (SELECT trace, frame, arg_max(k, m) AS top FROM a WHERE k > 0 GROUP BY trace, frame),
c AS (SELECT trace, frame, any_value(top) AS top, sum(k * m) * 7.8125 / sum(m) AS hz, max(CASE WHEN k = top THEN m * m END) AS power FROM a JOIN t USING (trace, frame) WHERE k BETWEEN greatest(1, top - 2) AND least(64, top + 2) GROUP BY trace, frame),
h AS (SELECT trace, frame, floor(hz * unnest(range(2, 11)) / 7.8125 + 0.4999)::BIGINT AS k FROM c),
g AS (SELECT h.trace, h.frame, sum(m * m) AS harmonic FROM h JOIN a ON a.trace = h.trace AND a.frame = h.frame AND a.k = h.k GROUP BY h.trace, h.frame),
o AS (SELECT a.* FROM a JOIN c USING (trace, frame) WHERE k <> top AND NOT EXISTS (SELECT 1 FROM h WHERE h.trace = a.trace AND h.frame = a.frame AND h.k = a.k)),
q AS (SELECT trace, frame, sum(CASE WHEN k > 0 THEN m * m END) AS noise, max(m) * max(m) AS spur, avg(m * m) AS floor_power FROM o GROUP BY trace, frame)
"""
TONE = """round(hz, 6) AS fundamental_hz, round(10 * log10(coalesce(harmonic, 0) / power), 6) AS thd_db, round(10 * log10((coalesce(harmonic, 0) + noise) / power), 6) AS thd_n_db, round(10 * log10(power / noise), 6) AS snr_db, round(10 * log10(power / (noise + coalesce(harmonic, 0))), 6) AS sinad_db,
round((10 * log10(power / (noise + coalesce(harmonic, 0))) - 1.76) / 6.02, 6) AS enob, round(10 * log10(power / spur), 6) AS sfdr_db, round(10 * log10(floor_power), 6) AS noise_floor_db"""


@query(f"{AVERAGED}, {STEPS} SELECT trace, frame, {TONE} FROM c JOIN q USING (trace, frame) LEFT JOIN g USING (trace, frame) WHERE harmonic > 0")
def averaged_analysis(spark, sf_dir):
    """Figures of spectra averaged over four frames, for frames whose tone has a harmonic below half the rate."""
    f = spectral.frames(event_samples(spark, sf_dir), 128)
    a = spectral.analyse_averaged(f, 1000.0, 4).where(F.col("thd_db") > float("-inf"))
    return a.select("trace", "frame", *[r(c).alias(c) for c in spectral.FIGURES])


ORACLE_SQL["spectrum_analysis"] = f"""{AVERAGED[: AVERAGED.index('a AS (SELECT')]}a AS (SELECT trace, frame, k, m FROM z), {STEPS},
x AS (SELECT trace, idx // 128 AS frame, idx % 128 AS i, value, avg(value) OVER y AS dc, count(*) OVER y AS n FROM s WINDOW y AS (PARTITION BY trace, idx // 128)),
e AS (SELECT trace, frame, any_value(dc) AS dc, max(abs(value - dc)) AS peak, sqrt(avg((value - dc) * (value - dc))) AS rms FROM x WHERE n = 128 GROUP BY trace, frame),
y AS (SELECT trace, frame, k, k * 7.8125 AS hz, (power(sum(value * cos(2 * pi() * ((i * k) % 128) / 128)), 2) + power(sum(value * sin(2 * pi() * ((i * k) % 128) / 128)), 2)) / 16384 * CASE WHEN k = 64 THEN 1 ELSE 2 END AS power FROM x, (SELECT unnest(range(1, 65)) AS k) WHERE n = 128 GROUP BY trace, frame, k),
v AS (SELECT trace, frame, sqrt(sum(power * power(({weighting_sql("A", "hz")}), 2))) AS rms_a, sqrt(sum(power * power(({weighting_sql("C", "hz")}), 2))) AS rms_c FROM y GROUP BY trace, frame)
SELECT trace, frame, round(dc, 9) AS dc, round(peak, 9) AS peak, round(rms, 6) AS rms, round(20 * log10(rms), 6) AS dbfs, round(20 * log10(rms_a), 6) AS dbfs_a, round(20 * log10(rms_c), 6) AS dbfs_c, round(peak / rms, 6) AS crest,
{TONE.replace("round(10 * log10(coalesce(harmonic, 0) / power), 6) AS thd_db", "CASE WHEN harmonic > 0 THEN round(10 * log10(harmonic / power), 6) ELSE '-inf'::DOUBLE END AS thd_db")} FROM e JOIN v USING (trace, frame) JOIN c USING (trace, frame) JOIN q USING (trace, frame) LEFT JOIN g USING (trace, frame)"""


@query(
    f"""{AVERAGED}, d AS (SELECT *, greatest(-120.0, 20 * log10(greatest(m, 1e-300))) AS d FROM a), l AS (SELECT *, max(d) OVER (PARTITION BY trace, frame ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM d),
b AS (SELECT *, CASE WHEN l > avg(l) OVER (PARTITION BY trace, frame ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) + 3 THEN 1.0 ELSE 0.0 END AS u FROM l),
p AS (SELECT *, avg(u) OVER (PARTITION BY trace, frame ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 0.5 AS up FROM b), n AS (SELECT *, k - row_number() OVER (PARTITION BY trace, frame ORDER BY k) AS block FROM p WHERE up),
t AS (SELECT trace, frame, block, arg_max(k, m) AS top FROM n GROUP BY trace, frame, block),
c AS (SELECT t.trace, t.frame, top, sum(k * m) * 7.8125 / sum(m) AS hz FROM t JOIN a ON a.trace = t.trace AND a.frame = t.frame AND k BETWEEN greatest(1, top - 1) AND least(64, top + 1) GROUP BY t.trace, t.frame, top),
r AS (SELECT *, row_number() OVER (PARTITION BY trace, frame ORDER BY top) AS tone FROM c WHERE hz > 0)
SELECT r.trace, r.frame, tone::INTEGER AS tone, round(hz, 6) AS hz, round(20 * log10(m), 6) AS db FROM r JOIN a ON a.trace = r.trace AND a.frame = r.frame AND a.k = floor(hz / 7.8125 + 0.5)::BIGINT WHERE tone <= 10"""
)
def baseline_tones(spark, sf_dir):
    """Tones of averaged spectra over a running baseline."""
    m = spectral.averaged(spectral.frames(event_samples(spark, sf_dir), 128), 4)
    t = spectral.tones_over_baseline(m, 1000.0)
    return t.select("trace", "frame", "tone", r("hz").alias("hz"), r("db").alias("db"))


# Connected sets

#: Parts and suppliers of large single-line items, as a graph.
EDGES = "e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem WHERE l_linenumber = 7 AND l_quantity >= 48)"
LABELS = f"WITH RECURSIVE {EDGES}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), k AS (SELECT a AS node, a AS label FROM u UNION SELECT u.b, k.label FROM k JOIN u ON u.a = k.node), c AS (SELECT node, min(label) AS component FROM k GROUP BY node)"


def _edges(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_linenumber = 7 AND l_quantity >= 48")
    return items.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"))


@query(f"{LABELS} SELECT node, component FROM c")
def graph_components(spark, sf_dir):
    return connected(_edges(spark, sf_dir))


@query(f"{LABELS} SELECT node FROM c WHERE component IN (SELECT component FROM c WHERE node % 5 = 0 AND node < 1000000000)")
def graph_connected_to(spark, sf_dir):
    """All that is connected, over any way, with every fifth part."""
    edges = _edges(spark, sf_dir)
    return connected_to(edges, edges.where("a % 5 = 0").select(F.col("a").alias("node")).distinct())
