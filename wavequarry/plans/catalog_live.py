"""Queries of live sources, filter graphs and filters in overlapping frames on streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import event_samples, framed
from ..operators import sequential, spectral
from ..sources import livesource, rawsource
from ..streaming import graph, live
from .catalog import S, live_events, query, r, scratch
from .catalog_sql import OVERLAP

#: Samples of each trace in the order of the events' ids, as the stream has them.
BY_ID = "SELECT event_type AS trace, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events"


@query(f"SELECT o.trace, o.idx, o.out FROM ({OVERLAP.replace(S, f'WITH s AS ({BY_ID})')}) o JOIN (SELECT event_type AS trace, count(*) AS n FROM events GROUP BY 1) n USING (trace) WHERE o.idx < (n // 64 - 1) * 64")
def stream_overlap_add(spark, sf_dir):
    """Overlap-add on a stream: all samples whose two frames are full."""
    path = scratch(spark)
    live.run(graph.overlap_added(live_events(spark, sf_dir), 128, lambda n: spectral.band_pass(n, 0, 16)), "append", f"{path}/out", f"{path}/state")
    rows = spark.read.parquet(f"{path}/out").select("trace", "frame", F.posexplode("samples").alias("place", "v"))
    return rows.select("trace", (F.col("frame") * 64 + F.col("place")).alias("idx"), r("v").alias("out"))


DIAMOND = """WITH e AS (SELECT user_id % 16 AS channel, event_type AS trace, value, row_number() OVER (PARTITION BY user_id % 16, event_type ORDER BY event_id) - 1 AS idx FROM events),
a AS (SELECT channel, idx, value AS x, coalesce(lag(value, 3) OVER w, 0) AS late, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS x2, coalesce(lag(value, 1) OVER w, first_value(value) OVER w) AS x1 FROM e WHERE trace = 'click' WINDOW w AS (PARTITION BY channel ORDER BY idx)),
m AS (SELECT a.channel, a.idx, 0.5 * late + 2 * (0.25 * x2 + 0.5 * x1 + 0.25 * x) - b.value AS y, count(*) OVER (PARTITION BY a.channel) AS n FROM a JOIN e b ON b.channel = a.channel AND b.idx = a.idx AND b.trace = 'view'),
p AS (SELECT channel, 'each' AS reader, idx AS frame, 0 AS place, y FROM m UNION ALL SELECT channel, 'frames', f, idx - f * 4, y FROM (SELECT *, unnest(range(greatest((idx - 7 + 3) // 4, 0), idx // 4 + 1)) AS f FROM m) WHERE f * 4 + 8 <= n AND idx >= f * 4 AND idx < f * 4 + 8
  UNION ALL SELECT a.channel, 'sparse', a.idx // 5, 0, late FROM a WHERE idx % 5 = 0)
SELECT channel::VARCHAR AS channel, reader, frame, place::INTEGER AS place, round(y, 6) + 0.0 AS value FROM p"""


@query(DIAMOND)
def filter_graph(spark, sf_dir):
    """A diamond: one source by two ways into a mixer with a second source; three readers at their own strides. Sixteen channels, dealt by user."""
    g = graph.Graph().source("x", "click").source("y", "view").delay("late", "x", 3).fir("smooth", "x", [0.25, 0.5, 0.25]).mix("out", {"late": 0.5, "smooth": 2.0, "y": -1.0})
    g.reader("each", "out").reader("frames", "out", 8, 4).reader("sparse", "late", 1, 5)
    events = live.read_live(spark, sf_dir, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet")
    heard = events.select((F.col("user_id") % 16).alias("channel"), F.col("event_type").alias("trace"), F.col("event_id").alias("idx"), "value")
    path = scratch(spark)
    live.run(graph.compiled(heard, g), "append", f"{path}/out", f"{path}/state")
    rows = spark.read.parquet(f"{path}/out").select("channel", "reader", "frame", F.posexplode("samples").alias("place", "v"))
    return rows.select("channel", "reader", "frame", "place", (r("v") + F.lit(0.0)).alias("value"))


@query("SELECT event_id, event_type, value FROM events")
def live_source(spark, sf_dir):
    """The events' rows, released at a rate: a first run reads those that are there, a second goes on from there."""
    livesource.register(spark)
    path = scratch(spark)
    options = {"kind": "table", "path": f"{sf_dir}/events.parquet", "sps": "1e6", "run": "2000"}
    for more in ({"count": "3000"}, {}):
        rows = spark.readStream.format("live").schema("event_id bigint, event_type string, value double").options(**options, **more).load()
        live.run(rows, "append", f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@query(f"{S} SELECT trace, idx, value FROM s")
def raw_files(spark, sf_dir):
    """All samples as raw files and back by byte ranges."""
    path = scratch(spark)
    rawsource.write_samples(event_samples(spark, sf_dir), path)
    return rawsource.read_samples(spark, path, frames=1000).drop("sps")


@query(f"{S} SELECT trace || ' bit ' || k AS trace, idx, ((floor(value)::BIGINT % 256 >> k) & 1)::DOUBLE AS value FROM s, (SELECT unnest(range(8)) AS k)")
def bit_files(spark, sf_dir):
    """Samples as bytes in files, read as eight traces of bits."""
    path = scratch(spark)
    rawsource.write_samples(event_samples(spark, sf_dir).withColumn("value", F.floor("value") % 256), path, "u8")
    return rawsource.read_samples(spark, path, "bits", frames=700).drop("sps")


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS trace, ts, value, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS anew FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
g AS (SELECT *, sum(anew) OVER (PARTITION BY trace ORDER BY ts, value) AS life FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY trace, life ORDER BY ts DESC, value DESC) AS back, max(life) OVER (PARTITION BY trace) AS newest, max(ts) OVER (PARTITION BY trace, life) AS latest, max(ts) OVER () AS now FROM g)
SELECT trace, row_number() OVER (PARTITION BY trace, life ORDER BY back DESC) - 1 AS place, ts, value FROM b WHERE back <= 4 AND (life < newest OR date_trunc('millisecond', latest) + INTERVAL 6 HOUR <= date_trunc('millisecond', now))"""
)
def stream_expiring(spark, sf_dir):
    """The last four samples of each time a user was there, until idle for six hours."""
    events = live.read_live(spark, sf_dir, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet")
    path = scratch(spark)
    live.run_updates(live.expiring(events.select(F.col("user_id").cast("string").alias("trace"), "ts", "value"), 4, 6 * 3600), ["trace"], f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").where("over").select("trace", "place", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query(
    f"""{S}, x AS (SELECT trace, idx, value AS y, lag(value) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx)),
b AS (SELECT trace, idx // 256 AS block, count(*) AS n, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x1) AS c, sum(x2 * x2) AS d, sum(x2) AS e, sum(x1 * y) AS p, sum(x2 * y) AS q, sum(y) AS r FROM x WHERE x2 IS NOT NULL GROUP BY trace, idx // 256),
u AS (SELECT trace, block, sum(n) OVER o AS n, sum(a) OVER o AS a, sum(b) OVER o AS b, sum(c) OVER o AS c, sum(d) OVER o AS d, sum(e) OVER o AS e, sum(p) OVER o AS p, sum(q) OVER o AS q, sum(r) OVER o AS r FROM b WINDOW o AS (PARTITION BY trace ORDER BY block)),
t AS (SELECT *, a * (d * n - e * e) - b * (b * n - e * c) + c * (b * e - d * c) AS det FROM u)
SELECT trace, block, n::BIGINT AS n, round((p * (d * n - e * e) - b * (q * n - e * r) + c * (q * e - d * r)) / det, 6) AS w1, round((a * (q * n - e * r) - p * (b * n - e * c) + c * (b * r - q * c)) / det, 6) AS w2, round((a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det, 6) AS w0 FROM t"""
)
def online_fit(spark, sf_dir):
    """Each sample from the two before it: the weights after every 256 samples."""
    near = framed(event_samples(spark, sf_dir), 2, 0, {"held": lambda w: F.collect_list("value").over(w)})
    rows = near.where(F.size("held") == 3).select("trace", "idx", "value", F.col("held")[1].alias("x1"), F.col("held")[0].alias("x2"), F.lit(1.0).alias("one"))
    fit = sequential.online_fit(rows, ["x1", "x2", "one"], "value", 256)
    return fit.select("trace", "block", "n", *[r(F.col("weights")[i]).alias(c) for i, c in enumerate(("w1", "w2", "w0"))])
