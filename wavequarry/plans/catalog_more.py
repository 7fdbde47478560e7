"""Further queries: annotations, updates, table edits, files, vectors and live history, each with its SQL."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, vector
from ..model import event_samples, from_arrays, from_wide, seconds, updated
from ..operators import calc, features, lookup, registry, sequential, spectral, stats
from ..sources import files
from ..streaming import live
from . import grid
from .catalog import COLS, DFT, A, P, S, arrays, live_events, parts, places, places_sql, query, r, scratch, shown, table, vectors

# Annotations


def event_features(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return features.features(e, trace=(F.col("user_id") % 4).cast("string"), type=F.col("event_type"), idx=F.col("event_id") % 997, right_idx=F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 997 + 10), t=seconds("ts"), text=F.col("props"))


FEATURES = "WITH f AS (SELECT (user_id % 4)::VARCHAR AS trace, event_type AS type, event_id % 997 AS idx, CASE WHEN event_id % 2 = 0 THEN event_id % 997 + 10 END AS right_idx, epoch_us(ts) / 1e6 AS t, props AS text FROM events)"


@query(f"{FEATURES} SELECT trace, type, idx, coalesce(right_idx, -1) AS right_idx, t, NULL::DOUBLE AS right_t, text, row_number() OVER (PARTITION BY trace ORDER BY idx, t, type, text, right_idx) - 1 AS place FROM f WHERE type <> 'view'")
def features_added(spark, sf_dir):
    f = event_features(spark, sf_dir)
    return features.add_features(f.where("type = 'click'"), f.where("type NOT IN ('click', 'view')")).fillna(-1, ["right_idx"])


@query(f"{FEATURES} SELECT trace, type, idx, coalesce(right_idx, -1) AS right_idx, t, NULL::DOUBLE AS right_t, text FROM f WHERE type IN ('click', 'error') AND regexp_matches(text, 'K.: [0-4]', 'i') AND coalesce(right_idx, idx) >= 100 AND idx < 200")
def features_filtered(spark, sf_dir):
    return features.filter_features(event_features(spark, sf_dir), ["click", "error"], "K.: [0-4]", 100, 200).fillna(-1, ["right_idx"])


# Updates and traces


@query(
    f"""{S}, k AS (SELECT trace, idx, t FROM s WHERE trace <> 'view' OR idx > 0), n AS (SELECT trace, (SELECT count(*) FROM k WHERE k.trace = s.trace) = count(*) AS timed FROM s GROUP BY trace)
SELECT trace, idx, value, CASE WHEN timed THEN t END AS t, CASE WHEN timed THEN 0.0 END::DOUBLE AS sps FROM s JOIN n USING (trace)"""
)
def trace_update(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    return updated(s, s.where("trace <> 'view' OR idx > 0"), float("nan"))


@query("SELECT vec_id::VARCHAR AS trace, unnest(range(len(embedding)))::BIGINT AS idx, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def samples_of_arrays(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("name", F.col("vec_id").cast("string"))
    return from_arrays(e, "name", "embedding").withColumn("value", r("value"))


@query("SELECT t AS trace, p_partkey AS idx, v AS value FROM (SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS t, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part)")
def samples_of_columns(spark, sf_dir):
    return from_wide(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double"), "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"])


@query("SELECT c_nationkey AS nation, c_nationkey::VARCHAR AS trace, c_nationkey % 3 <> 0 AS visible FROM customer WHERE c_acctbal > 0 AND c_nationkey % 3 <> 0 GROUP BY 1")
def traces_not_empty(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_nationkey").cast("string").alias("trace"), (F.col("n_nationkey") % 3 != 0).alias("visible"))
    return stats.drop_empty(n, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").cast("string").alias("trace"), F.col("c_acctbal").alias("value")))


@query(
    """WITH m AS (SELECT p_brand AS "group", min(p_size)::DOUBLE AS l, max(p_retailprice) AS rr FROM part GROUP BY 1)
SELECT "group", 'ValueAlign' AS mode, round(l + (rr - l) * 0.5, 6) AS "left", round(l + (rr - l) * 0.75, 6) AS "right", 's' AS unit FROM m"""
)
def shared_windows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.lit("Time").alias("kind"), F.lit("s").alias("unit"), F.lit(False).alias("log"), F.col("p_size").cast("double").alias("left"), F.col("p_retailprice").alias("right"))
    return lookup.shared_window(lookup.axis_modes(p), 0.25, 0.5).withColumn("left", r("left")).withColumn("right", r("right"))


@query("SELECT p_partkey, round(10 + p_size * 80.0 / 50, 6) AS x, round((p_retailprice - p_size) * 80 / 50, 6) AS width FROM part")
def sub_windows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("left"), F.col("p_retailprice").alias("right"), F.lit(0.0).alias("h_left"), F.lit(50.0).alias("h_right"))
    return lookup.sub_window(p, 10.0, 80.0).select("p_partkey", r("x").alias("x"), r("width").alias("width"))


@query(
    f"""{S}, n AS (SELECT trace, count(*) AS n FROM s GROUP BY trace), p AS (SELECT trace, n, unnest(range(50)) AS pixel FROM n),
x AS (SELECT p.trace, pixel, min(value) AS low, max(value) AS high FROM p JOIN s ON s.trace = p.trace AND idx >= pixel * n // 50 AND idx < greatest((pixel + 1) * n // 50, pixel * n // 50 + 1) GROUP BY 1, 2)
SELECT trace, pixel, round(avg(low) OVER w, 6) AS low, round(avg(high) OVER w, 6) AS high FROM x WINDOW w AS (PARTITION BY trace ORDER BY pixel ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def envelope(spark, sf_dir):
    return stats.smoothed_pixels(stats.pixels(event_samples(spark, sf_dir), 50), 2).select("trace", "pixel", r("low").alias("low"), r("high").alias("high"))


# Tables


@query(f"{P} SELECT p_partkey, p_name, CASE WHEN pos % 3 = 0 THEN (pos * 2)::VARCHAR END AS twice, p_brand, p_size, p_retailprice, pos FROM p")
def grid_add_column(spark, sf_dir):
    g = parts(spark, sf_dir)
    values = g.rows().where("_pos % 3 = 0").select(F.col("_pos").alias("place"), (F.col("_pos") * 2).cast("string").alias("value"))
    return shown(g.apply("add_column", "twice", values, 2))


@query(f"{P} SELECT {COLS}, pos FROM p UNION ALL SELECT {COLS}, pos + (SELECT count(*) FROM p) FROM p WHERE pos < 10")
def grid_append_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    more = grid.Grid.of(p, "p_partkey").frame.where("_pos < 10").drop("_pos")
    return shown(parts(spark, sf_dir).apply("append_rows", more))


@query(f"{P} SELECT {COLS}, row_number() OVER (ORDER BY pos) - 1 AS pos FROM p WHERE pos % 7 = 2 AND pos NOT IN (9, 16)")
def grid_hide_others(spark, sf_dir):
    g = parts(spark, sf_dir)
    return shown(g.apply("hide_others", g.frame.where("_index % 7 = 2")).apply("hide_rows", [9, 16]))


@query(f"{P} SELECT {COLS}, row_number() OVER (ORDER BY md5('5:' || pos), pos) - 1 AS pos FROM p")
def grid_shuffle(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("shuffled", 5))


@query(f"{P} SELECT {COLS}, contains(lower(p_name), 'ring') AS match, pos FROM p")
def grid_highlight(spark, sf_dir):
    return shown(parts(spark, sf_dir).apply("show_text", "p_name", "RING"))


@query(f"{P} SELECT * FROM (SELECT {COLS}, pos FROM p ORDER BY abs(p_retailprice - 1234.5), pos LIMIT 1) UNION ALL SELECT * FROM (SELECT {COLS}, pos FROM p WHERE lower(p_brand) = 'brand#2' ORDER BY pos LIMIT 1)")
def grid_nearest(spark, sf_dir):
    rows = parts(spark, sf_dir).rows()
    found = grid.nearest(rows, "p_retailprice", "1234.5").unionByName(grid.nearest(rows, "p_brand", "BRAND#2"))
    return found.withColumnRenamed("_pos", "pos").drop("_index")


@query("SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) - 1 AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def groups_ordered(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return grid.placed(g, [F.desc("n"), F.asc("p_brand")], "place")


# Files


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_brand, 'none' AS colour FROM part")
def csv_projection(spark, sf_dir):
    path = scratch(spark)
    files.write_table(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path)
    return files.columns_or(files.read_table(spark, path), {"p_partkey": "", "p_brand": "", "colour": "none"})


@query("SELECT event_id, CASE WHEN props IS NULL THEN 'null' WHEN regexp_matches(props, '[\"\\r\\n,]') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END AS cell FROM events")
def csv_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.cell_text(F.col("props")).alias("cell"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, '' AS nothing, p_name FROM part")
def csv_exact(spark, sf_dir):
    path = scratch(spark)
    files.write_table(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path)
    return files.read_table_exact(spark, path, ["p_partkey", "nothing", "p_name"]).drop("file", "row")


@query(f"{S} SELECT trace || ' ' || string_agg(value::VARCHAR, ' ' ORDER BY idx) AS value FROM s GROUP BY trace")
def matrix_text(spark, sf_dir):
    path = scratch(spark)
    files.write_matrix(event_samples(spark, sf_dir), path)
    return spark.read.text(path)


@query("SELECT DISTINCT '<' || event_type || '>' AS value FROM events")
def names_text(spark, sf_dir):
    path = scratch(spark)
    files.write_names(event_samples(spark, sf_dir), path, "<", ">")
    return spark.read.text(path)


@query("SELECT event_id::VARCHAR AS line, event_type AS type, props AS text, upper(hex(encode(event_type))) AS data FROM events WHERE event_type IN ('click', 'error') AND regexp_matches('t' || chr(10) || 'S' || chr(10) || props, 'K.: [0-4]', 'i')")
def log_round_trip(spark, sf_dir):
    path = scratch(spark)
    e, none = table(spark, sf_dir, "events"), F.lit("")
    log = e.select(seconds("ts").alias("time"), none.alias("level"), F.lit("S").alias("source"), none.alias("thread"), F.col("event_type").alias("type"), F.lit("t").alias("name"), F.col("props").alias("text"), "value", none.alias("file"), F.col("event_id").alias("line"), F.col("event_type").cast("binary").alias("data"))
    files.write_log(log, path)
    return files.filter_log(files.read_table(spark, path), ["click", "error"], "K.: [0-4]").select("line", "type", "text", "data")


@query(f"{S} SELECT s.trace, idx, value, unit FROM s JOIN (SELECT DISTINCT event_type AS trace, upper(event_type) AS unit FROM events) USING (trace)")
def state_round_trip(spark, sf_dir):
    path, s = scratch(spark), event_samples(spark, sf_dir).select("trace", "idx", "value")
    files.save_state(s, s.select("trace", F.upper("trace").alias("unit")).distinct(), path)
    samples, traces = files.load_state(spark, path)
    return samples.join(traces, "trace").select("trace", "idx", "value", "unit")


@query("SELECT 'csv' AS kind, n_name AS name, n_nationkey::VARCHAR AS key FROM nation UNION ALL SELECT 'json', n_name, n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'parquet', '', n_nationkey::DOUBLE::VARCHAR FROM nation")
def files_by_suffix(spark, sf_dir):
    path, n = scratch(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    files.write_table(n, f"{path}.csv")
    files.write_json(n, f"{path}.json")
    n.write.parquet(f"{path}.parquet")
    texts = [files.read_any(spark, f"{path}.{k}").select(F.lit(k).alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")) for k in ("csv", "json")]
    numbers = files.read_any(spark, f"{path}.parquet").select(F.lit("parquet").alias("kind"), F.lit("").alias("name"), F.col("n_nationkey").cast("string").alias("key"))
    return texts[0].unionByName(texts[1]).unionByName(numbers)


@query("SELECT trunc(event_id * 0.5::DOUBLE * 8)::BIGINT AS idx, event_id * 0.5::DOUBLE AS t, event_type AS text FROM events")
def features_of_text(spark, sf_dir):
    path = scratch(spark)
    e = table(spark, sf_dir, "events").select((F.col("event_id") * 0.5).alias("seconds"), F.col("event_type").alias("text"))
    files.write_table(e.withColumn("seconds", F.col("seconds").cast("string")).unionByName(spark.createDataFrame([("never", "x")], "seconds string, text string")), path)
    return files.read_features(spark, path, 8.0)


@query("SELECT 'p_size' AS trace, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, p_size::DOUBLE AS value FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT 'p_retailprice', row_number() OVER (ORDER BY p_partkey) - 1, p_retailprice FROM part")
def samples_without_nan(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).otherwise("none").alias("p_size"), "p_retailprice", "p_name")
    return files.table_to_samples(p, "p_partkey", "^p_(size|retail|name)", drop_nan=True)


@query(f"{S} SELECT trace, idx, round(greatest(-32768, least(32767, trunc((value / 100 - 1) * 32767))) / 32767, 9) AS value FROM s")
def wav_round_trip(spark, sf_dir):
    def there_and_back(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        rate, x = files.decode_wav(files.encode_wav(t["value"].to_numpy()[None], 8000))
        return pa.table({"trace": t["trace"], "idx": t["idx"], "value": pa.array(x[0])})

    s = event_samples(spark, sf_dir).select("trace", "idx", (F.col("value") / 100 - 1).alias("value"))
    return s.groupBy("trace").applyInArrow(there_and_back, "trace string, idx long, value double").withColumn("value", r("value", 9))


# Vectors


@query(
    places_sql(
        {
            "copied": "CASE WHEN i <= 3 THEN -1 WHEN i - 3 <= 32 THEN a[i - 3] END", "reflected": "CASE WHEN i <= 16 THEN a[i] ELSE a[33 - i] END", "half_even": "CASE WHEN a[i] * 10 - floor(a[i] * 10) = 0.5 THEN 2 * round(a[i] * 10 / 2) / 10 ELSE round(a[i], 1) END", "away": "round(a[i], 1)",
            "degrees": "a[i] * 180 / pi()", "radians": "a[i] * pi() / 180", "filled": "CASE WHEN a[i] > 0 THEN a[i] ELSE 7 END", "moved": "CASE WHEN i < 3 OR i > 6 THEN a[i] WHEN i = 6 THEN a[3] ELSE a[i + 1] END", "inverse": "1 / a[i]",
        }
    )
)
def vector_places(spark, sf_dir):
    a = F.col("a")
    return places(arrays(spark, sf_dir), {
        "copied": vector.copy(a, -3, 32, -1.0, 0.0), "reflected": vector.reflected(a), "half_even": vector.rounded(a, 1), "away": vector.rounded(a, 1, False), "degrees": vector.to_degrees(a), "radians": vector.to_radians(a),
        "filled": vector.null_to(F.transform(a, lambda x: F.when(x > 0, x)), 7.0), "moved": vector.moved(a, 2, 5), "inverse": vector.reciprocal(a),
    })


@query(f"{A} SELECT vec_id, (i - 1)::INTEGER AS i, round(CASE WHEN i <= 32 THEN a[i] ELSE b[i - 32] END, 6) AS both, round(list_sum(list_transform(range(greatest(1, i - 31), least(i, 32) + 1), lambda j: a[j] * b[i - j + 1])), 6) AS product FROM e, (SELECT unnest(range(1, 64)) AS i)")
def vector_joined(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return places(arrays(spark, sf_dir), {"both": F.slice(vector.appended(a, b), 1, 63), "product": vector.convolved(a, b)})


@query(f"{A} SELECT vec_id, true AS same, false AS other, true AS near, round(a[1] * b[2], 6) AS rows_by_columns, 5 AS taken, round(list_sum(a[6:32]), 6) AS left_sum FROM e")
def vector_checks(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    product = vector.matrix_product(vector.as_column(a), vector.as_row(b))
    d = vector.dequeued(a, 5)
    return arrays(spark, sf_dir).select("vec_id", vector.equal(a, a, 0.0).alias("same"), vector.equal(a, b, 1e-9).alias("other"), vector.equal(a, vector.add(a, 0.5), 0.6).alias("near"), r(product[0][1]).alias("rows_by_columns"), F.size(d["taken"]).alias("taken"), r(vector.total(d["left"])).alias("left_sum"))


@query(
    f"""{A}, c AS (SELECT vec_id, a[1] AS x, a[2] AS y, a[3] AS z, b[1] / sqrt(b[1] * b[1] + b[2] * b[2] + b[3] * b[3]) AS k, b[2] / sqrt(b[1] * b[1] + b[2] * b[2] + b[3] * b[3]) AS l, b[3] / sqrt(b[1] * b[1] + b[2] * b[2] + b[3] * b[3]) AS m FROM e),
d AS (SELECT *, cos(0.5) AS c, sin(0.5) AS s, (k * x + l * y + m * z) * (1 - cos(0.5)) AS p FROM c),
t AS (SELECT vec_id, x * c + (l * z - m * y) * s + k * p AS tx, y * c + (m * x - k * z) * s + l * p AS ty, z * c + (k * y - l * x) * s + m * p AS tz FROM d)
SELECT vec_id, round(tx, 6) AS ax, round(ty, 6) AS ay, round(tz, 6) AS az, round(tx, 6) AS qx, round(ty, 6) AS qy, round(tz, 6) AS qz FROM t"""
)
def vector_rotations(spark, sf_dir):
    """The same turn around an axis by angle and by quaternion."""
    e = arrays(spark, sf_dir).select("vec_id", F.slice("a", 1, 3).alias("v"), F.slice("b", 1, 3).alias("k"))
    q = F.concat(F.array(F.lit(math.cos(0.25))), vector.multiply(vector.normalised(F.col("k")), math.sin(0.25)))
    turned, by_q = vector.rotated_around(F.col("v"), F.col("k"), F.lit(0.5)), vector.quaternion_rotated(q, F.col("v"))
    return e.select("vec_id", *[r(turned[i]).alias(f"a{'xyz'[i]}") for i in range(3)], *[r(by_q[i]).alias(f"q{'xyz'[i]}") for i in range(3)])


@query(
    f"""{A}, m AS (SELECT vec_id, a[1] AS a, a[2] AS b, a[3] AS c, a[4] AS d, a[5] AS e, a[6] AS f, a[7] AS g, a[8] AS h, a[9] AS i FROM e), t AS (SELECT *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) AS det FROM m)
SELECT vec_id, round((e * i - f * h) / det, 3) AS m00, round((c * h - b * i) / det, 3) AS m01, round((c * d - a * f) / det, 3) AS m12, round((a * e - b * d) / det, 3) AS m22 FROM t WHERE abs(det) > 0.01"""
)
def matrix_inverse_3(spark, sf_dir):
    m = F.array(F.slice("a", 1, 3), F.slice("a", 4, 3), F.slice("a", 7, 3))
    e, g = arrays(spark, sf_dir).select("vec_id", m.alias("m")), lambda i, j: F.col("m")[i][j]
    det = g(0, 0) * (g(1, 1) * g(2, 2) - g(1, 2) * g(2, 1)) - g(0, 1) * (g(1, 0) * g(2, 2) - g(1, 2) * g(2, 0)) + g(0, 2) * (g(1, 0) * g(2, 1) - g(1, 1) * g(2, 0))
    inv = e.where(F.abs(det) > 0.01).select("vec_id", vector.inverted(F.col("m")).alias("m"))
    return inv.select("vec_id", *[r(g(i, j), 3).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (1, 2), (2, 2))])


# Spectra


@query(
    f"""{DFT}, t AS (SELECT z.trace, i, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * CASE WHEN k = 0 THEN re WHEN k = 32 THEN re * cos(0.7) * cos(2 * pi() * i * k / 64)
  ELSE (re * cos(0.7) - im * sin(0.7)) * cos(2 * pi() * i * k / 64) - (re * sin(0.7) + im * cos(0.7)) * sin(2 * pi() * i * k / 64) END) AS value FROM z, (SELECT unnest(range(64)) AS i) GROUP BY z.trace, i)
SELECT trace, i::INTEGER AS idx, round(value, 6) AS value FROM t"""
)
def fft_phase_shift(spark, sf_dir):
    f = spectral.phase_shifted(vectors(spark, sf_dir), 0.7)
    return f.select("trace", F.posexplode("samples").alias("idx", "value")).withColumn("value", r("value"))


def _spectral_filters_sql() -> str:
    gains = ", ".join(f"('{name}', {k}, {float(g)!r}::DOUBLE)" for name, hz in (("BandPass", (4.0, 12.0)), ("LowPass", (8.0, 10.0))) for k, g in enumerate(registry.SPECTRAL[name](33, 64, 64.0, *hz)))
    return f"""{DFT}, g AS (SELECT * FROM (VALUES {gains}) AS v(name, k, gain)),
t AS (SELECT name, z.trace, i, sum(gain * CASE WHEN z.k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * i * z.k / 64) - im * sin(2 * pi() * i * z.k / 64))) AS value FROM z JOIN g ON g.k = z.k, (SELECT unnest(range(64)) AS i) GROUP BY ALL)
SELECT name, trace, i::INTEGER AS idx, round(value, 6) AS value FROM t"""


@query(_spectral_filters_sql())
def spectral_filters_by_name(spark, sf_dir):
    rows = [registry.spectral_filtered(vectors(spark, sf_dir), n, 64, 64.0, *hz).select(F.lit(n).alias("name"), "trace", F.posexplode("samples").alias("idx", "value")) for n, hz in (("BandPass", (4.0, 12.0)), ("LowPass", (8.0, 10.0)))]
    return rows[0].unionByName(rows[1]).withColumn("value", r("value"))


@query(
    f"""{DFT}, m AS (SELECT trace, k, sqrt(re * re + im * im) AS m FROM z), n AS (SELECT *, coalesce(lag(m) OVER w, 0) AS p, coalesce(lead(m) OVER w, 0) AS q, avg(m) OVER (PARTITION BY trace) AS mean FROM m WINDOW w AS (PARTITION BY trace ORDER BY k)),
t AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY k) AS tone, CASE WHEN k > 1 THEN p ELSE 0 END AS f FROM n WHERE k > 0 AND m > p AND m >= q AND m > 1.5 * mean)
SELECT trace, tone::INTEGER AS tone, k::INTEGER AS bin, round(((k - 1) * f + k * m + (k + 1) * q) / (f + m + q) * 10, 6) AS hz, round(20 * log10(m), 6) AS db FROM t WHERE tone <= 10"""
)
def spurious_tones(spark, sf_dir):
    t = spectral.spurious_tones(spectral.spectrum(vectors(spark, sf_dir)), 10.0, 1.5)
    return t.select("trace", "tone", "bin", r("hz").alias("hz"), r("db").alias("db"))


@query("SELECT vec_id::VARCHAR AS trace, (i - 1)::INTEGER AS idx, round(embedding[i]::DOUBLE * (0.54 - 0.46 * cos(least(i - 1, 64 - i) / 63.0::DOUBLE * 2 * pi())), 6) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def windowed(spark, sf_dir):
    f = spectral.weighted(vectors(spark, sf_dir), spectral.window(64, "Hamming"))
    return f.select("trace", F.posexplode("samples").alias("idx", "value")).withColumn("value", r("value"))


@query(f"{S} SELECT trace, idx, round(value * 0.25 + coalesce(lag(value) OVER w, value) * 0.75, 6) AS out FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx)")
def registered_taps(spark, sf_dir):
    """A filter of one's own by name: two taps, centred as all named tables are."""
    registry.register("Mine", [0.75, 0.25, 0.0])
    out = registry.filtered(event_samples(spark, sf_dir), "Mine")
    return out.select("trace", "idx", r("out").alias("out"))


def _lqr() -> list[float]:
    import numpy as np

    return sequential.solve_lqr(np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[0.0], [1.0]]), np.eye(2), np.eye(1)).ravel().tolist()


@query(
    f"""{A}, k AS (SELECT {_lqr()[0]!r}::DOUBLE AS k0, {_lqr()[1]!r}::DOUBLE AS k1) SELECT vec_id, round(-(k0 * a[1] + k1 * a[2]), 6) AS control FROM e, k"""
)
def regulator(spark, sf_dir):
    """Controls of states by the gain of a linear-quadratic regulator."""
    k = F.array(*[F.lit(x) for x in _lqr()])
    return arrays(spark, sf_dir).select("vec_id", r(-vector.dot(k, F.slice("a", 1, 2))).alias("control"))


@query(
    f"""{DFT}, p AS (SELECT trace, k, sqrt(re * re + im * im) AS m, atan2(im, re) AS a FROM z), j AS (SELECT *, a - lag(a) OVER (PARTITION BY trace ORDER BY k) AS d FROM p),
u AS (SELECT trace, k, m, a + sum(CASE WHEN d > pi() THEN -2 * pi() WHEN d < -pi() THEN 2 * pi() ELSE 0.0 END) OVER (PARTITION BY trace ORDER BY k) AS a FROM j),
s AS (SELECT trace, k, 0.25 * coalesce(lag(m) OVER w, m) + 0.5 * m + 0.25 * coalesce(lead(m) OVER w, m) AS m, 0.25 * coalesce(lag(a) OVER w, a) + 0.5 * a + 0.25 * coalesce(lead(a) OVER w, a) AS a FROM u WINDOW w AS (PARTITION BY trace ORDER BY k)),
t AS (SELECT trace, i, sum(CASE WHEN k IN (0, 32) THEN m * cos(a) * cos(2 * pi() * i * k / 64) ELSE 2 * m * cos(a + 2 * pi() * i * k / 64) END) AS value FROM s, (SELECT unnest(range(64)) AS i) GROUP BY trace, i)
SELECT trace, i::INTEGER AS idx, round(value, 6) AS value FROM t"""
)
def fft_smoothed(spark, sf_dir):
    f = spectral.smoothed(vectors(spark, sf_dir), [0.25, 0.5, 0.25])
    return f.select("trace", F.posexplode("samples").alias("idx", "value")).withColumn("value", r("value"))


@query(f"{S} SELECT a.idx AS idx, a.value AS x, b.value AS y, c.value AS z FROM s a JOIN s b ON a.idx = b.idx AND a.trace = 'click' AND b.trace = 'view' JOIN s c ON c.idx = a.idx AND c.trace = 'error'")
def xyz_points(spark, sf_dir):
    return calc.xyz(event_samples(spark, sf_dir), "click", "view", "error")


@query(f"{A}, x AS (SELECT vec_id, unnest(a) AS y, unnest(range(32))::DOUBLE AS x FROM e) SELECT vec_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM x GROUP BY vec_id")
def vector_fit(spark, sf_dir):
    return arrays(spark, sf_dir).select("vec_id", vector.polyfit(F.col("a"), 1).alias("c")).select("vec_id", r(F.col("c")[0]).alias("slope"), r(F.col("c")[1]).alias("intercept"))


@query("SELECT c_custkey, (c_custkey % 4096)::BIGINT AS back, (ascii(c_name[1]) // 16 * 16 + (c_custkey % 4096) // 256)::INTEGER AS first FROM customer")
def bits_written(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("b", scalar.write_bits(scalar.bytes_of(F.col("c_name").cast("binary")), 4, 12, F.col("c_custkey") % 4096))
    return c.select("c_custkey", scalar.read_bits(F.col("b"), 4, 12).alias("back"), F.col("b")[0].alias("first"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def xml_round_trip(spark, sf_dir):
    text = table(spark, sf_dir, "nation").select(F.to_xml(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("x"))
    return text.select(F.from_xml("x", "key int, name string").alias("v")).select("v.*")


@query(
    """SELECT l_orderkey, l_linenumber, round(l_tax + (l_discount - l_tax) * (l_quantity - 1) / 49, 9) AS linear,
round((10 + 20 * (l_quantity - 1) / 49) + ((30 - 15 * (l_quantity - 1) / 49) - (10 + 20 * (l_quantity - 1) / 49)) * l_discount / 0.1, 6) AS bilinear FROM lineitem"""
)
def interpolated(spark, sf_dir):
    li, f = table(spark, sf_dir, "lineitem"), lambda x: F.lit(float(x))
    x, y = F.col("l_quantity"), F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", r(scalar.linear(x, f(1), f(50), F.col("l_tax"), y), 9).alias("linear"), r(scalar.bilinear(x, y, f(1), f(50), f(0), f(0.1), f(10), f(30), f(30), f(15))).alias("bilinear"))


# Live history


def last(underflow: str, length: int):
    def run(spark, sf_dir):
        path = scratch(spark)
        live.run_updates(live.last_samples(live_events(spark, sf_dir).withColumn("trace", F.concat("trace", (F.col("idx") % 400).cast("string"))), length, underflow), ["trace", "place"], f"{path}/out", f"{path}/state")
        return live.latest(spark.read.parquet(f"{path}/out"), ["trace", "place"])

    return run


LAST = "WITH e AS (SELECT event_type || (event_id % 400) AS trace, value, row_number() OVER (PARTITION BY event_type || (event_id % 400) ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY event_type || (event_id % 400)) AS n FROM events)"
for _mode, _sql in (
    ("zeros", f"{LAST}, g AS (SELECT trace, k FROM (SELECT DISTINCT trace FROM e), (SELECT unnest(range(1, 7)) AS k)) SELECT g.trace, 6 - g.k AS place, coalesce(value, 0) AS value FROM g LEFT JOIN e ON e.trace = g.trace AND e.k = g.k"),
    ("available", f"{LAST} SELECT trace, least(n, 6) - k AS place, value FROM e WHERE k <= 6"),
    ("null", f"{LAST} SELECT trace, 6 - k AS place, value FROM e WHERE k <= 6 AND n >= 6"),
):
    _run = last(_mode.capitalize(), 6)
    _run.__name__ = f"stream_underflow_{_mode}"
    query(_sql)(_run)


@query(
    """WITH e AS (SELECT event_type AS trace, epoch_us(ts) / 1e6 AS t, value, max(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type) AS top FROM events)
SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY t, value) - 1 AS place, t, value FROM e WHERE t >= top - 86400"""
)
def stream_recent(spark, sf_dir):
    path = scratch(spark)
    e = live.read_live(spark, sf_dir, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet")
    s = e.select(F.col("event_type").alias("trace"), seconds("ts").alias("t"), "value")
    live.run_updates(live.recent(s, 86400.0), ["trace", "place"], f"{path}/out", f"{path}/state")
    return live.latest(spark.read.parquet(f"{path}/out"), ["trace", "place"])
