"""Operators that SQL can't check, or at their edges."""

import json
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavequarry.functions import scalar, vector
from wavequarry.operators import features, lookup, sequential, spectral, windows
from wavequarry.plans import grid
from wavequarry.sources import files, generators


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<double>")


def hashed(seed, *parts):
    """Spark's xxhash64 of a whole number of 32 bits, then of texts and whole numbers of 64."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def test_noise_is_its_hash(spark):
    got = [r["value"] for r in generators.noise(spark, 50, 3.0, 11).orderBy("idx").collect()]
    assert got == [3.0 * (2 * ((hashed(11, i) % (1 << 53)) / float(1 << 53)) - 1) for i in range(50)]
    assert -3 <= min(got) < -1 and 1 < max(got) < 3


def test_noise_added_by_trace_and_place(spark):
    s = spark.createDataFrame([("a", i, float(i)) for i in range(30)] + [("b", 0, 5.0)], "trace string, idx long, value double")
    for r in windows.noise_added(s, 0.25, 7).collect():
        u = (hashed(7, r["trace"], r["idx"]) % (1 << 53)) / float(1 << 53)
        assert r["out"] == r["value"] * 0.75 + (2 * u - 1) * 0.25


def test_analysis_of_a_known_signal(spark):
    """A tone with one harmonic and a spur, all at the centres of bins: figures by definition."""
    n, sps = 256, 1024.0
    k = np.arange(n)
    tone, second, spur = (np.sin(2 * math.pi * b * k / n) for b in (20, 40, 77))
    x = 0.5 + tone + 0.1 * second + 0.01 * spur
    f = spark.createDataFrame([("a", 0, x.tolist())], "trace string, frame long, samples array<double>")
    r = spectral.analyse(f, sps).first()
    rms = math.sqrt((1 + 0.01 + 0.0001) / 2)
    assert abs(r["dc"] - 0.5) < 1e-9 and abs(r["rms"] - rms) < 1e-9 and abs(r["peak"] - np.abs(x - 0.5).max()) < 1e-9 and abs(r["crest"] - r["peak"] / r["rms"]) < 1e-9
    assert abs(r["fundamental_hz"] - 20 * sps / n) < 0.5 and abs(r["thd_db"] + 20) < 0.3 and abs(r["dbfs"] - 20 * math.log10(rms)) < 1e-6
    assert abs(r["enob"] - (r["sinad_db"] - 1.76) / 6.02) < 1e-9 and r["sinad_db"] <= r["snr_db"]


def test_ramp_of_a_regulator():
    a, b, q, r = np.array([[1.0, 0.1], [0.0, 1.0]]), np.array([[0.0], [0.1]]), np.eye(2), np.array([[0.5]])
    k = sequential.solve_lqr(a, b, q, r)
    p = sum(np.linalg.matrix_power(a - b @ k, i).T @ (q + k.T @ r @ k) @ np.linalg.matrix_power(a - b @ k, i) for i in range(3000))
    np.testing.assert_allclose(k, np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a), atol=1e-6)  # the gain is the best for the cost it leads to
    assert np.abs(np.linalg.eigvals(a - b @ k)).max() < 1
    assert sequential.kalman_ahead(np.array([1.0, 2.0]), 3, 0.5).tolist() == [2.0, 3.0, 4.0]


def test_vector_edges(spark):
    assert one(spark, vector.moved(arr(1, 2, 3), 0, 2)) == [2, 3, 1] and one(spark, vector.moved(arr(1, 2, 3), 2, 0)) == [3, 1, 2]
    assert one(spark, vector.moved(arr(1, 2, 3), 1, 1)) == [1, 2, 3] == one(spark, vector.moved(arr(1, 2, 3), 3, 0)) == one(spark, vector.moved(arr(1, 2, 3), 0, 3))
    assert one(spark, vector.dequeued(arr(1, 2), 5)).asDict() == {"taken": [1, 2], "left": []} and one(spark, vector.dequeued(arr(), 1)).asDict() == {"taken": [], "left": []}
    assert one(spark, vector.convolved(arr(1, 2), arr(3, 4, 5))) == [3, 10, 13, 10] and one(spark, vector.convolved(arr(), arr(1))) == []
    assert one(spark, vector.rounded(arr(0.5, 1.5, -2.5))) == [0, 2, -2] and one(spark, vector.rounded(arr(0.5, 1.5, -2.5), even=False)) == [1, 2, -3]
    assert one(spark, vector.null_to(arr(None, 1), 4.0)) == [4, 1] and one(spark, vector.appended(arr(), arr(1))) == [1]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_sums_of_long_vectors(spark, n):
    x = np.random.default_rng(n).normal(0, 1, n)
    df = spark.createDataFrame([(x.tolist(),)], "a array<double>")
    np.testing.assert_allclose(df.select(vector.integrated(F.col("a"))).first()[0], np.cumsum(x), atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_inverse_of_any_size(spark, n):
    m = np.random.default_rng(n).normal(0, 1, (n, n))
    m[0, 0] = 0.0 if n > 1 else m[0, 0]  # the first pivot must be looked for
    df = spark.createDataFrame([(m.tolist(),), ([[1.0] * n for _ in range(n)] if n > 1 else [[0.0]],)], "m array<array<double>>")
    good, bad = (r[0] for r in df.select(vector.inverted(F.col("m"))).collect())
    np.testing.assert_allclose(np.array(good) @ m, np.eye(n), atol=1e-8)
    assert bad is None


def test_crc16_known_value(spark):
    assert one(spark, scalar.crc16(F.lit("123456789").cast("binary"))) == 0x31C3 and one(spark, scalar.crc16(F.lit("123456789").cast("binary"), 0xFFFF)) == 0x29B1
    assert one(spark, scalar.crc16(F.lit("").cast("binary"))) == 0


def test_features_of_nothing(spark):
    f = features.features(spark.createDataFrame([("a", None, None), ("a", "x", 5)], "trace string, type string, at long"), trace=F.col("trace"), type=F.col("type"), idx=F.col("at"))
    assert f.columns == list(features.COLUMNS)
    got = features.add_features(f, f.limit(0)).orderBy("place").collect()
    assert [(r["type"], r["idx"], r["text"], r["place"]) for r in got] == [("", None, "", 0), ("x", 5, "", 1)]
    assert features.filter_features(f, ["x"], "", 5, 6).count() == 1 and features.filter_features(f, right=5).count() == 0


def test_windows_stay_inside(spark):
    modes = spark.createDataFrame([("a", "ValueAlign", 0.0, 10.0, "s"), ("b", "Stretch", None, None, "")], "group string, mode string, left double, right double, unit string")
    for zoom, pan, want in ((0.5, 0.9, (5, 10)), (2.0, 0.3, (0, 10)), (0.2, -1.0, (0, 2)), (-1.0, 0.5, (5, 5))):
        rows = {r["group"]: (r["left"], r["right"]) for r in lookup.shared_window(modes, zoom, pan).collect()}
        assert rows == {"a": want, "b": (None, None)}


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"a": 1, "b": {"c": 2}}, {"a": None}], indent=1))
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "object.json").write_text('{\n"a": 5\n}')
    read = lambda name: sorted(map(tuple, files.read_json(spark, str(tmp_path / name)).collect()), key=str)
    assert read("array.json") == [("1", '{"c":"2"}'), (None, None)] and read("lines.json") == [("1",), ("2",)] and read("object.json") == [("5",)]


def test_csv_keeps_columns_named_like_sparks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('x,_c0,,y\n1,2,3,"a\nb"\n')
    df = files.read_table(spark, str(tmp_path / "t.csv"), line_ends=True)
    assert df.columns == ["x", "_c0", "y"] and tuple(df.first()) == ("1", "2", "a\nb")


def test_places_over_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)] + [(5,)] * 40, "v long")
    got = grid.placed(df.repartition(7), [F.desc("v")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(141)) and [r["v"] for r in got] == sorted((r["v"] for r in got), reverse=True)


def test_polynomials_of_known_values(spark):
    got = one(spark, vector.polyfit(arr(1, 3, 4, 4, 5), 3))
    np.testing.assert_allclose(got, np.polyfit(range(5), [1, 3, 4, 4, 5], 3), atol=1e-9)
    assert one(spark, vector.polyfit(arr(1, 2), 2)) is None


def test_bits_are_written_and_read(spark):
    start = F.array(*[F.lit(x) for x in (0xAB, 0xCD, 0xEF)])
    for offset, count, value in ((0, 8, 0x12), (4, 12, 0x345), (7, 1, 0), (3, 18, 0x2AAAA), (0, 24, 0xFFFFFF), (5, 2, 7)):
        old = 0xABCDEF
        mask = ((1 << count) - 1) << (24 - offset - count)
        want = old & ~mask | (value & ((1 << count) - 1)) << (24 - offset - count)
        assert one(spark, scalar.write_bits(start, offset, count, F.lit(value))) == list(want.to_bytes(3)), (offset, count)
    assert one(spark, scalar.write_bits(start, 3, 0, F.lit(1))) == [0xAB, 0xCD, 0xEF]
