"""Operators against small known results and plain loops. The known inputs and results are fixed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.functions import scalar, vector
from wavequarry.model import time_of, with_index
from wavequarry.operators import lookup, sequential, spectral, stats, triggers, windows
from wavequarry.plans.grid import Grid, nearest
from wavequarry.sources import files


def trace(spark, values, name="a"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "trace string, idx long, value double")


def values(df, col="out"):
    return [r[0] for r in df.orderBy("trace", "idx").select(col).collect()]


def close(a, b, tol=1e-9):
    assert len(a) == len(b)
    assert all(math.isnan(x) and math.isnan(y) or abs(x - y) <= tol for x, y in zip(a, b)), (a, b)


X = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_known_windows(spark, size):
    close(values(windows.rolling_mean(trace(spark, X), 2, size)), [1.5, 2, 3, 4, 5, 6, 6.5])
    close(values(windows.rolling_rms(trace(spark, [1, -1, 1, -1, 1, -2, 2, 2][:7]), 2, size))[:3], [1, 1, 1])
    close(values(windows.delay(trace(spark, X), 3, size)), [0, 0, 0, 1, 2, 3, 4])
    close(values(windows.differentiated(trace(spark, [5, 7, 9, 9]), size)), [0, 2, 2, 0])
    close(values(windows.integrated(trace(spark, [1, 3, 5, 5]), size)), [1, 4, 9, 14])
    close(values(windows.unwrapped(trace(spark, [50, 100, 150, -160, -120, -160, 150]), 360.0, 180.0, size)), [50, 100, 150, 200, 240, 200, 150])


def test_blocks_do_not_change_results(spark):
    rng = np.random.default_rng(1)
    s = trace(spark, rng.normal(0, 30, 200))
    for f in (lambda z: windows.moving_average(s, 5, z), lambda z: windows.moving_rms(s, 5, z), lambda z: windows.fir(s, [0.2, 0.3, 0.5], size=z), lambda z: windows.centred_fir(s, [0.2, 0.3, 0.4, 0.1], size=z), lambda z: windows.steady_state(s, 4, 25.0, z), lambda z: windows.rolling_max(s, 7, z), lambda z: sequential.linear_filter(s, sequential.bessel_band_pass(), z)):
        close(values(f(16)), values(f(1 << 16)), 1e-8)


def test_fixed_point(spark):
    s = windows.fixed_point_stats(trace(spark, [1, 2]), 4).where("idx = 1").first()
    close([s["mean"], s["out"], s["sum"], s["sum_square"], s["rms"], s["std"]], [1.25, 1, 5, 7, math.sqrt(7 / 4), math.sqrt(0.75 / 4)], 1e-6)
    s = windows.fixed_point_stats(trace(spark, [0.1, 0.3]), 2, 4).where("idx = 1").first()
    close([s["out"], s["mean"]], [0.0625, (0.0625 + 0.25) / 2])


def test_savitzky_golay_of_a_line_gives_its_middle(spark):
    assert abs(values(windows.savitzky_golay(trace(spark, [0, 1, 2, 3, 4]), 5, 2))[-1] - 2) < 1e-9


def test_statistics(spark):
    m = stats.medians(trace(spark, [5, 3, 1, 5])).first()
    close([m["median"], m["mad_mean"], m["mad_median"]], [4, 1.5, 1])
    t = stats.trace_stats(trace(spark, [5, 3, 1, 5])).first()
    close([t["rms"], t["std"], t["variance"], t["last"]], [3.873, 1.658, 2.75, 5], 1e-3)
    h = [tuple(r)[2:4] for r in stats.histogram(trace(spark, [1, 1, 3, 3, 3, 5, 4, 9, 10, 10]), 3).orderBy("bin").collect()]
    assert h == [(2.5, 7), (5.5, 1), (8.5, 2)]
    assert stats.histogram(trace(spark, [2, 2]), 3).count() == 0
    n = stats.trace_stats(trace(spark, [1, float("nan"), 3])).first()
    close([n["count"], n["mean"]], [3, 2])


def test_resample(spark):
    close([r[0] for r in lookup.resampled(trace(spark, range(1, 11)), 5).orderBy("i").select("value").collect()], [1, 3, 5, 7, 9])
    close([r[0] for r in lookup.resampled(trace(spark, [1, 3, 5, 7, 9]), 10).orderBy("i").select("value").collect()], [1, 2, 3, 4, 5, 6, 7, 8, 9, 9])


def test_grid_interpolation(spark):
    s = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 10.0), (4.0, 40.0)])], "trace string, idx long, x double, value double")
    close([r[0] for r in lookup.linear_onto_grid(s, "x", 6, 0.0, 1.0).orderBy("i").select("value").collect()], [0, 10, 20, 30, 40, float("nan")])


def test_to_uniform_snaps_to_samples(spark):
    s = spark.createDataFrame([("a", i, t, float(i)) for i, t in enumerate([0.0, 1.0, 2.2, 3.3, 4.3])], "trace string, idx long, t double, value double")
    got = {r["i"]: r["value"] for r in lookup.to_uniform(s).collect()}
    assert got[0] == 0 and got[1] == 1 and len(got) == 5
    assert 1.7 < got[2] <= 2


def test_as_of_is_strict(spark):
    s = spark.createDataFrame([("a", i, float(t), float(10 * i)) for i, t in enumerate([1, 2, 3, 100])], "trace string, idx long, t double, value double")
    q = spark.createDataFrame([("a", t, i) for i, t in enumerate([0.0, 1.0, 2.0, 2.5, 99.0, 200.0])], "trace string, t double, q long")
    assert [r["idx"] for r in lookup.as_of(s, q, 10.0).orderBy("q").collect()] == [0, 0, 0, 1, 2, 3]
    assert [r["idx"] for r in lookup.as_of(s, q, 10.0, strict=False).orderBy("q").collect()] == [0, 0, 1, 1, 2, 3]


def test_first_at_least(spark):
    s = trace(spark, [1, 5, 2, 9, 3])
    e = spark.createDataFrame([("a", v) for v in (0.5, 5.0, 6.0, 10.0)], "trace string, at double")
    assert [r["idx"] for r in lookup.first_at_least(s, e, "at").orderBy("at").collect()] == [0, 1, 3, -1]


def test_triggered_slices_keep_their_distance(spark):
    s = trace(spark, [0, 1, 0, 1, 0, 1, 0, 1])
    cuts = triggers.triggered_slices(s, 1.0, gap=3).groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect()
    assert [r["n"] for r in cuts] == [4, 3]


def rc_loop(x, k):
    c, out = x[0], []
    for v in x:
        c += (v - c) * k
        out.append(c)
    return out


def test_linear_filters_match_loops(spark):
    x = np.random.default_rng(2).normal(0, 1, 300)
    close(values(sequential.linear_filter(trace(spark, x), sequential.rc(0.3), 64)), rc_loop(x, 0.3))
    w = np.zeros((4, 2))
    want = []
    for v in x * sequential.BESSEL_GAIN:
        for i, (p, q, m) in enumerate(sequential.BESSEL_SECTIONS):
            w0 = v + p * w[i, 0] + q * w[i, 1]
            v = w0 + m * w[i, 0] + w[i, 1]
            w[i] = w0, w[i, 0]
        want.append(v)
    close(values(sequential.linear_filter(trace(spark, x), sequential.bessel_band_pass(), 64)), want, 1e-8)


def test_rls_known_result(spark):
    s = spark.createDataFrame([("a", i, float(4 - i), float(1 + i)) for i in range(4)], "trace string, idx long, value double, d double")
    close(values(sequential.sequential(s, ["value", "d"], lambda: sequential.Rls(4, 2, 0.02))), [0, 0.936914, 2.385421, 3.243571], 1e-3)


def test_kalman_follows_a_line(spark):
    s = trace(spark, [0.5 * i for i in range(60)])
    assert abs(values(sequential.sequential(s, ["value"], lambda: sequential.Kalman([0.1], [0.01]), width=1).withColumn("out", F.col("out")[0]))[-1] - 29.5) < 0.1


def test_spectrum(spark):
    z = spectral.spectrum(spectral.whole(trace(spark, range(1, 9)))).orderBy("bin")
    close([r["magnitude"] for r in z.collect()], [4.5, 1.31, 0.71, 0.54, 0.5], 0.01)


def test_filters_pass_and_stop(spark):
    i = np.arange(256)
    s = trace(spark, np.sin(2 * np.pi * 8 * i / 256) + np.sin(2 * np.pi * 64 * i / 256))
    low = np.array(spectral.filtered(spectral.whole(s), lambda n: spectral.band_pass(n, 0, 20)).first()["samples"])
    assert np.abs(low - np.sin(2 * np.pi * 8 * i / 256)).max() < 1e-9
    added = dict(spectral.overlap_added(s, 64, lambda n: np.ones(n)).select("idx", "out").collect())
    assert max(abs(added[k] - s.collect()[k]["value"]) for k in (40, 100, 200)) < 1e-9
    a = spectral.analyse(spectral.whole(s), 256.0).first()
    assert abs(a["fundamental_hz"] - 8) < 1 or abs(a["fundamental_hz"] - 64) < 1
    for kind in spectral.WINDOWS:
        assert len(spectral.window(9, kind)) == 9
        assert np.allclose(spectral.window(9, kind), spectral.window(9, kind)[::-1])


def test_window_inverse():
    for kind in ("Blackman", "Hamming", "RaisedCosine", "RaisedCosineSquared", "Log60dB", "FrontBackQuarterRaisedCosine"):
        x = spectral.window_inverse(0.5, kind)
        assert abs(float(spectral.window_value(np.float64(x), kind, np)) - 0.5) < 1e-6


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_vectors(spark):
    r = one(spark, vector.copy(arr(1, 2, 3), -1, 5, -1, 6), vector.add(arr(1, 2, 3), arr(2, 3, 4)), vector.dot(arr(1, 2, 3), arr(2, 3, 4)), vector.median(arr(5, 3, 1, 5)), vector.rotated(arr(1, 2, 3), 1), vector.reflected(arr(1, 2, 3, 4)), vector.cross(arr(1, 0, 0), arr(0, 1, 0)), vector.median(F.array().cast("array<double>")), vector.reciprocal(arr(0, 2)), vector.equal(arr(1), arr(1.05), 0.1))
    assert list(r[0]) == [-1, 1, 2, 3, 6] and list(r[1]) == [3, 5, 7] and r[2] == 20 and r[3] == 4 and list(r[4]) == [2, 3, 1] and list(r[5]) == [1, 2, 2, 1] and list(r[6]) == [0, 0, 1] and r[7] == 0 and r[8] == [math.inf, 0.5] and r[9]
    q = one(spark, vector.quaternion_rotated(arr(math.sqrt(0.5), 0, 0, math.sqrt(0.5)), arr(1, 0, 0)), vector.rotated_around(arr(1, 0, 0), arr(0, 0, 2), F.lit(math.pi / 2)), vector.polyval(arr(1, 2, 3), F.lit(2.0)))
    close(list(q[0]), [0, 1, 0])
    close(list(q[1]), [0, 1, 0])
    assert q[2] == 11


def test_vectors_of_different_lengths_are_refused(spark):
    with pytest.raises(Exception, match="length"):
        one(spark, vector.add(arr(1, 2), arr(1)))


@pytest.mark.parametrize(("a", "b"), [("test2", "test12"), ("test2022-1-7a", "test2022-02-07a"), ("a.5b", "a.6b"), ("a.5b", "a.51b"), ("1.12.3", "1.23.10"), ("1.12.3.20", "1.12.3.100"), ("1,234,567.89", "1,23,5000.42x"), ("test", "test1")])
def test_natural_order(spark, a, b):
    r = one(spark, scalar.natural_key(F.lit(a)), scalar.natural_key(F.lit(b)))
    assert r[0] < r[1]


def test_natural_order_equals(spark):
    r = one(spark, *[scalar.natural_key(F.lit(x)) for x in ("a1.5a", "a01.5a", "test1.50a", "TEST1.5a")])
    assert r[0] == r[1] and r[2] == r[3]


def test_scalars(spark):
    r = one(spark, scalar.to_double(F.lit("x")), scalar.to_bool(F.lit("Yes")), scalar.to_bool(F.lit("no")), scalar.hex_to_uint32(F.lit("0xFF")), scalar.hex_to_uint32(F.lit("-1")), scalar.crc16(F.lit("123456789").cast("binary")), scalar.from_base32(F.lit("MZXW6YTB")), scalar.read_bits_signed(F.array(F.lit(0xF1), F.lit(2)), 0, 4), scalar.strip_decoration(F.lit("CH1.x.Max"), ["CH1.", "CH"], [".Max"]), scalar.strip_decoration(F.lit("CH1."), ["CH1."], []))
    assert r[0] == 0 and r[1] and not r[2] and r[3] == 255 and r[4] == 0 and r[5] == 0x31C3 and bytes(r[6]) == b"fooba" and r[7] == -1 and r[8] == "x" and r[9] == "CH1."


def test_grid(spark):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate([("a", "1"), ("b", "2"), ("a", "3"), ("a", "4"), ("b", "5")])], "i long, key string, val string")
    g = Grid.of(df, "i")
    u = g.apply("unique_count", "key").rows().orderBy("_pos")
    assert [tuple(r)[1:4] for r in u.collect()] == [("a", 3, "1"), ("b", 2, "2")]
    h = g.apply("show_regex", "key", "A").apply("decimate", 2)
    assert [r["val"] for r in h.rows().orderBy("_pos").collect()] == ["1", "4"]
    assert h.undo().rows().count() == 3 and h.undo().redo().rows().count() == 2 and h.show_all().rows().count() == 5
    assert [r["val"] for r in g.apply("sort_by", "key", descending=True).rows().orderBy("_pos").collect()] == ["5", "2", "4", "3", "1"]
    assert g.apply("transpose").apply("transpose").rows().count() == 5
    assert g.apply("add_column", "n", ["x", "y"]).rows().orderBy("_pos").first()["n"] == "x"
    assert h.replay(df.where("i < 3"), "i").rows().count() == 1
    assert nearest(g.frame, "val", "3.9").first()["val"] == "4"
    assert g.apply("append_rows", spark.createDataFrame([(0, 9, "c", "9")], "_index long, i long, key string, val string")).rows().count() == 6


def test_null_cells_are_the_text_null(spark):
    g = Grid.of(spark.createDataFrame([(0, None), (1, "x"), (2, "")], "i long, v string"), "i")
    assert g.apply("show_regex", "v", "NULL").rows().count() == 1
    assert g.apply("hide_matching", "v", [None]).rows().count() == 2
    assert g.apply("unique_count", "v").rows().where("v is null").first()["v count"] == 2


def test_wav_round_trip(spark, tmp_path):
    x = np.array([[0.5, -0.5, 1.0, -1.0, 2.0], [0.0, 0.1, 0.2, 0.3, 0.4]])
    (tmp_path / "a.wav").write_bytes(files.encode_wav(x, 8000))
    rows = files.read_wav(spark, str(tmp_path / "a.wav"))
    got = [r["value"] for r in rows.where("trace like '%:0'").orderBy("idx").collect()]
    close(got, [0.5, -0.5, 1.0, -1.0, 1.0], 1e-4)
    assert rows.first()["sps"] == 8000
    with pytest.raises(ValueError, match="WAV"):
        files.decode_wav(b"nothing here at all")


def test_csv_quirks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b,c\n1,,3\n,b2,\n\n"hello, world",2,3\n"line1\nline2",2\n1,2,3,4\n')
    rows = files.read_table_exact(spark, str(p), ["a", "b", "c"]).orderBy("row").collect()
    assert [tuple(r)[2:] for r in rows] == [("1", "", "3"), ("", "b2", ""), ("", "", ""), ("hello, world", "2", "3"), ("line1\nline2", "2", ""), ("1", "2", "3")]
    got = {tuple(r) for r in files.read_table(spark, str(p)).collect()}
    assert ("hello, world", "2", "3") in got and ("1", "", "3") in got
    assert [r[0] for r in spark.createDataFrame([("a",), (None,), ("hel,lo",), ('say "hi"',)], "c string").select(files.cell_text(F.col("c"))).collect()] == ["a", "null", '"hel,lo"', '"say ""hi"""']


def test_text_that_is_no_number_is_nan(spark):
    df = spark.createDataFrame([(0, "1", "x"), (1, "nan", "2")], "i long, a string, b string")
    s = files.table_to_samples(df, "i", drop_nan=True)
    assert {(r["trace"], r["idx"], r["value"]) for r in s.collect()} == {("a", 0, 1.0), ("b", 0, 2.0)}


def test_index_and_axis(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (5, 1, 900, 3)], "trace string, t double")
    assert [r["idx"] for r in with_index(df, "trace", ["t"], F.floor(F.col("t") / 4)).orderBy("t").collect()] == [0, 1, 2, 3]
    t = spark.createDataFrame([(4,)], "idx long")
    lit = lambda x: F.lit(float(x))
    assert t.select(time_of(lit(2), lit(10), lit(0), lit(1))).first()[0] == 12
    assert t.select(time_of(lit(0), lit(0), lit(1), lit(3))).first()[0] == 15
    assert t.select(time_of(lit(0), lit(0), lit("nan"), lit(3))).first()[0] == 4


def test_empty_traces(spark):
    e = spark.createDataFrame([], "trace string, idx long, value double")
    for df in (windows.rolling_mean(e, 5), windows.integrated(e), stats.trace_stats(e), stats.histogram(e, 4), triggers.crossings(e, 1.0), sequential.linear_filter(e, sequential.rc(0.1)), spectral.spectrum(spectral.frames(e, 8))):
        assert df.count() == 0


@pytest.mark.parametrize("size", [64, 1 << 16])
def test_long_filters_match_short_ones(spark, size, monkeypatch):
    s = trace(spark, np.random.default_rng(3).normal(0, 1, 150))
    taps = np.random.default_rng(4).normal(0, 1, 14).tolist()
    kernel = values(windows.fir(s, taps, size=size)), values(windows.centred_fir(s, taps, 2.0, size=size))
    monkeypatch.setattr(windows, "SHORT", 99)
    close(kernel[0], values(windows.fir(s, taps, size=size)))
    close(kernel[1], values(windows.centred_fir(s, taps, 2.0, size=size)))


def test_sinks(spark, tmp_path):
    from wavequarry.model import seconds

    s = trace(spark, [1, 2.5])
    files.write_matrix(s, f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").first()[0] == "a 1.0 2.5"
    files.write_names(s, f"{tmp_path}/n", "CH.", "!")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/n").collect()] == ["CH.a!"]
    files.write_log(spark.createDataFrame([(1.0, "info", "x", None, "t", "n", "say \"hi\"", 2.0, "f", 3, b"\x01\xff")], files.LOG), f"{tmp_path}/log")
    assert files.read_table(spark, f"{tmp_path}/log").first()["data"] == "01FF"
    files.save_state(s, spark.createDataFrame([("a", 8.0)], "trace string, sps double"), f"{tmp_path}/state")
    assert files.load_state(spark, f"{tmp_path}/state")[0].count() == 2
    assert spark.sql("SELECT TIMESTAMP_NTZ'1970-01-01 00:00:01.5' AS ts").select(seconds("ts")).first()[0] == 1.5
    with pytest.raises(ValueError, match="reader"):
        files.read_any(spark, "x.unknown")


def test_cancelled_bins_are_summed_in_order(spark):
    """Samples that cancel in the highest bin: what the definition's sums leave, not a fast transform's 0."""
    pair = np.round(np.random.default_rng(6).exponential(40, 32), 2)
    x = np.repeat(pair, 2).tolist()
    re = im = 0.0
    for p, v in enumerate(x):
        angle = -2 * math.pi * p * 32 / 64
        re, im = re + v * math.cos(angle), im + v * math.sin(angle)
    want = 10 * math.log10(math.sqrt((re / 64) ** 2 + (im / 64) ** 2))
    got = [r["db"] for r in spectral.spectrogram(trace(spark, x), 64).collect() if r["bin"] == 32]
    assert len(got) == 1 and abs(got[0] - want) < 1e-6 and want > -200
