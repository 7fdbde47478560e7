"""Transforms of whole traces and summaries at all zooms against plain versions, with blocks of a few samples."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.operators import pyramid, transform
from wavequarry.session import ship

SIZES = (1, 2, 3, 4, 5, 7, 16, 97, 360)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    return {f"t{n}": rng.normal(size=n) for n in SIZES}


def samples(spark, data):
    ship(spark)
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "trace string, idx long, value double").repartition(3)


def test_chirp_is_exact():
    k, n = np.array([0, 5, 2**39 - 7, 2**33 + 1]), 2**39 - 1
    want = [np.exp(-1j * np.pi * float(Fraction(int(x) ** 2 % (2 * n), n))) for x in k]
    assert np.abs(transform.chirp(k, n) - want).max() < 1e-12


def test_eight_samples(spark):
    # The magnitudes of the transform of 1 to 8, over its length.
    s = samples(spark, {"x": np.arange(1.0, 9.0)})
    got = transform.whole_spectrum(s).toPandas().sort_values("bin")
    assert np.abs(got["magnitude"].to_numpy() - [4.5, 1.30656, 0.70711, 0.5412, 0.5]).max() < 1e-4


@pytest.mark.parametrize("values", [transform.VALUES, 8])
def test_transform(spark, data, values):
    got = transform.transformed(transform.complex_samples(samples(spark, data)), values=values)
    back = transform.transformed(got, inverse=True, values=values).toPandas()
    got = got.toPandas()
    for name, x in data.items():
        g, b = (d[d.trace == name].sort_values("idx") for d in (got, back))
        assert g["idx"].tolist() == b["idx"].tolist() == list(range(len(x)))
        assert np.abs(g["re"].to_numpy() + 1j * g["im"].to_numpy() - np.fft.fft(x)).max() < 1e-9
        assert np.abs(b["re"].to_numpy() - x).max() < 1e-9 and np.abs(b["im"].to_numpy()).max() < 1e-9


def test_whole_filter(spark, data):
    got = transform.whole_filtered(samples(spark, data), lambda b, n: F.when(b * 8 <= n, 1.0).otherwise(0.0), values=16).toPandas()
    for name, x in data.items():
        z = np.fft.fft(x)
        at = np.arange(len(x))
        z[np.minimum(at, len(x) - at) * 8 > len(x)] = 0
        g = got[got.trace == name].sort_values("idx")
        assert np.abs(g["out"].to_numpy() - np.fft.ifft(z).real).max() < 1e-9
    assert transform.whole_spectrum(samples(spark, data).limit(0)).collect() == []


def test_whole_filter_holds_small_blocks_and_plans_once(spark, monkeypatch):
    """No array that goes out of a task holds over 2^17 values, and the transform isn't run once more to count its rows."""
    real, plans = transform.tiles, []

    def tiles(trace, plan, start, arrays, width):
        assert all(a.size <= 1 << 17 for a in arrays)
        return real(trace, plan, start, arrays, width)

    plan_of = transform.plan_of
    monkeypatch.setattr(transform, "tiles", tiles)
    monkeypatch.setattr(transform, "plan_of", lambda z: plans.append(1) or plan_of(z))
    rows = spark.range(70_000).select(F.lit("t").alias("trace"), F.col("id").alias("idx"), (F.col("id") % 7).cast("double").alias("value"))
    got = transform.whole_filtered(rows, lambda b, n: F.lit(1.0)).agg(F.count("*"), F.max(F.abs(F.col("out") - F.col("idx") % 7))).first()
    assert got[0] == 70_000 and got[1] < 1e-9 and len(plans) == 1


def test_a_range_is_two_runs_a_level(spark):
    """So the work of a range doesn't grow with the fan; null is left out, NaN is the greatest."""
    ranges = spark.createDataFrame([(0, "t", 1, 359), (1, "t", 3, 4), (2, "t", 15, 17)], "k long, trace string, lo long, hi long")
    assert [r["count"] for r in pyramid.runs(ranges, 2, 16).groupBy("k").count().orderBy("k").collect()] == [4, 1, 2]
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate([None, 1.0, float("nan"), 3.0, None])], "trace string, idx long, value double")
    asked = spark.createDataFrame([(0, "t", 0, 2), (1, "t", 2, 4), (2, "t", 4, 5), (3, "t", 3, 5)], "k long, trace string, lo long, hi long")
    got = {r["k"]: (r["n"], r["low"], str(r["high"]), str(r["total"])) for r in pyramid.range_stats(pyramid.pyramid(rows, 4), asked, ["k"], 4).collect()}
    assert got == {0: (2, 1.0, "1.0", "1.0"), 1: (2, 3.0, "nan", "nan"), 2: (1, None, "None", "None"), 3: (2, 3.0, "3.0", "3.0")}


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_range_stats(spark, data, fan):
    s = samples(spark, data)
    rng = np.random.default_rng(fan)
    ranges = [(k, f"t{n}", int(a), int(a + w)) for k, (n, a, w) in enumerate(zip(rng.choice(SIZES, 200), rng.integers(-5, 360, 200), rng.integers(0, 400, 200)))]
    ranges += [(500, "t360", 0, 360), (501, "t360", 17, 18), (502, "none", 0, 9)]
    cells = pyramid.pyramid(s, fan)
    got = {r["k"]: r for r in pyramid.range_stats(cells, spark.createDataFrame(ranges, "k long, trace string, lo long, hi long"), ["k"], fan).collect()}
    want = {k: x[max(a, 0) : max(b, 0)] for k, t, a, b in ranges for x in [data.get(t, np.zeros(0))] if len(x[max(a, 0) : max(b, 0)])}
    assert got.keys() == want.keys()
    for k, x in want.items():
        g = got[k]
        assert (g["n"], g["low"], g["high"]) == (len(x), x.min(), x.max())
        assert np.allclose([g["total"], g["mean"], g["rms"], g["std"]], [x.sum(), x.mean(), np.sqrt((x * x).mean()), x.std()], atol=1e-6)
    # A range is few cells, whatever its length.
    most = pyramid.pieces(spark.createDataFrame([(0, "t360", 1, 359)], "k long, trace string, lo long, hi long"), 9, fan).count()
    assert most <= 2 * (fan - 1) * (int(np.log(360) / np.log(fan)) + 1)


def test_views(spark, data):
    s = samples(spark, data)
    views = spark.createDataFrame([(0, "t360", 0, 360), (1, "t360", 100, 117), (2, "t97", 5, 97), (3, "t1", 0, 1)], "view long, trace string, lo long, hi long")
    drawn = pyramid.zoomed(pyramid.pyramid(s), views, 50).collect()
    fine = pyramid.upsampled(s, views, 50).collect()
    assert len(drawn) == len(fine) == 200
    spans = {0: ("t360", 0, 360), 1: ("t360", 100, 117), 2: ("t97", 5, 97), 3: ("t1", 0, 1)}
    for r in drawn:
        trace, lo, hi = spans[r["view"]]
        a, b = (lo + p * (hi - lo) // 50 for p in (r["pixel"], r["pixel"] + 1))
        x = data[trace][a : max(b, a + 1)]
        assert (r["low"], r["high"]) == (x.min(), x.max()) and abs(r["mean"] - x.mean()) < 1e-9
    for v, (trace, lo, hi) in spans.items():
        x, last = data[trace][lo:hi], -1
        for r in sorted((r for r in fine if r["view"] == v), key=lambda r: r["pixel"]):
            at = r["pixel"] * len(x) // 50
            rest = 0.0 if at != last else r["pixel"] * len(x) / 50 - at
            last = at
            assert r["nearest"] == x[at] and abs(r["linear"] - (x[at] * (1 - rest) + x[min(at + 1, len(x) - 1)] * rest)) < 1e-9


def test_averages_do_not_depend_on_blocks(spark):
    from wavequarry.operators import spectral

    rng = np.random.default_rng(4)
    x = {"a": rng.normal(size=32 * 9), "b": rng.normal(size=40)}
    f = spectral.frames(samples(spark, x), 32)
    for k, size in ((1, 1024), (3, 4), (4, 4)):
        got = {(r["trace"], r["frame"]): r["magnitudes"] for r in spectral.averaged(f, k, size=size).collect()}
        for name, v in x.items():
            each = [spectral.frame_magnitudes(v[i * 32 : i * 32 + 32], "RaisedCosine") for i in range(len(v) // 32)]
            for i in range(len(each)):
                assert np.allclose(got[name, i], np.mean(each[max(0, i - k + 1) : i + 1], axis=0), atol=1e-12)
        assert len(got) == 10


def test_tones_over_the_baseline(spark):
    from wavequarry.operators import spectral

    n, i = 1024, np.arange(1024)
    x = np.sin(2 * np.pi * 100 * i / n) + 0.05 * np.sin(2 * np.pi * 300 * i / n) + 1e-5 * np.random.default_rng(1).normal(size=n)
    m = spectral.averaged(spectral.frames(samples(spark, {"x": x}), n), 2)
    got = spectral.tones_over_baseline(m, float(n)).orderBy("tone").collect()
    strong = [r for r in got if r["db"] > -60]
    assert [round(r["hz"]) for r in strong] == [100, 300] and abs(strong[0]["db"] - strong[1]["db"] - 20 * np.log10(20)) < 0.5
    figures = spectral.analyse_averaged(spectral.frames(samples(spark, {"x": x}), n), float(n), 2).collect()[0]
    assert round(figures["fundamental_hz"]) == 100 and abs(figures["thd_db"] + 20 * np.log10(20)) < 0.5


def test_connected_sets(spark):
    from wavequarry.plans import grid

    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(5, int(v)) for v in rng.integers(10, 60, 40)] + [(7, 7), (900, 901), (901, 900), (900, 901)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in grid.connected(df).collect()}
    assert got == {n: find(n) for n in root}
    near = {r["node"] for r in grid.connected_to(df, spark.createDataFrame([(1100,), (7,), (123456,)], "node long")).collect()}
    assert near == {*range(1000, 1201), 7}
    assert grid.connected(df.limit(0)).collect() == []
