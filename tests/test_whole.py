"""Queries and operators that take all of their input, against plain loops."""

import os

import numpy as np
import pytest

from wavequarry.model import event_samples
from wavequarry.operators import calc, sequential, spectral, stats
from wavequarry.plans import catalog

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def events(spark):
    """Trace to its values."""
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    rows = event_samples(spark, DIR).select("trace", "idx", "value").toPandas().sort_values(["trace", "idx"])
    return {t: g["value"].to_numpy() for t, g in rows.groupby("trace")}


def by_trace(df, name="out"):
    rows = df.select("trace", "idx", name).toPandas().sort_values(["trace", "idx"])
    assert all(g["idx"].tolist() == list(range(len(g))) for _, g in rows.groupby("trace"))
    return {t: g[name].to_numpy() for t, g in rows.groupby("trace")}


def same(got, want, tol=2e-6):
    assert sorted(got) == sorted(want)
    for t in want:
        assert len(got[t]) == len(want[t])
        np.testing.assert_allclose(got[t], want[t], rtol=0, atol=tol)


# Recursive filters


def loop(x, start, step, made=lambda v, state: state):
    out, state = [], start(x[0])
    for i, v in enumerate(x):
        state = step(state, v) if i else state
        out.append(made(v, state))
    return np.array(out)


K = 0.2371
LOOPS = {
    "rc_low_pass": (lambda x: x, lambda s, v: s + (v - s) * K), "cr_high_pass": (lambda x: x, lambda s, v: s + (v - s) * K, lambda v, s: v - s), "drc_envelope": (lambda x: x, lambda s, v: max(v, s + (v - s) * K)),
    "rolling_average": (lambda x: x / 3, lambda s, v: (s * 2 + v) / 3), "rc_slew_limited": (lambda x: x, lambda s, v: s + max(-10, min(10, v - s)) * K),
}


@tables
@pytest.mark.parametrize("name", list(LOOPS))
def test_recursive_filters_take_every_sample(spark, events, name):
    assert max(map(len, events.values())) > 200
    same(by_trace(catalog.QUERIES[name](spark, DIR)), {t: loop(x, *LOOPS[name]) for t, x in events.items()})


@tables
@pytest.mark.parametrize(("name", "f"), [("rc_low_pass", sequential.rc(K)), ("cr_high_pass", sequential.cr(K)), ("rolling_average", sequential.rolling_average(3))])
def test_states_are_carried_over_small_blocks(spark, events, name, f):
    same(by_trace(sequential.linear_filter(event_samples(spark, DIR), f, 16)), {t: loop(x, *LOOPS[name]) for t, x in events.items()}, 1e-8)


@tables
@pytest.mark.parametrize("size", [1, 7, 64])
def test_envelope_is_carried_over_small_blocks(spark, events, size):
    same(by_trace(sequential.drc(event_samples(spark, DIR), K, size)), {t: loop(x, *LOOPS["drc_envelope"]) for t, x in events.items()}, 1e-8)


@tables
def test_named_filters_take_every_sample(spark, events, monkeypatch):
    long = {"a": np.sin(np.arange(700.0)), "b": np.cos(np.arange(350.0) / 3)}
    rows = spark.createDataFrame([(t, i, float(v)) for t, x in long.items() for i, v in enumerate(x)], "trace string, idx long, value double")
    monkeypatch.setattr(catalog, "event_samples", lambda *_: rows)
    got = catalog.QUERIES["named_filters"](spark, DIR).toPandas()
    assert got.groupby(["filter", "trace"]).size().unstack().to_dict("list") == {"a": [700] * 9, "b": [350] * 9}
    for t, x in long.items():
        box = got[(got["filter"] == "Box 10") & (got["trace"] == t)].sort_values("idx")["out"].to_numpy()
        padded = np.concatenate([np.full(20, x[0]), x, np.full(20, x[-1])])
        sums = [np.convolve(padded, np.full(10, 0.1), "valid")[20 - d : 20 - d + len(x)] for d in (4, 5)]
        assert min(np.abs(box - s).max() for s in sums) < 2e-6


@tables
def test_named_filters_do_not_share_a_stage(spark):
    """What is returned only reads the filters' results; no sorts of several filters are left to one stage."""
    plan = catalog.QUERIES["named_filters"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


# Vectors


@pytest.fixture(scope="module")
def embeddings(spark):
    """vec_id to its components."""
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    return {r[0]: np.array(r[1], float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()}


def arrays(df, key, place, name):
    rows = df.select(key, place, name).toPandas().sort_values([key, place])
    return {int(k): g[name].to_numpy() for k, g in rows.groupby(key)}


@tables
def test_transforms_take_every_vector(spark, embeddings):
    assert len(embeddings) > 40
    run = lambda name: catalog.QUERIES[name](spark, DIR)
    n = np.arange(64)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(33), n) / 64) / 64
    spectra = {k: dft @ x for k, x in embeddings.items()}
    same(arrays(run("fft_magnitude"), "trace", "bin", "magnitude"), {k: np.abs(z) for k, z in spectra.items()})
    same(arrays(run("fft_decibel"), "trace", "bin", "db"), {k: 20 * np.log10(np.abs(z)) for k, z in spectra.items()}, 2e-4)
    same(arrays(run("fft_round_trip"), "trace", "idx", "value"), embeddings)
    back = lambda z: sum(2 * (z[k] * np.exp(2j * np.pi * n * k / 64)).real for k in range(4, 13))
    same(arrays(run("fft_band_pass"), "trace", "idx", "value"), {k: back(z) for k, z in spectra.items()})
    shaped = run("fft_shaped_filters").groupBy("shape").count().collect()
    assert {r[1] for r in shaped} == {64 * len(embeddings)} and len(shaped) == 6


@tables
def test_vector_queries_take_both_halves(spark, embeddings):
    a, b = {k: x[:32] * 10 for k, x in embeddings.items()}, {k: x[32:] * 10 for k, x in embeddings.items()}
    unary, binary = catalog.QUERIES["vector_unary"](spark, DIR).cache(), catalog.QUERIES["vector_binary"](spark, DIR).cache()
    for name, f in {"abs": np.abs, "reversed": lambda x: x[::-1], "rotated": lambda x: np.roll(x, -2), "diff": lambda x: np.diff(x, prepend=x[0]), "sorted": np.sort}.items():
        same(arrays(unary, "vec_id", "i", name), {k: f(x) for k, x in a.items()})
    for name, f in {"plus": lambda x, y: x + y, "times": lambda x, y: x * y, "integral": lambda x, _: np.cumsum(x), "unit": lambda x, _: x / np.sqrt((x * x).sum())}.items():
        same(arrays(binary, "vec_id", "i", name), {k: f(a[k], b[k]) for k in a})
    reduced = catalog.QUERIES["vector_reduce"](spark, DIR).toPandas().set_index("vec_id")
    for name, f in {"sum": lambda x, _: x.sum(), "median": lambda x, _: np.median(x), "rms": lambda x, _: np.sqrt((x * x).mean()), "dot": lambda x, y: x @ y, "norm": lambda x, _: np.sqrt((x * x).sum())}.items():
        np.testing.assert_allclose(reduced[name].loc[list(a)], [f(a[k], b[k]) for k in a], rtol=0, atol=2e-6)


# Filters over frames


@pytest.mark.parametrize("n", [1, 37, 64, 100, 203])
def test_overlap_add_returns_every_sample(spark, n):
    x = np.random.default_rng(n).normal(0, 1, n)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "trace string, idx long, value double")
    same(by_trace(spectral.overlap_added(rows, 64, lambda k: np.ones(k))), {"a": x}, 1e-9)


@tables
def test_poly_filter_returns_every_sample(spark, events):
    f = catalog.QUERIES["poly_filter"](spark, DIR).selectExpr("trace", "frame * 200 + place AS idx", "value")
    fit = lambda x: np.polyval(np.polyfit(np.arange(len(x)), x, min(5, len(x) - 1)), np.arange(len(x)))
    same(by_trace(f, "value"), {t: np.concatenate([fit(x[i : i + 200]) for i in range(0, len(x), 200)]) for t, x in events.items()})


# Products


@tables
def test_products_take_every_sample(spark, events):
    got = {r["trace"]: r for r in catalog.QUERIES["product_and_norm_whole"](spark, DIR).collect()}
    assert sorted(got) == sorted(events)
    for t, x in events.items():
        v = x / 50
        assert got[t]["sign"] == np.prod(np.sign(v)) and abs(got[t]["magnitude"] - np.sqrt((v * v).sum())) < 2e-6
        assert (v == 0).any() or abs(got[t]["log10"] - np.log10(np.abs(v)).sum()) < 2e-6


def test_products_keep_sign_and_zero(spark):
    rows = [("a", 1e200), ("a", -1e200), ("b", 0.0), ("b", -2.0), ("c", -2.0), ("c", -50.0)]
    s = spark.createDataFrame([(t, i, v) for i, (t, v) in enumerate(rows)], "trace string, idx long, value double")
    assert {r["trace"]: (r["sign"], r["log10"]) for r in stats.log_products(s).collect()} == {"a": (-1, 400.0), "b": (0, None), "c": (1, 2.0)}


# Kernels, fits and medians


@pytest.mark.parametrize(("n", "m"), [(50, 20), (50, 21), (20, 39), (20, 41), (20, 42), (7, 3), (100, 1), (5, 10), (64, 64)])
def test_kernels_of_any_length(spark, monkeypatch, n, m):
    rng = np.random.default_rng(n * 100 + m)
    x, h = rng.normal(0, 1, n), rng.normal(0, 1, m)
    s = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(x)] + [("h", i, float(v)) for i, v in enumerate(h)], "trace string, idx long, value double")
    half = m // 2
    want = np.array([sum(h[k] * x[min(max(i + k - (m - 1 - half), 0), n - 1)] for k in range(m)) for i in range(n)]) if n >= half else np.zeros(n)
    for most in (4096, 0):  # as a list of taps, and by blocks
        monkeypatch.setattr(calc, "KERNEL", most)
        got = calc.fir_by_trace(s, "x", "h", 64 if most else 8).orderBy("idx").collect()
        np.testing.assert_allclose([r["out"] for r in got], want, rtol=0, atol=1e-9)


def test_medians_by_ranges(spark):
    rng = np.random.default_rng(8)
    traces = {"odd": rng.normal(0, 1, 501), "even": np.exp(rng.normal(0, 20, 400)), "one": [3.0], "flat": [7.0] * 9, "wide": [1e308, -1e308, 5.0, 6.0], "hot": [2.0] * 300 + [1.0, 5.0], "signs": [-0.0, 0.0, -1.0, 1.0]}
    s = spark.createDataFrame([(t, i, float(v)) for t, x in traces.items() for i, v in enumerate(x)] + [("nan", 0, float("nan")), ("null", 0, None)], "trace string, idx long, value double")
    for bins, small in ((3, 0), (3, 2), (4096, 50), (4096, 10_000)):
        got = {r["trace"]: r["median"] for r in stats.middles(s, "value", bins, small).collect()}
        assert got == {t: float(np.median(x)) for t, x in traces.items()}
    got = {r["trace"]: r for r in stats.medians(s).collect()}
    assert set(got) == {*traces, "nan", "null"} and got["null"]["median"] is None
    for t in ("odd", "one", "flat", "hot"):
        x = np.array(traces[t])
        want = [np.median(x), np.abs(x - x.mean()).mean(), np.median(np.abs(x - np.median(x)))]
        np.testing.assert_allclose([got[t][c] for c in ("median", "mad_mean", "mad_median")], want, rtol=0, atol=1e-12)
    assert stats.medians(s.limit(0)).count() == 0


def test_fits_of_short_traces_meet_their_samples(spark):
    traces = {"a": [3.0], "b": [1.0, 2.0], "c": [5.0, -1.0, 4.0, 4.0], "d": np.polyval([2.0, -1.0, 0.5, 3.0], np.linspace(-1, 1, 90)).tolist()}
    s = spark.createDataFrame([(t, i, v) for t, x in traces.items() for i, v in enumerate(x)], "trace string, idx long, value double")
    same(by_trace(calc.poly_filtered(s, 5)), {t: np.array(x) for t, x in traces.items()}, 1e-9)
