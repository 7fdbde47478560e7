"""Filter graphs, overlapping frames and live sources: the same however the input is dealt over batches, also after a restart."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.operators import sequential, spectral
from wavequarry.session import ship
from wavequarry.sources import files, livesource, rawsource
from wavequarry.streaming import graph, live

SCHEMA = "channel string, trace string, idx long, value double"


def folder(spark, tmp_path, rows, cuts):
    """rows in files whose times follow the cuts."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        time.sleep(0.05)
    return str(tmp_path / "part*")


def run(spark, tmp_path, made, name):
    live.run(made, "append", str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"))
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def diamond():
    g = graph.Graph().source("x", "a").source("y", "b").delay("late", "x", 3).fir("smooth", "x", [0.25, 0.5, 0.25]).low_pass("slow", "smooth", 0.3).mix("out", {"late": 0.5, "slow": 2.0, "y": -1.0})
    return g.gain("loud", "out", 10.0).reader("each", "out").reader("frames", "loud", 8, 3).reader("sparse", "late", 2, 7)


@pytest.mark.parametrize("cuts", [[], [1, 2, 50], [200, 201, 333]])
def test_graph(spark, tmp_path, cuts):
    ship(spark)
    rng = np.random.default_rng(0)
    data = {(c, t): rng.normal(size=n) for (c, t), n in {("p", "a"): 120, ("p", "b"): 97, ("q", "a"): 40, ("q", "b"): 160, ("r", "a"): 5}.items()}
    rows = [(c, t, i, float(v)) for (c, t), x in data.items() for i, v in enumerate(x)] + [("p", "unheard", 0, 1.0)]
    rows = sorted(rows, key=lambda r: r[2])  # the traces' samples come mixed
    stream = live.read_live(spark, folder(spark, tmp_path, rows, cuts), SCHEMA, files=1)
    got = {(r["channel"], r["reader"], r["frame"]): r["samples"] for r in run(spark, tmp_path, graph.compiled(stream, diamond()), "g").collect()}
    want = {}
    for c in "pqr":
        x, y = data.get((c, "a"), np.zeros(0)), data.get((c, "b"), np.zeros(0))
        late = np.concatenate([np.zeros(3), x])[: len(x)]
        smooth = np.correlate(np.concatenate([np.full(2, x[0]), x]), [0.25, 0.5, 0.25], "valid")
        slow, state = [], smooth[0]
        for v in smooth:
            state += 0.3 * (v - state)
            slow.append(state)
        n = min(len(x), len(y))
        out = 0.5 * late[:n] + 2.0 * np.array(slow)[:n] - y[:n]
        for name, z, count, stride in (("each", out, 1, 1), ("frames", 10 * out, 8, 3), ("sparse", late, 2, 7)):
            want |= {(c, name, f): z[f * stride : f * stride + count] for f in range(len(z)) if f * stride + count <= len(z)}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_graph_that_cannot_be():
    with pytest.raises(ValueError):
        graph.Graph().mix("m", {"x": 1.0})
    with pytest.raises(ValueError):
        graph.Graph().source("x", "a").source("x", "b")
    with pytest.raises(ValueError):
        graph.Graph().source("x", "a").reader("r", "x", 0)


@pytest.mark.parametrize("cuts", [[], [3, 70, 71, 400]])
def test_overlap_add_as_in_batch(spark, tmp_path, cuts):
    ship(spark)
    rng = np.random.default_rng(1)
    rows = sorted(((("", t, i, float(v)) for t, n in (("a", 300), ("b", 64), ("c", 10)) for i, v in enumerate(rng.normal(size=n)))), key=lambda r: r[2])
    response = lambda n: spectral.band_pass(n, 1, 6)
    stream = live.read_live(spark, folder(spark, tmp_path, rows, cuts), SCHEMA, files=1)
    got = run(spark, tmp_path, graph.overlap_added(stream, 32, response), "o").select("trace", "frame", F.posexplode("samples").alias("place", "v")).collect()
    got = {(r["trace"], r["frame"] * 16 + r["place"]): r["v"] for r in got}
    batch = spectral.overlap_added(spark.createDataFrame(rows, SCHEMA).drop("channel"), 32, response)
    want = {(r["trace"], r["idx"]): r["out"] for r in batch.collect()}
    assert got.keys() == {(t, i) for t, n in (("a", 300), ("b", 64), ("c", 10)) for i in range(max(n // 16 - 1, 0) * 16)}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_signals_do_not_depend_on_cuts():
    for kind in ("tone", "noise"):
        whole = livesource.signal(kind, 0, 20_000, 50.0, 8000.0, 7)
        parts = [livesource.signal(kind, a, b, 50.0, 8000.0, 7) for a, b in zip([0, 1, 4096, 9999], [1, 4096, 9999, 20_000])]
        assert np.array_equal(np.concatenate(parts), whole) and len(livesource.signal(kind, 5, 5, 1, 1, 0)) == 0


def test_live_signal_goes_on(spark, tmp_path):
    livesource.register(spark)
    options = {"kind": "noise", "sps": "1000", "seed": "3", "run": "700"}
    for count in ("1500", "5000"):
        run(spark, tmp_path, spark.readStream.format("live").options(**options, count=count).load(), "s")
    got = spark.read.parquet(str(tmp_path / "s-out")).orderBy("idx").toPandas()
    assert got["idx"].tolist() == list(range(5000)) and np.array_equal(got["value"].to_numpy(), livesource.signal("noise", 0, 5000, 1.0, 1000.0, 3))


def test_live_signal_keeps_to_the_clock(monkeypatch):
    reader = livesource.LiveReader({"kind": "tone", "sps": "100", "origin": "1000"}, None)
    monkeypatch.setattr(livesource.time, "time", lambda: 1002.505)
    assert reader.latestOffset() == {"row": 250} and reader.initialOffset() == {"row": 0}
    monkeypatch.setattr(livesource.time, "time", lambda: 900.0)
    assert reader.latestOffset() == {"row": 0}
    for bad in ({"kind": "x"}, {"kind": "table"}, {"kind": "tone", "path": "p"}):
        with pytest.raises(ValueError):
            livesource.LiveReader(bad, None)


def test_live_table_over_files(spark, tmp_path):
    livesource.register(spark)
    rows = [(i, f"t{i % 3}", i / 8) for i in range(1000)]
    for k in range(3):
        spark.createDataFrame(rows[k * 300 : 300 * k + (400 if k == 2 else 300)], "id long, trace string, value double").coalesce(1).write.option("parquet.block.size", 2000).parquet(str(tmp_path / f"table/part{k}"))
    stream = lambda count: spark.readStream.format("live").schema("id bigint, value double").options(kind="table", path=str(tmp_path / "table"), sps="1e9", run="130", count=count).load()
    for count in ("1", "301", "650", "99999"):
        run(spark, tmp_path, stream(count), "t")
    got = spark.read.parquet(str(tmp_path / "t-out")).collect()
    assert sorted(map(tuple, got)) == [(i, v) for i, _, v in rows]


@pytest.mark.parametrize("run_of", [1, 7, 1000])
def test_wav_by_byte_ranges(spark, tmp_path, run_of):
    import struct

    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2, 50))
    (tmp_path / "a.wav").write_bytes(files.encode_wav(x, 8000))
    raw24 = b"".join(struct.pack("<i", int(v * (1 << 23)))[:3] for v in x[0])
    chunk = b"LIST" + struct.pack("<I", 3) + b"abc\0"  # an odd chunk ahead of the samples is padded
    (tmp_path / "b.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 100, 300, 3, 24) + chunk + b"data" + struct.pack("<I", len(raw24) + 30) + raw24)
    (tmp_path / "c.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 100, 400, 4, 32) + b"data" + struct.pack("<I", 200) + x[1].astype("<f4").tobytes())
    got = rawsource.read_samples(spark, str(tmp_path), "wav", frames=run_of).toPandas()
    want = {"a.wav:0": np.trunc(x[0] * 32767) / 32767, "a.wav:1": np.trunc(x[1] * 32767) / 32767, "b.wav:0": np.trunc(x[0] * (1 << 23)) / (1 << 23), "c.wav:0": x[1].astype("<f4")}
    assert {t.rsplit("/", 1)[1] for t in got["trace"]} == set(want)
    for t, g in got.groupby("trace"):
        g = g.sort_values("idx")
        assert g["idx"].tolist() == list(range(50)) and np.allclose(g["value"], want[t.rsplit("/", 1)[1]], atol=1e-12)
    assert set(got["sps"]) == {8000.0, 100.0}
    whole = files.read_wav(spark, f"file:{tmp_path}/a.wav").toPandas()
    assert np.array_equal(whole[whole.trace.str.endswith(":1")].sort_values("idx")["value"], got[got.trace.str.endswith("a.wav:1")].sort_values("idx")["value"])


def test_raw_files_and_what_is_no_file(spark, tmp_path):
    rows = [("a", i, float(i * 300 - 20_000)) for i in range(200)] + [("b/c", 0, 7.9)]
    s = spark.createDataFrame(rows, "trace string, idx long, value double").repartition(4)
    rawsource.write_samples(s, str(tmp_path / "raw"), "i16")
    (tmp_path / "raw" / "part-00000-left.i16").write_bytes(b"\1\0" * 9)  # what a task left that didn't count
    got = sorted(map(tuple, rawsource.read_samples(spark, str(tmp_path / "raw"), "i16", frames=13, sps=50).collect()))
    assert got == sorted((t, i, float(np.clip(np.trunc(v), -32768, 32767)), 50.0) for t, i, v in rows)
    (tmp_path / "two.u8").write_bytes(bytes(range(10)))
    assert [r["value"] for r in rawsource.read_samples(spark, str(tmp_path / "two.u8"), "u8", channels=2).where("trace LIKE '%:1'").orderBy("idx").collect()] == [1.0, 3.0, 5.0, 7.0, 9.0]
    for bad in ({"path": "x", "kind": "mp3"}, {"path": "x", "frames": "0"}):
        with pytest.raises(ValueError):
            rawsource.SampleReader(bad)
    (tmp_path / "no.wav").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        rawsource.SampleReader({"path": str(tmp_path / "no.wav")}).layouts()
    rawsource.write_samples(s.limit(0), str(tmp_path / "none"))
    assert rawsource.read_samples(spark, str(tmp_path / "none")).collect() == []


def test_idle_traces_end(spark, tmp_path):
    ship(spark)
    schema = "trace string, ts timestamp, value double"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[("a", 0, 1.0), ("b", 5, 2.0), ("a", 3, 3.0)], [("b", 100, 4.0), ("b", 90, 9.0)], [("a", 130, 5.0)], [("c", 1000, 6.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(t, at(s), v) for t, s, v in rows], "trace string, at string, value double").selectExpr("trace", "cast(at AS timestamp) AS ts", "value").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        time.sleep(0.05)
    stream = live.read_live(spark, str(tmp_path / "part*"), schema, files=1)
    live.run_updates(live.expiring(stream, 2, 60.0), ["trace"], str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("batch", "trace", "place").collect()
    ended = [(r["trace"], r["value"]) for r in rows if r["over"]]
    # Both end, begin anew, and end again when c is heard long after; c is alive at the end.
    assert sorted(ended) == [("a", 1.0), ("a", 3.0), ("a", 5.0), ("b", 2.0), ("b", 4.0), ("b", 9.0)]
    assert [r["value"] for r in rows if r["trace"] == "c" and not r["over"]] == [6.0]


def test_online_fit(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 2)), np.zeros(300)
    y = x @ [2.0, -3.0] + 0.1 * rng.normal(size=300)
    rows = [("t", i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))] + [("flat", i, 1.0, 2.0, 3.0) for i in range(20)] + [("t", 300, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "trace string, idx long, a double, b double, y double")
    got = {(r["trace"], r["block"]): r for r in sequential.online_fit(df, ["a", "b"], "y", 64).collect()}
    for k in range(5):
        n = min(300, 64 * (k + 1))
        assert got["t", k]["n"] == n and np.allclose(got["t", k]["weights"], np.linalg.lstsq(x[:n], y[:n], rcond=None)[0], atol=1e-9)
    assert got["flat", 0]["weights"] is None and len(got) == 6


def test_short_runs_share_a_task(spark, tmp_path):
    """A thousand runs of ten frames aren't a thousand tasks."""
    (tmp_path / "x.raw").write_bytes(np.arange(10_000, dtype="<f8").tobytes())
    got = rawsource.read_samples(spark, str(tmp_path), "f64", frames=10)
    assert got.rdd.getNumPartitions() < 10
    assert sorted((r["idx"], r["value"]) for r in got.collect()) == [(i, float(i)) for i in range(10_000)]


def test_batches_are_advanced_in_pieces(spark, tmp_path):
    """Of a trace's batch a few samples at a time, whatever its size, in order and with the state carried on."""
    rows = [("a", (i * 37) % 100, float((i * 37) % 100)) for i in range(100)]
    spark.createDataFrame(rows, "trace string, idx long, value double").coalesce(1).write.parquet(f"{tmp_path}/in")

    def total(state, x):
        assert len(x) <= 8
        out = np.cumsum(x) + (state[0] if state else 0.0)
        return out, [float(out[-1])]

    stream = live.read_live(spark, f"{tmp_path}/in", "trace string, idx long, value double")
    live.run(live.recursive(stream, total, 8), "append", f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r["idx"], r["out"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(i, i * (i + 1) / 2) for i in range(100)]
