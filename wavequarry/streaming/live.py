"""Live traces with Structured Streaming: bounded history, peak hold, mixing and recursive filters.

Samples are ordered by idx, not by event time, so there are no watermarks: state is bounded by the length that is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_live(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def run(df: DataFrame, mode: str, out: str, checkpoint: str) -> None:
    """Run a stream over what is there, and end."""
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_updates(df: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Run a stream of updates over what is there; out gets each batch's rows with the batch's number."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("u")).select(*keys, "u.*")


def peak_hold(stream: DataFrame) -> DataFrame:
    """Least and greatest value at each idx of a trace so far (update mode)."""
    return stream.groupBy("trace", "idx").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def mixed(stream: DataFrame, gains: dict[str, float]) -> DataFrame:
    """Sum of traces times gains at each idx, and how many of them have come (update mode)."""
    gain = F.coalesce(*[F.when(F.col("trace") == t, float(g)) for t, g in gains.items()])
    return stream.where(F.col("trace").isin(list(gains))).groupBy("idx").agg(F.sum(F.col("value") * gain).alias("value"), F.count("*").alias("sources"))


def last_samples(stream: DataFrame, length: int, underflow: str = "First") -> DataFrame:
    """The last `length` samples of each trace after each batch: trace, place (0 is the oldest), value.

    While a trace has had fewer: First counts as if its first sample had filled it, Zeros fills with 0 on the left, Available
    gives those there are, Null nothing. A batch is read frame by frame, and no more than length samples are kept of it.
    """
    if underflow not in ("First", "Zeros", "Available", "Null"):
        raise ValueError(f"no underflow {underflow}")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = np.array(state.get[0]) if state.exists else np.zeros(0)
        idx, x, head = np.zeros(0), np.zeros(0), None
        for f in frames:
            if len(f):
                first = f["idx"].to_numpy().argmin()
                head = min([h for h in (head, (f["idx"].iloc[first], f["value"].iloc[first])) if h is not None])
                idx, x = np.concatenate([idx, f["idx"].to_numpy()]), np.concatenate([x, f["value"].to_numpy()])
                order = np.argsort(idx, kind="stable")[-length:]
                idx, x = idx[order], x[order]
        if underflow == "First" and not len(ring):
            ring = np.full(length, head[1])
        ring = np.concatenate([ring, x])[-length:]
        state.update((ring.tolist(),))
        if underflow == "Zeros":
            ring = np.concatenate([np.zeros(length - len(ring)), ring])
        if underflow == "Null" and len(ring) < length:
            ring = ring[:0]
        yield pd.DataFrame({"trace": pd.Series([key[0]] * len(ring), dtype=object), "place": np.arange(len(ring)), "value": ring})

    return stream.groupBy("trace").applyInPandasWithState(step, "trace string, place long, value double", "ring array<double>", "update", GroupStateTimeout.NoTimeout)


def recent(stream: DataFrame, age: float) -> DataFrame:
    """The samples of each trace that are at most age seconds older than its latest, after each batch: trace, place, t, value. State grows with a trace's rate times age."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, x = (np.array(v) for v in state.get) if state.exists else (np.zeros(0), np.zeros(0))
        for f in frames:
            t, x = np.concatenate([t, f["t"].to_numpy()]), np.concatenate([x, f["value"].to_numpy()])
            kept = t >= t.max() - age if len(t) else np.zeros(0, bool)
            t, x = t[kept], x[kept]
        order = np.lexsort((x, t))
        t, x = t[order], x[order]
        state.update((t.tolist(), x.tolist()))
        yield pd.DataFrame({"trace": pd.Series([key[0]] * len(t), dtype=object), "place": np.arange(len(t)), "t": t, "value": x})

    return stream.groupBy("trace").applyInPandasWithState(step, "trace string, place long, t double, value double", "t array<double>, value array<double>", "update", GroupStateTimeout.NoTimeout)


def expiring(stream: DataFrame, length: int, idle: float) -> DataFrame:
    """The last `length` samples of live traces, which end when they have been idle: trace, place (0 is the oldest), ts, value, over.

    stream has trace, ts and value. After each batch a trace shows what it holds. Once the latest time heard of any trace is
    `idle` seconds past a trace's own latest, it is shown a last time, with over, and its state is dropped; samples that come
    later begin it anew, also where both come in one batch, which is sorted a trace. So state is bounded by the traces that are
    alive, however many there have been.
    """

    def shown(name: str, t: np.ndarray, x: np.ndarray, place: np.ndarray, over: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"trace": pd.Series([name] * len(t), dtype=object), "place": place, "us": t.astype(np.int64), "value": x, "over": over})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, x = (np.array(v) for v in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        if state.hasTimedOut:
            state.remove()
            yield shown(key[0], t, x, np.arange(len(t)), np.full(len(t), True))
            return
        more = [f for f in frames if len(f)]
        t, x = np.concatenate([t, *[f["us"].to_numpy() for f in more]]), np.concatenate([x, *[f["value"].to_numpy() for f in more]])
        order = np.lexsort((x, t))
        t, x = t[order], x[order]
        begins = np.concatenate([[0], np.flatnonzero(np.diff(t) > idle * 1e6) + 1])  # idle between two batches, or within one
        sizes = np.diff([*begins, len(t)])
        # All lives that the batch shows are one frame: a frame each takes far longer than the samples.
        place = np.arange(len(t)) - np.repeat(begins + np.maximum(sizes - length, 0), sizes)
        kept = place >= 0
        t, x, place, last = t[kept], x[kept], place[kept], np.arange(len(kept))[kept] >= begins[-1]
        state.update((t[last].tolist(), x[last].tolist()))
        state.setTimeoutTimestamp(max(int(t[-1]) // 1000 + int(idle * 1000), state.getCurrentWatermarkMs() + 1))
        yield shown(key[0], t, x, place, ~last)

    heard = stream.select("trace", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", "0 seconds").withColumn("us", F.unix_micros("ts"))
    rows = heard.groupBy("trace").applyInPandasWithState(step, "trace string, place long, us long, value double, over boolean", "us array<bigint>, value array<double>", "update", GroupStateTimeout.EventTimeTimeout)
    return rows.select("trace", "place", F.timestamp_micros("us").alias("ts"), "value", "over")


#: Samples of a batch that recursive() advances by at a time.
CHUNK = 1 << 16


def recursive(stream: DataFrame, advance: Callable[[list[float], np.ndarray], tuple[np.ndarray, list[float]]], chunk: int = CHUNK) -> DataFrame:
    """A filter that goes on from batch to batch: advance(state, values) returns the outputs and the new state; the state is [] at first.

    Of a batch, a trace's places and values alone are held, as numbers; they are sorted once and advanced by `chunk` at a time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(f["idx"].to_numpy(np.int64, copy=True), f["value"].to_numpy(np.float64, copy=True)) for f in frames]
        idx, x = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        del parts
        order = np.argsort(idx, kind="stable")
        at = list(state.get[0]) if state.exists else []
        for a in range(0, len(order), chunk):
            some = order[a : a + chunk]
            out, at = advance(list(at), x[some])
            yield pd.DataFrame({"trace": key[0], "idx": idx[some], "value": x[some], "out": out})
        state.update(([float(v) for v in at],))

    return stream.groupBy("trace").applyInPandasWithState(step, "trace string, idx long, value double, out double", "state array<double>", "append", GroupStateTimeout.NoTimeout)


def low_pass(k: float) -> Callable[[list[float], np.ndarray], tuple[np.ndarray, list[float]]]:
    """A first-order low pass for recursive()."""
    from ..operators.sequential import rc

    def advance(state: list[float], x: np.ndarray) -> tuple[np.ndarray, list[float]]:
        out, after = rc(k).apply(x, np.array(state or [x[0]]))
        return out, after.tolist()

    return advance
