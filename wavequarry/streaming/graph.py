"""Filter graphs on live data: sources, filters and mixers that feed each other, compiled into one streaming query.

A graph is made once and runs for every channel: a channel's traces are its sources, each with its own pace. Nodes pass on what
they have; a mixer waits for the slowest of its inputs. Readers take frames of a node's output at a stride of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequential import rc
from ..operators.spectral import window_value

#: What a node does with equally many samples of each input and its state ([] at first): its output and the state after.
Step = Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Node:
    name: str
    inputs: list[str]
    step: Step
    #: Samples are taken by so many.
    by: int = 1
    #: For a source: the trace it hears.
    trace: str | None = None


@dataclass
class Graph:
    """Nodes in an order in which each comes after its inputs, and readers: name to node, samples a frame, stride."""

    nodes: dict[str, Node] = field(default_factory=dict)
    readers: dict[str, tuple[str, int, int]] = field(default_factory=dict)

    def _add(self, node: Node) -> Graph:
        if node.name in self.nodes or not all(i in self.nodes for i in node.inputs):
            raise ValueError(f"node {node.name} is there already or comes before an input")
        self.nodes[node.name] = node
        return self

    def source(self, name: str, trace: str) -> Graph:
        return self._add(Node(name, [], lambda xs, state: (xs[0], state), trace=trace))

    def mix(self, name: str, gains: dict[str, float]) -> Graph:
        """The sum of nodes times gains, sample by sample."""
        g = list(gains.values())
        return self._add(Node(name, list(gains), lambda xs, state: (sum(w * x for w, x in zip(g, xs, strict=True)), state)))

    def gain(self, name: str, of: str, by: float) -> Graph:
        return self.mix(name, {of: by})

    def delay(self, name: str, of: str, n: int) -> Graph:
        """n samples later; 0 at first."""

        def step(xs, state):
            x = np.concatenate([state if len(state) else np.zeros(n), xs[0]])
            return x[: len(xs[0])], x[len(xs[0]) :]

        return self._add(Node(name, [of], step))

    def fir(self, name: str, of: str, taps: list[float]) -> Graph:
        """The sum of taps times the last samples, the oldest first; before the first sample there was nothing else."""
        h = np.asarray(taps, float)

        def step(xs, state):
            x = np.concatenate([state if len(state) else np.full(len(h) - 1, xs[0][0]), xs[0]])
            return np.correlate(x, h, "valid"), x[len(x) - len(h) + 1 :]

        return self._add(Node(name, [of], step))

    def low_pass(self, name: str, of: str, k: float) -> Graph:
        f = rc(k)
        return self._add(Node(name, [of], lambda xs, state: f.apply(xs[0], state if len(state) else f.start(float(xs[0][0])))))

    def overlap_add(self, name: str, of: str, width: int, response: Callable[[int], np.ndarray], kind: str = "RaisedCosine") -> Graph:
        """Frames that overlap by half, windowed, filtered by their spectra, windowed again and added up. A sample comes out when both its frames are full; the first frame begins half a width before the trace."""
        half = width // 2
        shape = np.sqrt(np.maximum(window_value(np.arange(width) / width, kind, np), 0))
        gain = np.zeros(width // 2 + 1)
        r = np.asarray(response(len(gain)), float)[: len(gain)]
        gain[: len(r)] = r

        def step(xs, state):
            # The state: the half frame taken before, and what the last frame adds to the next half. The very first has none.
            first = not len(state)
            before, rest = (np.zeros(half), np.zeros(half)) if first else np.split(state, 2)
            out = []
            for a in range(0, len(xs[0]), half):
                frame = np.concatenate([before, xs[0][a : a + half]])
                y = np.fft.irfft(np.fft.rfft(frame * shape) * gain, width) * shape
                if not first:
                    out.append(rest + y[:half])
                first, rest, before = False, y[half:], frame[half:]
            return np.concatenate(out) if out else np.zeros(0), np.concatenate([before, rest])

        return self._add(Node(name, [of], step, by=half))

    def reader(self, name: str, of: str, count: int = 1, stride: int = 1) -> Graph:
        """Frames of count samples, each stride samples after the one before."""
        if of not in self.nodes or count < 1 or stride < 1:
            raise ValueError(f"reader {name} needs a node, a count and a stride")
        self.readers[name] = (of, count, stride)
        return self


class Running:
    """A graph between two batches: samples that wait before each input and reader, and the state of each node, all in one flat array."""

    def __init__(self, graph: Graph, flat: np.ndarray, lengths: list[int]):
        self.graph = graph
        self.keys = [("wait", n.name, i) for n in graph.nodes.values() for i in n.inputs] + [("state", n, "") for n in graph.nodes] + [("read", r, "") for r in graph.readers]
        parts = np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else [np.zeros(0)] * (2 * len(self.keys))
        self.held = dict(zip(self.keys, parts[: len(self.keys)], strict=True))
        #: Frames read so far, and samples that are still to be skipped before the next one.
        self.passed = {r: parts[len(self.keys)][i * 2 : i * 2 + 2] if len(lengths) else np.zeros(2) for i, r in enumerate(graph.readers)}

    def flat(self) -> tuple[list[float], list[int]]:
        parts = [*self.held.values(), np.concatenate([*self.passed.values(), np.zeros(0)])]
        return np.concatenate(parts).tolist(), [len(p) for p in parts]

    def feed(self, heard: dict[str, np.ndarray]) -> Iterator[tuple[str, int, np.ndarray]]:
        """New samples of the traces, in order; (reader, frame, samples) of all frames that they complete."""
        made: dict[str, np.ndarray] = {}
        for node in self.graph.nodes.values():
            if node.trace is not None:
                made[node.name] = heard.get(node.trace, np.zeros(0))
                continue
            for i in node.inputs:
                self.held["wait", node.name, i] = np.concatenate([self.held["wait", node.name, i], made[i]])
            waits = [self.held["wait", node.name, i] for i in node.inputs]
            n = min(map(len, waits)) // node.by * node.by
            made[node.name] = np.zeros(0)
            if n:
                made[node.name], self.held["state", node.name, ""] = node.step([w[:n] for w in waits], self.held["state", node.name, ""])
                for i, w in zip(node.inputs, waits, strict=True):
                    self.held["wait", node.name, i] = w[n:]
        for name, (of, count, stride) in self.graph.readers.items():
            x = np.concatenate([self.held["read", name, ""], made[of]])
            number, skip = map(int, self.passed[name])
            while len(x) >= skip + count:
                yield name, number, x[skip : skip + count]
                number, skip = number + 1, skip + stride
            self.held["read", name, ""], self.passed[name] = x[min(skip, len(x)) :], np.array([number, skip - min(skip, len(x))], float)


def compiled(stream: DataFrame, graph: Graph, channel: str = "channel") -> DataFrame:
    """channel, reader, frame, samples: all frames that the readers get, from a stream of (channel, trace, idx, value), appended as they are full.

    A trace's samples come in the order of idx from batch to batch, in any order within one. Results don't depend on how samples
    are dealt over batches. A channel's state is what its inputs are apart in pace, the filters' own states and less than a frame
    for each reader; channels run on all tasks, one channel's batch is sorted in one.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, lengths = (np.array(state.get[0], float), list(state.get[1])) if state.exists else (np.zeros(0), [])
        running = Running(graph, flat, lengths)
        rows = [f for f in frames if len(f)]
        batch = pd.concat(rows).sort_values("idx", kind="stable")
        heard = {t: g["value"].to_numpy(float) for t, g in batch.groupby("trace")}
        got = list(running.feed(heard))
        state.update(running.flat())
        yield pd.DataFrame({"channel": pd.Series([key[0]] * len(got), dtype=object), "reader": pd.Series([r for r, _, _ in got], dtype=object), "frame": pd.Series([n for _, n, _ in got], dtype="int64"), "samples": pd.Series([x.tolist() for _, _, x in got], dtype=object)})

    traces = [n.trace for n in graph.nodes.values() if n.trace is not None]
    some = stream.where(stream["trace"].isin(traces)).select(stream[channel].cast("string").alias("channel"), "trace", "idx", "value")
    return some.groupBy("channel").applyInPandasWithState(step, "channel string, reader string, frame long, samples array<double>", "flat array<double>, lengths array<bigint>", "append", GroupStateTimeout.NoTimeout)


def overlap_added(stream: DataFrame, width: int, response: Callable[[int], np.ndarray], kind: str = "RaisedCosine") -> DataFrame:
    """trace, frame, samples: each trace of a stream (trace, idx, value) filtered in overlapping frames, half a width at a time, as operators.spectral.overlap_added does it for whole traces."""
    graph = Graph().source("in", "all").overlap_add("out", "in", width, response, kind).reader("out", "out", width // 2, width // 2)
    from pyspark.sql import functions as F

    one = stream.select(F.col("trace").alias("channel"), F.lit("all").alias("trace"), "idx", "value")
    return compiled(one, graph).select(F.col("channel").alias("trace"), "frame", "samples")
