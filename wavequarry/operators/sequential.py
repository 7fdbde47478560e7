"""Filters that depend on their own output.

Linear ones (RC, CR, exponential average, IIR) run block by block on all tasks: the state that a block starts with is worked out
from the blocks' own ends. Others run in one stream a trace, sorted, in batches: memory is bounded, but one trace is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..model import BLOCK, blocks
from ..session import few, written


def sequential(s: DataFrame, inputs: list[str], kernel: Callable[[], Callable], width: int = 0) -> DataFrame:
    """Adds out: what a kernel, made anew for each trace, returns for the input columns' batches in the order of idx.

    A kernel takes as many arrays as there are inputs and returns as many values (arrays of `width` values, if given).
    """
    schema = StructType([*s.schema.fields, StructField("out", ArrayType(DoubleType()) if width else DoubleType())])
    at = [s.columns.index(c) for c in inputs]
    trace = s.columns.index("trace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            names = np.array(batch.column(trace).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            out: list = []
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if step is None or names[a] != last:
                        step, last = kernel(), names[a]
                    out.extend(step(*[batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in at]))
            kind = pa.list_(pa.float64()) if width else pa.float64()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "out"])

    return s.repartition("trace").sortWithinPartitions("trace", "idx").mapInArrow(run, schema)


class Linear:
    """A linear filter by its state: s' = A s + B x, y = C s + D x. start(x) is the state before the first sample x.

    apply() works on chunks of samples by matrix products; only the chunks' states are a loop.
    """

    CHUNK = 64

    def __init__(self, a, b, c, d: float, start: Callable[[float], np.ndarray]):
        self.a, self.b, self.c, self.d, self.start = np.atleast_2d(a).astype(float), np.asarray(b, float), np.asarray(c, float), float(d), start

    def apply(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, m = self.CHUNK, len(self.b)
        powers = [np.eye(m)]
        for _ in range(k):
            powers.append(self.a @ powers[-1])
        out = np.empty(len(x))
        whole = len(x) // k
        if whole:
            u = x[: whole * k].reshape(whole, k)
            observe = np.stack([self.c @ p for p in powers[:k]])
            response = np.array([self.d, *[self.c @ p @ self.b for p in powers[: k - 1]]])
            lag = np.arange(k)[:, None] - np.arange(k)[None, :]
            toeplitz = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
            drive = u @ np.stack([powers[k - 1 - j] @ self.b for j in range(k)])
            states = np.empty((whole, m))
            for i in range(whole):
                states[i] = state
                state = powers[k] @ state + drive[i]
            out[: whole * k] = (u @ toeplitz.T + states @ observe.T).ravel()
        for i in range(whole * k, len(x)):
            out[i] = self.c @ state + self.d * x[i]
            state = self.a @ state + self.b * x[i]
        return out, state


def linear_filter(s: DataFrame, f: Linear, size: int = BLOCK) -> DataFrame:
    """Adds out. Pass 1: the state each block ends with from a start of zero. Then the true starts, over one row a block. Pass 2: the blocks' outputs."""
    rows = blocks(s.select("trace", "idx", "value"), size=size)
    zero = np.zeros(len(f.b))

    def end(t: pa.Table) -> pa.Table:
        x = t.sort_by("idx")["value"].to_numpy()
        state = f.apply(x, zero)[1]
        return pa.table({"trace": t["trace"][:1], "idx": t["block"][:1], "n": pa.array([len(x)]), "first": pa.array(x[:1]), "end": pa.array([state.tolist()], pa.list_(pa.float64()))})

    ends = rows.groupBy("trace", "block").applyInArrow(end, "trace string, idx long, n long, first double, end array<double>")

    class Carry:
        """The state before each block."""

        def __init__(self):
            self.state = None

        def __call__(self, n, first, end):
            out = []
            for k, x, e in zip(n, first, end, strict=True):
                self.state = f.start(float(x)) if self.state is None else self.state
                out.append(np.asarray(self.state).tolist())
                self.state = np.linalg.matrix_power(f.a, int(k)) @ self.state + np.asarray(e)
            return out

    starts = sequential(ends, ["n", "first", "end"], Carry, width=len(f.b)).select("trace", F.col("idx").alias("block"), F.col("out").alias("state"))
    starts = written(starts, "linear_starts")  # else the first pass would run again with the second

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        y, _ = f.apply(t["value"].to_numpy(), np.array(t["state"][0].as_py()))
        return pa.table({"trace": t["trace"], "idx": t["idx"], "value": t["value"], "out": pa.array(y)})

    joined = rows.join(F.broadcast(starts) if few(starts) else starts, ["trace", "block"])
    return joined.groupBy("trace", "block").applyInArrow(run, "trace string, idx long, value double, out double")


def rc_coefficient(sample_rate: float, tau: float) -> float:
    return 1.0 - float(np.exp(-(1.0 / sample_rate) / tau))


def rc(k: float) -> Linear:
    """First-order low pass that starts at the first sample: the charge moves by k of its distance to the value."""
    return Linear([[1 - k]], [k], [1 - k], k, lambda x: np.array([x]))


def cr(k: float) -> Linear:
    """The value less its low pass."""
    return Linear([[1 - k]], [k], [k - 1], 1 - k, lambda x: np.array([x]))


def rolling_average(factor: int, from_first: bool = False) -> Linear:
    """(before * (factor - 1) + value) / factor, from 0 or from the first value."""
    k = 1.0 / factor
    return Linear([[1 - k]], [k], [1 - k], k, lambda x: np.array([x if from_first else 0.0]))


#: The band-pass Bessel filter of order 4, 0.005 to 0.1 of the sample rate: its gain, and for each of four
#: sections the two feedback coefficients and the sign of the middle of the (1, +-2, 1) feed-forward part.
BESSEL_GAIN = 0.01246290306810692
BESSEL_SECTIONS = [
    (0.8118613868727053, -0.3485608720964022, -2.0),
    (1.975109662186309, -0.9755239831148942, -2.0),
    (0.8081439997942344, -0.180081736339935, 2.0),
    (1.955443627026533, -0.9559883728141037, 2.0),
]


def sections(gain: float, parts: list[tuple[float, float, float]]) -> Linear:
    """A chain of second-order sections w = x + p w1 + q w2, y = w + m w1 + w2, from rest, as one linear filter."""
    n = 2 * len(parts)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), gain
    for i, (p, q, m) in enumerate(parts):  # c and d give the section's input from the state and x
        w_state, w_x = c.copy(), d
        w_state[2 * i] += p
        w_state[2 * i + 1] += q
        a[2 * i], b[2 * i] = w_state, w_x
        a[2 * i + 1, 2 * i] = 1
        c, d = w_state.copy(), w_x
        c[2 * i] += m
        c[2 * i + 1] += 1
    return Linear(a, b, c, d, lambda x: np.zeros(n))


def bessel_band_pass() -> Linear:
    return sections(BESSEL_GAIN, BESSEL_SECTIONS)


class Rc:
    """RC with a limit on how far a step can be, which makes it non-linear; drc: never below the value."""

    def __init__(self, k: float, limit: float = 0.0, drc: bool = False):
        self.k, self.limit, self.drc, self.charge = k, limit, drc, None

    def __call__(self, x):
        out = []
        for v in x.tolist():
            self.charge = v if self.charge is None else self.charge
            d = v - self.charge
            d = max(-self.limit, min(self.limit, d)) if self.limit > 0 else d
            self.charge += d * self.k
            self.charge = max(v, self.charge) if self.drc else self.charge
            out.append(self.charge)
        return out


def decayed_max(x: np.ndarray, decay: float, start: float) -> np.ndarray:
    """y[i] = max(x[i], decay * y[i - 1]) from a start before the first: steps over 1, 2, 4... places, as the greatest of decayed values doesn't depend on the order."""
    y, d = np.concatenate([[start], x]), 1
    while d < len(y) and decay**d > 0:
        y[d:] = np.maximum(y[d:], decay**d * y[:-d])
        d *= 2
    return y[1:]


def drc(s: DataFrame, k: float, size: int = BLOCK) -> DataFrame:
    """Adds out: an envelope that follows the value at once upwards and as the low pass rc(k) downwards.

    Its distance from the low pass is the greatest of the value's own distances, each decayed by 1 - k a sample. So both run by
    blocks: a block's greatest decayed distance at its end, the same over one row a block, then the blocks' outputs.
    """
    low = linear_filter(s, rc(k), size).select("trace", "idx", F.col("value").alias("v"), F.col("out").alias("low"))
    low = written(low, "envelope_low")
    rows = blocks(low.withColumn("d", F.col("v") - F.col("low")), size=size)
    decay = 1.0 - k

    def end(t: pa.Table) -> pa.Table:
        x = t.sort_by("idx")["d"].to_numpy()
        return pa.table({"trace": t["trace"][:1], "idx": t["block"][:1], "n": pa.array([len(x)]), "end": pa.array([float(decayed_max(x, decay, -np.inf)[-1])])})

    ends = rows.groupBy("trace", "block").applyInArrow(end, "trace string, idx long, n long, end double")

    class Carry:
        """The distance before each block."""

        def __init__(self):
            self.state = -np.inf

        def __call__(self, n, end):
            out = []
            for m, e in zip(n, end, strict=True):
                out.append(float(self.state))
                self.state = max(float(e), decay ** int(m) * self.state if self.state > -np.inf else -np.inf)
            return out

    starts = sequential(ends, ["n", "end"], Carry).select("trace", F.col("idx").alias("block"), F.col("out").alias("state"))
    starts = written(starts, "envelope_starts")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        y = decayed_max(t["d"].to_numpy(), decay, t["state"][0].as_py())
        return pa.table({"trace": t["trace"], "idx": t["idx"], "value": t["v"], "out": pa.array(t["low"].to_numpy() + y)})

    joined = rows.join(F.broadcast(starts) if few(starts) else starts, ["trace", "block"])
    return joined.groupBy("trace", "block").applyInArrow(run, "trace string, idx long, value double, out double")


class Adaptive:
    """Taps over the last values, oldest first, all equal to the first value at the start."""

    def __init__(self, taps: int):
        self.weights, self.history = np.zeros(taps), None

    def insert(self, x: float) -> float:
        self.history = np.full(len(self.weights), x) if self.history is None else np.append(self.history[1:], x)
        return float(self.weights @ self.history)


class Nlms(Adaptive):
    """Normalised least mean squares towards a wanted signal."""

    def __init__(self, taps: int, mu: float | None = None, alpha: float = 1.0):
        super().__init__(taps)
        self.mu, self.alpha, self.sigma = 5e-5 * taps if mu is None else mu, alpha, 2.0

    def __call__(self, x, wanted):
        out = []
        for v, d in zip(x.tolist(), wanted.tolist(), strict=True):
            y = self.insert(v)
            power = float(self.history @ self.history)
            self.sigma = self.alpha * power + (1 - self.alpha) * self.sigma + 1e-7
            self.weights = self.weights + self.mu * (d - y) / self.sigma * self.history
            out.append(y)
        return out


class Rls(Adaptive):
    """Recursive least squares with forgetting towards a wanted signal."""

    def __init__(self, taps: int, forget: float = 1.0, delta: float = 0.005):
        super().__init__(taps)
        self.r, self.p = 1 / forget, np.eye(taps) / delta

    def __call__(self, x, wanted):
        out = []
        for v, d in zip(x.tolist(), wanted.tolist(), strict=True):
            y = self.insert(v)
            px = self.p @ self.history
            g = self.r * px / (1 + self.r * self.history @ px)
            self.p = self.r * (self.p - np.outer(g, self.history @ self.p))
            self.weights = self.weights + g * (d - y)
            out.append(y)
        return out


class Kalman:
    """Position and velocity in 1 to 3 dimensions; returns the estimated positions."""

    def __init__(self, velocity: list[float], position: list[float], dt: float = 1.0):
        n = len(position)
        one = np.eye(n)
        self.noise = np.diag(velocity)
        self.h = np.kron(one, [[1.0, 0.0]])
        self.phi = np.kron(one, [[1.0, dt], [0.0, 1.0]])
        self.drift = np.kron(np.diag(position), [[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2 / 2]])
        self.x, self.p = np.zeros(2 * n), np.zeros((2 * n, 2 * n))

    def __call__(self, *series):
        out = []
        for z in zip(*[v.tolist() for v in series], strict=True):
            k = self.p @ self.h.T @ np.linalg.inv(self.h @ self.p @ self.h.T + self.noise)
            self.x = self.x + k @ (np.array(z) - self.h @ self.x)
            self.p = self.p - k @ self.h @ self.p
            out.append((self.h @ self.x).tolist())
            self.x = self.phi @ self.x
            self.p = self.phi @ self.p @ self.phi.T + self.drift
        return out


def kalman_ahead(x: np.ndarray, steps: int, dt: float = 1.0) -> np.ndarray:
    """Positions that a state (position, velocity) reaches in the next steps."""
    return x[0] + x[1] * dt * np.arange(1, steps + 1)


class Pid:
    """Controller: proportional, integral (clamped) and derivative (low-passed) parts of target less sensor, the output clamped."""

    def __init__(self, p: float, i: float, d: float, low: float = -1.0, high: float = 1.0, smooth: float = 1.0):
        self.k, self.low, self.high, self.smooth = (p, i, d), low, high, smooth
        self.sum, self.last, self.slope = 0.0, None, 0.0

    def __call__(self, sensor, target):
        out = []
        for s, t in zip(sensor.tolist(), target.tolist(), strict=True):
            e = t - s
            self.sum = min(self.high, max(self.low, self.sum + self.k[1] * e))
            self.slope += self.smooth * ((0.0 if self.last is None else e - self.last) - self.slope)
            self.last = e
            out.append(min(self.high, max(self.low, self.k[0] * e + self.sum + self.k[2] * self.slope)))
        return out


class EchoCancel(Nlms):
    """What is left of the near signal when the far signal's echo, as NLMS learns it, is taken away; it learns only while the far signal's power is above a floor and above the near signal's share."""

    def __init__(self, taps: int, mu: float = 0.5, floor: float = 1e-6, double_talk: float = 4.0):
        super().__init__(taps, mu)
        self.floor, self.double_talk, self.near_power = floor, double_talk, 0.0

    def __call__(self, far, near):
        out = []
        for x, d in zip(far.tolist(), near.tolist(), strict=True):
            error = d - self.insert(x)
            power = float(self.history @ self.history) / len(self.history)
            self.near_power += 0.1 * (d * d - self.near_power)
            if power > self.floor and self.near_power < self.double_talk * power:
                self.weights = self.weights + self.mu * error / (power * len(self.history) + 1e-7) * self.history
            out.append(error)
        return out


def solve_lqr(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, steps: int = 1000, close: float = 1e-12) -> np.ndarray:
    """Gain of the linear-quadratic regulator by iterating the Riccati equation; small matrices, on the driver."""
    p = q.copy()
    for _ in range(steps):
        k = np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a)
        nxt = q + a.T @ p @ (a - b @ k)
        if np.abs(nxt - p).max() < close:
            break
        p = nxt
    return np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a)


def online_fit(s: DataFrame, inputs: list[str], target: str, every: int) -> DataFrame:
    """trace, block, n, weights: after each `every` samples, the least-squares weights of the inputs for the target over all samples so far.

    Sums of products are made a block of samples, added up over one row a block, and each row is one small system of equations;
    weights are null while it has no single solution. Rows with a null input or target don't count.
    """
    k = len(inputs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    known = s.dropna(subset=[*inputs, target]).withColumn("block", F.floor(F.col("idx") / every))
    products = [F.sum(F.col(inputs[i]) * F.col(inputs[j])).alias(f"s{i}_{j}") for i, j in pairs] + [F.sum(F.col(inputs[i]) * F.col(target)).alias(f"t{i}") for i in range(k)]
    sums = written(known.groupBy("trace", "block").agg(F.count("*").alias("n"), *products), "online_sums")
    upto = Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    names = ["n", *[f"s{i}_{j}" for i, j in pairs], *[f"t{i}" for i in range(k)]]
    running = sums.select("trace", "block", *[F.sum(c).over(upto).alias(c) for c in names])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.stack([batch.column(i).to_numpy().astype(float) for i in range(3, batch.num_columns)], axis=1)
            weights: list[list[float] | None] = []
            for row in v:
                a = np.zeros((k, k))
                for (i, j), x in zip(pairs, row):
                    a[i, j] = a[j, i] = x
                scale = np.sqrt(np.maximum(np.diag(a), 1e-300))  # inputs of one size, so that the rank shows
                a = a / scale[:, None] / scale
                regular = np.isfinite(a).all() and np.linalg.matrix_rank(a, tol=1e-12) == k
                weights.append((np.linalg.solve(a, row[len(pairs) :] / scale) / scale).tolist() if regular else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.list_(pa.float64()))], names=["trace", "block", "n", "weights"])

    return running.mapInArrow(solve, "trace string, block long, n long, weights array<double>")
