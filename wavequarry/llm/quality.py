"""Quality classifier: positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

#: Classes of bytes for the shapes: lower-case letters and all of other scripts, upper-case letters, digits, blanks, line ends; every other ASCII sign is a class of its own.
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[128:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[[9, 11, 12, 32]] = 32
SHAPE[[10, 13]] = 10
#: Buckets of hashed shape trigrams, and figures about words and lines.
BUCKETS, FIGURES = 512, 14


def features(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed shape trigrams, then figures about words and lines. The same at any length but for the log of the size."""
    out = np.zeros(BUCKETS + FIGURES, np.float32)
    words = data.split()
    n = len(words)
    if len(data) >= 3:
        s = SHAPE[np.frombuffer(data, np.uint8)]
        h = (s[:-2] * np.uint32(0x9E3779B1) + s[1:-1] * np.uint32(0x85EBCA77) + s[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(23)
        out[:BUCKETS] = np.sqrt(np.bincount(h, minlength=BUCKETS) / len(h))
    if n:
        lines = data.split(b"\n")
        low = data.lower().split()
        chars = sum(map(len, words))
        f = out[BUCKETS:]
        f[0] = np.log1p(n) / 8
        f[1] = len(set(low)) / n
        f[2] = len(set(low)) / n**0.8
        f[3] = sum(map(bytes.__eq__, low, low[1:])) / n
        f[4] = sum(map(bytes.__eq__, low, low[2:])) / n
        f[5] = sum(map(bytes.isupper, words)) / n
        f[6] = sum(map(bytes.isalpha, words)) / n
        f[7] = chars / n / 10
        f[8] = len(set(lines)) / len(lines)
        f[9] = np.log1p(n / len(lines)) / 5
        f[10] = sum(map(bytes.isdigit, words)) / n
        f[11] = len(set(zip(low, low[1:]))) / n
        f[12] = max(map(len, words)) ** 0.5 / 20
    out[-1] = 1
    return out


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Features by mean and spread, one hidden layer, and the logit of being positive."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    prior: float = 0.5

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.spread, -6, 6) @ self.w1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = self.hidden(x)
        return h @ self.w2[:-1] + self.w2[-1]


def risk_step(m: Model, x: np.ndarray, n_pos: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risks of positives and of negatives over rows x, n_pos trusted positives first, and the gradient to step along by w1 and w2.

    Risk with the logistic loss: prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)]). While the part in
    max() is below 0, the step goes the other way along it, so that the model can't drive the risk of negatives below what a
    risk can be.
    """
    x = np.clip((x - m.mean) / m.spread, -6, 6)
    h = np.tanh(x @ m.w1)
    g = h @ m.w2[:-1] + m.w2[-1]
    gp, gu = g[:n_pos], g[n_pos:]
    positive = m.prior * softplus(-gp).mean()
    negative = softplus(gu).mean() - m.prior * softplus(gp).mean()
    d_pos_neg, d_unl_neg = -m.prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
    d = np.concatenate([d_pos_neg - m.prior * sigmoid(-gp) / len(gp), d_unl_neg]) if negative >= 0 else -np.concatenate([d_pos_neg, d_unl_neg])
    return positive, negative, x.T @ (d[:, None] * m.w2[:-1] * (1 - h * h)), np.append(h.T @ d, d.sum())


def train(pos: np.ndarray, unl: np.ndarray, prior: float, *, seed: int, epochs: int = 60, hidden: int = 24, decay: float = 2e-3, rate: float = 4e-3) -> Model:
    """Minimise the non-negative unbiased risk by Adam over mini-batches."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl]).astype(np.float64)
    m = Model(both.mean(0), both.std(0) + 0.02, rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], hidden)), np.zeros(hidden + 1), prior)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (m.w1, m.w2)]
    size = max(1, min(512, len(unl), len(pos)))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(unl))
        for a in range(0, len(unl), size):
            u = unl[order[a : a + size]]
            p = pos[rng.integers(0, len(pos), size)]
            _, _, g1, g2 = risk_step(m, np.concatenate([p, u]), len(p))
            g1, g2 = g1 + decay * m.w1, g2 + decay * np.append(m.w2[:-1], 0)
            if step == 0:
                m.w2[:-1] = rng.normal(0, 0.1, hidden)
            step += 1
            for w, grad, (v1, v2) in ((m.w1, g1, moments[0]), (m.w2, g2, moments[1])):
                v1 += 0.1 * (grad - v1)
                v2 += 0.01 * (grad * grad - v2)
                w -= rate * (v1 / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.99**step)) + 1e-8)
    return m


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least upper bound, over thresholds, of the ratio of both tails' shares.

    Scores of rows the ranking model hasn't seen. Each share gets its one-sided margin of confidence, so that thin tails
    don't win by chance.
    """
    cuts = np.quantile(pos, np.linspace(0, 0.95, 96))
    p = np.array([(pos >= c).mean() for c in cuts])
    u = np.array([(unl >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    best = int(np.argmin((u + margin) / p))
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, *, seed: int = 5) -> Model:
    """Rank with even weights on one half, estimate the prior on the other, then train on all with it. A single row of a kind can't be halved, and the prior is then 0.5. Without rows of either kind nothing is known, and the model's logit is 0 for all."""
    if not len(pos) or not len(unl):
        width = BUCKETS + FIGURES
        return Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(2))
    if min(len(pos), len(unl)) < 2:  # no half to rank with and none to look at
        return train(pos, unl, 0.5, seed=seed)
    rank = train(pos[::2], unl[::2], 0.5, seed=seed, epochs=25)
    prior = estimate_prior(rank.logit(pos[1::2]), rank.logit(unl[1::2]))
    return train(pos, unl, prior, seed=seed)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the bytes in the last column; the columns before it stay."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            x = np.stack([features(t.as_py() or b"") for t in part.columns[-1]])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([v.tobytes() for v in x], pa.binary())], names=[*part.schema.names[:-1], "x"])
    tidy()


def sample(docs: DataFrame, trusted: DataFrame, allowed: Column, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most `most` trusted positives and as many other allowed documents: those of least seeded hash.

    The ids are chosen first from the id columns alone; then only the chosen documents' texts are read into features. The rows
    are limited once more after that, as an id can have any number of them; 2 * most rows of 2 kB reach the driver at most.
    """
    by_hash = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & allowed)
    good = trusted.select("doc_id").distinct()
    chosen = ids.join(good, "doc_id", "left_semi").orderBy(*by_hash).limit(most).withColumn("good", F.lit(True))
    chosen = chosen.unionByName(ids.join(good, "doc_id", "left_anti").orderBy(*by_hash).limit(most).withColumn("good", F.lit(False)))
    rows = docs.join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "good", F.col("text").cast("binary").alias("data"))
    rows = rows.mapInArrow(scan, "doc_id long, good boolean, x binary").withColumn("place", F.row_number().over(Window.partitionBy("good").orderBy(*by_hash, F.xxhash64("x"), "x")))
    rows = rows.where(F.col("place") <= most).drop("place").toPandas().sort_values(["good", "doc_id", "x"])
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]]) if len(rows) else np.zeros((0, BUCKETS + FIGURES), np.float32)
    good_rows = rows["good"].to_numpy(bool) if len(rows) else np.zeros(0, bool)
    rng = np.random.default_rng(seed)
    return rng.permutation(x[good_rows]), rng.permutation(x[~good_rows])


def fit_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", allowed: Column | None = None, most: int = 6000, seed: int = 5) -> Model:
    """A model from trusted positives (labels.quality = 1) and unlabelled texts, both at most `most` rows (a documented bound).

    Only ids for which `allowed` holds (a column over doc_id) are used. Labels of 0 aren't used at all: such texts are
    unlabelled ones like the others. Conflicting or repeated labels: one positive label suffices. Rows of a repeated id count
    each, within the bound. The class prior is estimated from half of both kinds, however few; of a single positive or a single
    unlabelled text there is no half, and the prior is 0.5. Without any positive or any unlabelled text there is nothing to learn: every text that isn't empty
    then scores 0.5.
    """
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
    return fit(*sample(narrow, trusted, F.lit(True) if allowed is None else allowed, most, seed), seed=seed)


def score_quality(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= cut) for every row, by its whole text alone.

    A narrow pass without a shuffle. Null and empty texts have score 0; null ids stay null; repeated rows are scored each;
    empty tables give no rows; other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a in range(0, batch.num_rows, 256):
                texts = [t.as_py() or b"" for t in batch.column(1).slice(a, 256)]
                out[a : a + 256] = sigmoid(model.logit(np.stack([features(t) for t in texts]))) * [bool(t.strip()) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(out), "predicted": pa.array((out >= cut).astype(np.int32))})
        tidy()

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("data"))
    return narrow.mapInArrow(score, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, model: Model, *, text: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score at least cut. Rows of empty texts go. No shuffle."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    # The columns pass through the scan under numbers, so their names can't clash.
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)
    data = inner.withColumn("data", F.col(f"c{at}").cast("binary"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t.as_py() or b"" for t in part.columns[-1]]
                good = sigmoid(model.logit(np.stack([features(t) for t in texts]))) >= cut
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(good & [bool(t.strip()) for t in texts])], names=[*part.schema.names[:-1], "good"])
        tidy()

    schema = StructType([*inner.schema.fields, StructField("good", BooleanType())])
    return data.mapInArrow(choose, schema).where("good").drop("good").toDF(*docs.columns)
