"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .quality import sigmoid

WORD = re.compile(r"\w+")
#: Buckets of the hashed embeddings, dimensions of a whole word's bucket, filter widths, filters a width, words of a pooling window.
BUCKETS, FREE, WIDTHS, FILTERS, WINDOW = 1 << 16, 8, (1, 2, 3), 10, 32
#: Languages told apart, and buckets of their words.
LANGUAGES, COMMON = 8, 1 << 12
#: Texts of a kind that a language needs for a threshold of its own, and toxic texts that the common threshold counts as beside them.
LEAST, PULL = 5, 10


def parts(word: str) -> tuple[int, ...]:
    """Buckets of a word: itself, its beginnings of 3 to 7 letters, its end of 4."""
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (word, *(f"<{k}{word[:k]}" for k in (3, 4, 5, 6, 7)), f"{word[-4:]}>"))


#: Checksums of what stands before a word's beginning of 3 to 7 letters.
FROM = tuple(zlib.crc32(f"<{k}".encode()) for k in (3, 4, 5, 6, 7))
SEVEN, LOW = struct.Struct("=7H"), BUCKETS - 1


def packed_parts(word: bytes) -> bytes:
    """parts() of a word in UTF-8 as numbers of 16 bits: checksums of its beginnings go on from those of what stands before."""
    crc, (c3, c4, c5, c6, c7) = zlib.crc32, FROM
    if word.isascii():
        b3, b4, b5, b6, b7, end = word[:3], word[:4], word[:5], word[:6], word[:7], word[-4:]
    else:
        w = word.decode("utf-8", "surrogatepass")
        b3, b4, b5, b6, b7, end = (x.encode("utf-8", "surrogatepass") for x in (w[:3], w[:4], w[:5], w[:6], w[:7], w[-4:]))
    return SEVEN.pack(crc(word) & LOW, crc(b3, c3) & LOW, crc(b4, c4) & LOW, crc(b5, c5) & LOW, crc(b6, c6) & LOW, crc(b7, c7) & LOW, crc(b">", crc(end)) & LOW)


cached_parts = functools.lru_cache(100_000)(packed_parts)


#: Characters beyond ASCII that are in no word, and bytes with a blank for each ASCII character that is in none.
ODD = re.compile(r"[^\x00-\x7F\w]")
BLANKED = bytes(i if i > 127 or WORD.fullmatch(chr(i)) else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8: those that WORD finds."""
    low = (text or "").lower()
    return (low if low.isascii() else ODD.sub(" ", low)).encode("utf-8", "surrogatepass").translate(BLANKED).split()


N_PARTS = 7
DIMS = N_PARTS + FREE


def embed(table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Rows of word embeddings from rows of buckets: the first number of each part's bucket, then the others of the word's own."""
    return np.concatenate([table[buckets, 0], table[buckets[:, 0], 1:]], axis=1)


@dataclass
class Net:
    """table: a row a bucket of the hashed embeddings; filters: one matrix a width; head: weights of the pooled features and a
    bias; tongues: log shares of words by language; shift: by language, so that 0.7 is its threshold. Without a head nothing
    was learnt, and every score is 0."""

    table: np.ndarray
    filters: list[np.ndarray]
    head: np.ndarray | None
    tongues: np.ndarray = field(default_factory=lambda: np.zeros((COMMON, LANGUAGES), np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(LANGUAGES))


def convolve(at: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Outputs of the filters at each word, by width; tables: for a width, what each word adds at each place of the filter. Words beyond the end count as zero."""
    out = []
    for table in tables:
        y = table[at, 0].copy()
        for k in range(1, table.shape[1]):
            y[:-k] += table[at[k:], k]
        out.append(np.maximum(y, 0))
    return out


def pool(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima over each pooling window: (windows, filters), and the places they have."""
    n, f = y.shape
    m = -(-n // WINDOW)
    padded = np.zeros((m * WINDOW, f), y.dtype)
    padded[:n] = y
    blocks = padded.reshape(m, WINDOW, f)
    arg = blocks.argmax(axis=1)
    return np.take_along_axis(blocks, arg[:, None], 1)[:, 0], arg + (np.arange(m) * WINDOW)[:, None]


def pooled(at: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """For each filter the greatest of the windows' maxima, and their mean."""
    if not len(at):
        return np.zeros(2 * FILTERS * len(WIDTHS), np.float32)
    tops = np.concatenate([pool(y)[0] for y in convolve(at, tables)], axis=1)
    return np.concatenate([tops.max(axis=0), tops.mean(axis=0)])


def tables_of(net: Net, buckets: np.ndarray) -> list[np.ndarray]:
    e = embed(net.table, buckets)
    return [np.einsum("vd,kdf->vkf", e, w).astype(np.float32) for w in net.filters]


def log_odds(docs: list[np.ndarray], buckets: np.ndarray, toxic: np.ndarray, prior: float = 3.0) -> np.ndarray:
    """How much likelier each bucket's words are in toxic documents: log odds of the documents that have it, drawn towards the overall share, less the overall ones. Buckets of one document have 0."""
    counts = np.zeros((2, BUCKETS))
    for at, t in zip(docs, toxic, strict=True):
        counts[int(t), np.unique(buckets[at].ravel())] += 1
    return odds_of(counts, toxic.sum(), len(toxic), prior)


def odds_of(counts: np.ndarray, n_toxic: float, n: float, prior: float = 3.0) -> np.ndarray:
    """Log odds of each bucket from its numbers of other and of toxic documents, n_toxic of n documents being toxic."""
    overall = (n_toxic + 1) / (n + 2)
    share = (counts[1] + prior * overall) / (counts.sum(0) + prior)
    odds = np.log(share / (1 - share)) - np.log(overall / (1 - overall))
    return np.where(counts.sum(0) >= 2, np.clip(odds, -2, 6), 0).astype(np.float32)


def seeds_of(counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Square roots of the shares of words of LANGUAGES documents, each far from those before it."""
    shares = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    seeds, far = [int(rng.integers(len(counts)))], np.full(len(counts), 2.0)
    while len(seeds) < LANGUAGES:
        far = np.minimum(far, 1 - shares @ shares[seeds[-1]])
        seeds.append(int(np.argmax(far * (counts.sum(1) >= 20))))
    return shares[seeds].T


def logs_of(sums: np.ndarray) -> np.ndarray:
    """Log shares of the groups' words from their counts, a column a group."""
    sums = sums + 0.1
    return np.log(sums / sums.sum(0))


def tongues_of(docs: list[np.ndarray], buckets: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Log shares of words in LANGUAGES groups of documents that share their words: each document joins the group it is likeliest in, then the groups' shares are counted anew. No label or column tells a language."""
    word = buckets[:, 0] % COMMON
    counts = np.stack([np.bincount(word[at], minlength=COMMON) for at in docs]).astype(np.float32)
    shares = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    group = np.argmax(shares @ seeds_of(counts, rng), axis=1)
    for _ in range(rounds):
        logs = logs_of(np.stack([counts[group == k].sum(0) for k in range(LANGUAGES)], axis=1))
        group = np.argmax(counts @ logs, axis=1)
    return logs.astype(np.float32)


def language(at: np.ndarray, tongues: np.ndarray) -> int:
    """The language of a document by the rows of its words in tongues."""
    return int(np.argmax(tongues[at].sum(0)))


def pack(docs: list[np.ndarray], shift: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other, each begun at a pooling window and followed by two places or more of -1; and the first window of each. shift is added to a document's rows."""
    lengths = [-(-(len(d) + 2) // WINDOW) * WINDOW for d in docs]
    ends = np.cumsum(lengths)
    out = np.full(int(ends[-1]), -1, np.int64)
    for d, e, n, s in zip(docs, ends, lengths, shift, strict=True):
        out[e - n : e - n + len(d)] = d + s
    return out, (ends - lengths) // WINDOW


class Descent:
    """Embeddings, filters and head on their way along the gradients of the logistic loss.

    start: embeddings for the documents of one half, and for the others; learnt: what is added to both. Batches are packed into
    one array; gradients pass through the places that hold the maxima only, down to the buckets of the words there.
    """

    def __init__(self, start: list[np.ndarray], filters: list[np.ndarray], head: np.ndarray, learnt: np.ndarray, squares: np.ndarray, rate: float = 0.03, pace_table: float = 0.02):
        self.start, self.filters, self.head, self.learnt, self.squares = start, filters, head, learnt, squares
        self.rate, self.pace_table, self.done = rate, pace_table, 0
        self.moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (*filters, head)]

    @classmethod
    def begun(cls, odds: list[np.ndarray], rng: np.random.Generator, **rates: float) -> Descent:
        free = rng.uniform(-0.25, 0.25, (BUCKETS, FREE)).astype(np.float32)
        filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:  # the first filters start as sums of log odds, one for each part of a word
            for j in range(min(FILTERS, N_PARTS)):
                f[:, :N_PARTS, j] = 0.02
                f[:, j, j] = 0.5 / len(f)
        head = np.zeros(2 * FILTERS * len(WIDTHS) + 1)
        head[:-1], head[-1] = 0.05, -2
        start = [np.concatenate([o[:, None], free], axis=1) for o in odds]
        return cls(start, filters, head, np.zeros((BUCKETS, 1 + FREE), np.float32), np.full((BUCKETS, 1 + FREE), 1e-6, np.float32), **rates)

    def step(self, docs: list[np.ndarray], buckets: np.ndarray, toxic: np.ndarray, half: np.ndarray, weight: np.ndarray, pace: float) -> np.ndarray:
        """One batch: documents as rows of buckets, a row a word. Returns the rows of the embeddings that it moved."""
        filters, head, n_words, n_f = self.filters, self.head, len(buckets), FILTERS * len(WIDTHS)
        # Rows of the documents of half, then those of the others, then one for padding.
        at, first = pack(docs, [0 if h else n_words for h in half])
        real = at >= 0
        met = np.zeros(2 * n_words, bool)
        met[at[real]] = True
        used, where = np.flatnonzero(met), (np.cumsum(met) - 1)[at[real]]
        mine, rows = used < n_words, buckets[used % n_words]
        vectors = np.concatenate([embed(self.start[0], rows[mine]), embed(self.start[1], rows[~mine])]) + embed(self.learnt, rows)
        e = np.zeros((len(at), DIMS), np.float32)
        e[real] = vectors[where]
        tops, places = [], []
        for f in filters:
            y = e @ f[0]
            for k in range(1, len(f)):
                y[:-k] += e[k:] @ f[k]
            blocks = np.where(real[:, None], np.maximum(y, 0), 0).reshape(-1, WINDOW, FILTERS)
            arg = blocks.argmax(axis=1)
            tops.append(np.take_along_axis(blocks, arg[:, None], 1)[:, 0])
            places.append(arg + (np.arange(len(arg)) * WINDOW)[:, None])
        tops = np.concatenate(tops, axis=1)
        counts = np.diff([*first, len(tops)])
        full = real.reshape(-1, WINDOW).any(axis=1)
        some, n_win = np.maximum.reduceat(full.astype(int), first), np.maximum(1, np.add.reduceat(full, first, dtype=int))[:, None]
        most = np.maximum.reduceat(tops, first, axis=0)
        x = np.concatenate([most, np.add.reduceat(tops, first, axis=0) / n_win, np.ones((len(docs), 1))], axis=1)
        d = (sigmoid(x @ head) - toxic) * weight / len(docs) * some
        of = np.repeat(np.arange(len(docs)), counts)
        wins = (tops == most[of]) & (tops > 0)
        wins = wins / np.maximum(1, np.add.reduceat(wins, first, axis=0, dtype=int))[of]
        share = (d[of, None] * (wins * head[:n_f] + (tops > 0) * head[n_f : 2 * n_f] / n_win[of])).astype(np.float32)
        grads, shares, ahead = [], [], []
        for j, (f, p) in enumerate(zip(filters, places, strict=True)):
            part = share[:, j * FILTERS : (j + 1) * FILTERS]
            reach = [np.minimum(p + k, len(e) - 1) for k in range(len(f))]
            grads.append(np.stack([np.einsum("mfd,mf->df", e[q], part) for q in reach]))
            for q, w in zip(reach, f, strict=True):
                at_words = np.zeros((len(e), FILTERS), np.float32)
                at_words[q, np.arange(FILTERS)] = part  # a window's place is its own, so no index comes twice but for padding
                shares.append(at_words)
                ahead.append(w)
        to_words = np.concatenate(shares, axis=1) @ np.concatenate(ahead, axis=1).T
        grads.append(x.T @ d)
        of_words = np.ascontiguousarray(to_words[real].T)
        sums = np.stack([np.bincount(where, x, len(used)) for x in of_words])
        moved = np.flatnonzero(np.bincount(rows.ravel(), minlength=BUCKETS))
        grown = [np.bincount(rows.ravel(), sums[:N_PARTS].T.ravel(), BUCKETS), *[np.bincount(rows[:, 0], x, BUCKETS) for x in sums[N_PARTS:]]]
        grown = np.stack([g[moved] for g in grown], axis=1).astype(np.float32)
        self.done += 1
        self.squares[moved] += grown * grown
        self.learnt[moved] -= pace * self.pace_table * grown / np.sqrt(self.squares[moved])
        for w, grad, (v1, v2) in zip((*filters, head), grads, self.moments, strict=True):
            grad = grad + 1e-3 * w
            v1 += 0.1 * (grad - v1)
            v2 += 0.01 * (grad * grad - v2)
            w -= (self.rate * pace * (v1 / (1 - 0.9**self.done)) / (np.sqrt(v2 / (1 - 0.99**self.done)) + 1e-8)).astype(w.dtype)
        return moved


#: Documents of a batch of the descent.
SIZE = 64


def train(docs: list[np.ndarray], buckets: np.ndarray, toxic: np.ndarray, *, seed: int = 3, epochs: int = 12, rate: float = 0.03, pace_table: float = 0.02) -> Net:
    """Embeddings, filters and head by gradients of the logistic loss, of documents in memory.

    The embeddings start from the buckets' log odds in the half of the documents that a document isn't in, so that they don't
    know its label, and are trained on from there; at the end both halves' odds are put together.
    """
    rng = np.random.default_rng(seed)
    half = np.zeros(len(docs), bool)
    for t in (False, True):  # halves with the same share of toxic documents
        half[rng.permutation(np.flatnonzero(toxic == t))[::2]] = True
    odds = [log_odds([docs[i] for i in np.flatnonzero(h)], buckets, toxic[h]) for h in (~half, half)]
    way = Descent.begun(odds, rng, rate=rate, pace_table=pace_table)
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum())) * len(docs)
    steps = epochs * -(-len(docs) // SIZE)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), SIZE):
            batch = order[a : a + SIZE]
            way.step([docs[i] for i in batch], buckets, toxic[batch], half[batch], weight[batch], 1 - 0.9 * (way.done + 1) / steps)
    # Thresholds by language, from scores under the other half's odds.
    tongues = tongues_of(docs, buckets, rng)
    by_word = tongues[buckets[:, 0] % COMMON]
    langs, logits = np.array([language(d, by_word) for d in docs]), np.zeros(len(docs))
    for h, table in ((half, way.start[0]), (~half, way.start[1])):
        tables = tables_of(Net(table + way.learnt, way.filters, way.head), buckets)
        for i in np.flatnonzero(h):
            logits[i] = pooled(docs[i], tables) @ way.head[:-1] + way.head[-1]
    net = Net(np.concatenate([log_odds(docs, buckets, toxic)[:, None], way.start[0][:, 1:]], axis=1) + way.learnt, way.filters, way.head, tongues)
    everyone = best_cut(logits, toxic, None)
    net.shift = np.array([best_cut(logits[langs == k], toxic[langs == k], everyone) for k in range(LANGUAGES)])
    return net


def best_cut(logits: np.ndarray, toxic: np.ndarray, fallback: float | None, n: np.ndarray | None = None) -> float:
    """The cut of best F1, in the middle of the gap around it; with under LEAST documents of a kind, the fallback's; else drawn towards the fallback by the number of toxic documents. With n, a logit stands for n documents, toxic of them toxic."""
    n = np.ones(len(logits)) if n is None else n
    if min(toxic.sum(), n.sum() - toxic.sum()) < (1 if fallback is None else LEAST):
        return fallback or 0.0
    order = np.argsort(-logits, kind="stable")
    s, hits = logits[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + toxic.sum())
    best = int(np.argmax(f1))
    cut = (s[best] + (s[best + 1] if best + 1 < len(s) else s[best])) / 2
    return float(cut if fallback is None else (cut * toxic.sum() + fallback * PULL) / (toxic.sum() + PULL))


#: The logit of the threshold 0.7.
CUT = float(np.log(0.7 / 0.3))


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and toxic as they are; words: the text's words as numbers of its distinct ones; buckets: those of the distinct ones, side by side."""
    for whole in batches:
        for a in range(0, whole.num_rows, SIZE):
            batch, at, buckets = whole.slice(a, SIZE), [], []
            for t in batch.column(2):
                rows = Rows()
                at.append(np.array([rows[w] for w in words_of(t.as_py())], np.int32).tobytes())
                buckets.append(b"".join(map(cached_parts, rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(buckets, pa.binary())], names=["doc_id", "toxic", "words", "buckets"])


@dataclass
class Some:
    """Up to SIZE documents: the buckets of their distinct words, a row a word, their words as rows of these (with nothing for a document without), labels and halves."""

    docs: list[np.ndarray]
    buckets: np.ndarray
    toxic: np.ndarray
    half: np.ndarray
    firsts: np.ndarray

    def where(self, keep: np.ndarray) -> list[np.ndarray]:
        return [self.docs[i] for i in np.flatnonzero(keep)]


def some(batches: Iterator[pa.RecordBatch]) -> Iterator[Some]:
    for whole in batches:
        for a in range(0, whole.num_rows, SIZE):
            batch = whole.slice(a, SIZE)
            each = [np.frombuffer(b.as_py(), np.uint16).reshape(-1, N_PARTS) for b in batch.column("buckets")]
            firsts = np.cumsum([0, *map(len, each)])
            docs = [f + np.frombuffer(w.as_py(), np.int32).astype(np.int64) for f, w in zip(firsts, batch.column("words"))]
            buckets = np.concatenate([*each, np.zeros((1, N_PARTS), np.uint16)]).astype(np.int64)
            yield Some(docs, buckets, *(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("toxic", "half")), firsts)


#: Numbers of a vector that one task adds up, and tasks that make a vector each where there are fewer cores.
PIECE, TASKS = 1 << 13, 16


def summed(rows: DataFrame, size: int, fill: Callable[[np.ndarray, Iterator[Some]], None]) -> np.ndarray:
    """The sum of the vectors of `size` numbers that fill() makes of each task's rows. Tasks add up a piece of the vectors each, so the driver gets one vector, and there are as many vectors as cores (TASKS at least), however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros(size)
        fill(v, some(batches))
        cut = {k: v[a : a + PIECE].astype(np.float32).tobytes() for k, a in enumerate(range(0, size, PIECE)) if v[a : a + PIECE].any()}
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(cut), pa.int64()), "data": pa.array(list(cut.values()), pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_py(), np.float32).astype(np.float64) for d in t["data"])
        return pa.table({"piece": t["piece"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    out, rows = np.zeros(size), rows.coalesce(max(TASKS, rows.sparkSession.sparkContext.defaultParallelism))
    for r in rows.mapInArrow(run, "piece long, data binary").groupBy("piece").applyInArrow(add, "piece long, data binary").collect():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["data"])
    return out


def all_odds(rows: DataFrame) -> np.ndarray:
    """Documents by half, label and bucket: (2, 2, BUCKETS + 1), the last of each being all documents."""

    def fill(v: np.ndarray, each: Iterator[Some]) -> None:
        counts, place = v.reshape(2, 2, BUCKETS + 1), np.zeros(BUCKETS, np.int64)
        for s in each:
            for i, (t, h) in enumerate(zip(s.toxic.astype(int), s.half.astype(int), strict=True)):
                b = s.buckets[s.firsts[i] : s.firsts[i + 1]].ravel()
                at = np.arange(len(b))
                place[b] = at
                counts[h, t, b[place[b] == at]] += 1  # each bucket once
                counts[h, t, BUCKETS] += 1

    return summed(rows, 4 * (BUCKETS + 1), fill).reshape(2, 2, BUCKETS + 1)


def all_tongues(rows: DataFrame, seed: int, rounds: int = 8, seeds: int = 512) -> np.ndarray:
    """tongues_of over all rows. Only the first groups' seeds are texts out of a few; every count is one of all rows."""
    few = rows.orderBy(F.octet_length("words") < 80, F.xxhash64(F.lit(seed + 1), "doc_id"), F.xxhash64("words", "buckets")).limit(seeds)

    def counted(s: Some) -> np.ndarray:
        word = s.buckets[:, 0] % COMMON
        keys = [k * COMMON + word[d] for k, d in enumerate(s.docs)]
        return np.bincount(np.concatenate(keys), minlength=len(keys) * COMMON).reshape(-1, COMMON).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in some(batches):
            yield pa.RecordBatch.from_pydict({"x": pa.array([c.tobytes() for c in counted(s)], pa.binary())})

    got = few.mapInArrow(vectors, "x binary").collect()
    by, first = seeds_of(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), np.random.default_rng(seed)), True
    for _ in range(rounds):

        def fill(v: np.ndarray, each: Iterator[Some], by=by, first=first) -> None:
            sums = v.reshape(LANGUAGES, COMMON)
            for s in each:
                counts = counted(s)
                group = np.argmax((np.sqrt(counts) if first else counts) @ by, axis=1)  # the size of a text doesn't change its group
                sums += (group == np.arange(LANGUAGES)[:, None]).astype(np.float32) @ counts

        by, first = logs_of(summed(rows, LANGUAGES * COMMON, fill).reshape(LANGUAGES, COMMON).T).astype(np.float32), False
    return by


def all_steps(rows: DataFrame, way: Descent, weights: tuple[float, float], rounds: int) -> Descent:
    """The descent over all rows, `rounds` times: each task steps through its rows from the common weights, then the tasks' weights are averaged, by rows for filters and head, for a bucket over the tasks that moved it. Squares of gradients add up."""
    rest = [*way.filters, way.head]
    cuts = np.cumsum([0, BUCKETS, way.learnt.size, way.learnt.size, *(w.size for w in rest), 1])
    for r in range(rounds):

        def fill(v: np.ndarray, each: Iterator[Some], at=way, pace=1 - 0.9 * r / rounds) -> None:
            mine = Descent(at.start, [f.copy() for f in at.filters], at.head.copy(), at.learnt.copy(), at.squares.copy(), at.rate, at.pace_table)
            n, moved = 0, np.zeros(BUCKETS, bool)
            for s in each:
                moved[mine.step(s.docs, s.buckets, s.toxic, s.half, np.where(s.toxic, *weights), pace)] = True
                n += len(s.docs)
            v[:] = np.concatenate([moved, (mine.learnt - at.learnt).ravel(), (mine.squares - at.squares).ravel(), *(n * w.ravel() for w in (*mine.filters, mine.head)), [n]])

        moved, learnt, squares, *rest, n = np.split(summed(rows, int(cuts[-1]), fill), cuts[1:-1])
        moves = np.maximum(1, moved)[:, None]
        filters = [(x / n).reshape(f.shape).astype(np.float32) for x, f in zip(rest, way.filters)]
        way = Descent(way.start, filters, rest[-1] / n, (way.learnt + learnt.reshape(way.learnt.shape) / moves).astype(np.float32), (way.squares + squares.reshape(way.squares.shape)).astype(np.float32), way.rate, way.pace_table)
    return way


#: Steps of a logit, up to 40 either way, by which thresholds are found.
FINE = 256


def all_cuts(rows: DataFrame, way: Descent, tongues: np.ndarray) -> np.ndarray:
    """Thresholds by language, of all rows: counted by steps of 1 / FINE of the logits, so what reaches the driver is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = [Net(start + way.learnt, way.filters, way.head, tongues) for start in way.start]
        for s in some(batches):
            for net, h in zip(nets, (s.half, ~s.half), strict=True):
                keep = h & np.array([len(d) > 0 for d in s.docs])
                if keep.any():
                    logits, langs = judged(s.where(keep), added(net, s.buckets), net.head)
                    step = np.round(np.clip(logits, -40, 40) * FINE).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"lang": langs, "step": step, "toxic": s.toxic[keep].astype(np.int64)})

    got = rows.mapInArrow(run, "lang long, step long, toxic long").groupBy("lang", "step").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).toPandas()
    lang, logits, toxic, n = got["lang"].to_numpy(), got["step"].to_numpy() / FINE, got["toxic"].to_numpy(float), got["n"].to_numpy(float)
    every = got.groupby("step")[["toxic", "n"]].sum().reset_index()
    everyone = best_cut(every["step"].to_numpy() / FINE, every["toxic"].to_numpy(float), None, every["n"].to_numpy(float))
    return np.array([best_cut(logits[lang == k], toxic[lang == k], everyone, n[lang == k]) for k in range(LANGUAGES)])


#: Visits of documents that the rounds over all rows come to at least, and the most and fewest rounds.
VISITS, ROUNDS = 40_000, (2, 12)


def fit_whole(rows: DataFrame, seed: int) -> Net:
    """A net from all rows (doc_id, toxic, words, buckets), by a few passes of Spark over them; the driver holds vectors of fixed sizes only.

    As in train(), embeddings start from the log odds of the half (by the id's hash) that a document isn't in. All labelled texts
    count in the odds, in each round of the descent, in the languages and in the thresholds.
    """
    rows = written(rows.withColumn("half", F.xxhash64(F.lit(seed), "doc_id") % 2 == 0), "toxicity_rows")
    counts = all_odds(rows)
    n_other, n_toxic = counts[:, :, BUCKETS].sum(0)
    if not n_other or not n_toxic:
        return NOTHING
    odds = [odds_of(c[:, :BUCKETS], c[1, BUCKETS], c[:, BUCKETS].sum()) for c in (counts[0], counts[1], counts.sum(0))]
    way = Descent.begun(odds[:2], np.random.default_rng(seed))  # documents of half 1 start from the odds of half 0
    n = n_other + n_toxic
    way = all_steps(rows, way, (0.5 / n_toxic * n, 0.5 / n_other * n), int(np.clip(np.ceil(VISITS / n), *ROUNDS)))
    tongues = all_tongues(rows, seed)
    table = np.concatenate([odds[2][:, None], way.start[0][:, 1:]], axis=1) + way.learnt
    return Net(table, way.filters, way.head, tongues, all_cuts(rows, way, tongues))


#: Bits of the filter of labelled ids: 512 bitmaps of Spark's 32,768 bits, 2 MB.
ID_BITS, MAP_BITS = 1 << 24, 1 << 15


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs joined to known, a row a doc_id. A filter of the known ids drops most other texts where they are read, so that these aren't shuffled."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    number, place = F.floor(at / MAP_BITS), at % MAP_BITS
    maps = known.groupBy(number.alias("__number")).agg(F.bitmap_construct_agg(place).alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.join(F.broadcast(maps), number == F.col("__number")).where(F.bit_get(byte, (place % 8).cast("int")) == 1)
    return met.drop("__number", "__map").join(known, "doc_id")


#: Without texts of both kinds.
NOTHING = Net(np.zeros((1, 1 + FREE), np.float32), [], None)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", allowed: Column | None = None, most: int | None = None, longest: int | None = None, seed: int = 3) -> Net:
    """A net from all labelled texts: see fit_whole(). With `most`, from at most `most` toxic and 2 * most others only, those of least seeded hash, in the driver's memory.

    Only ids for which `allowed` holds (a column over doc_id) are used, and with `longest` only texts of up to that many bytes.
    Thresholds are those of best F1 by group of texts that share their words; one with
    fewer than LEAST texts of a kind takes the threshold of all texts, and the others are drawn towards it as if PULL toxic
    texts had shown it, so that few texts don't set a threshold by chance. A text's label is the greatest of its id's; rows of a repeated id count each. Without labelled texts of both kinds
    there is nothing to learn: every text then scores 0.
    """
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    if longest is not None:
        narrow = narrow.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    usable = F.col("doc_id").isNotNull() & (F.lit(True) if allowed is None else allowed)
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(usable)
    told = ["doc_id", (F.col("toxic") == 1).alias("toxic"), "text"]
    made = "doc_id long, toxic boolean, words binary, buckets binary"
    if most is None:
        return fit_whole(labelled(narrow.where(usable), known.where("toxic IN (0, 1)")).select(*told).mapInArrow(word_rows, made), seed)
    by_hash = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(most).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(2 * most))
    rows = narrow.join(F.broadcast(chosen), "doc_id").select(*told).mapInArrow(word_rows, made)
    # The rows are limited once more, as an id can have any number of them.
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("toxic").orderBy(*by_hash, F.xxhash64("words", "buckets"), "words", "buckets")))
    got = rows.where(F.col("place") <= F.when(F.col("toxic"), most).otherwise(2 * most)).toPandas().sort_values(["doc_id", "words", "buckets"])
    toxic = got["toxic"].to_numpy(bool) if len(got) else np.zeros(0, bool)
    if not toxic.any() or toxic.all():
        return NOTHING
    each = [np.frombuffer(b, np.uint16).reshape(-1, N_PARTS) for b in got["buckets"]]
    buckets, inverse = np.unique(np.concatenate([*each, np.zeros((1, N_PARTS), np.uint16)]), axis=0, return_inverse=True)
    firsts = np.cumsum([0, *map(len, each)])
    at = [inverse.ravel()[f + np.frombuffer(w, np.int32)] for f, w in zip(firsts, got["words"])]
    return train(at, buckets.astype(np.int64), toxic, seed=seed)


def added(net: Net, buckets: np.ndarray) -> np.ndarray:
    """A row a word: what it adds to the filters of each width at its own place, then one and two places ahead, then its log shares by language. The last row is for padding: nothing there comes above 0."""
    ahead = [f[k] for k in range(max(WIDTHS)) for f in net.filters if k < len(f)]
    out = np.zeros((len(buckets) + 1, FILTERS * len(ahead) + LANGUAGES), np.float32)
    out[:-1, :-LANGUAGES] = embed(net.table, buckets) @ np.concatenate(ahead, axis=1)
    out[:-1, -LANGUAGES:] = net.tongues[buckets[:, 0] % COMMON]
    out[-1, : FILTERS * len(WIDTHS)] = -1e30
    return out


def judged(docs: list[np.ndarray], table: np.ndarray, head: np.ndarray, places: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """Logits and languages of documents of one word or more, their words being rows of added(); some windows at a time."""
    at, first = pack(docs, [0] * len(docs))
    n_f, tops, tongues = FILTERS * len(WIDTHS), [], []
    for a in range(0, len(at), places):
        rows = table[np.concatenate([at[a : a + places + max(WIDTHS) - 1], np.full(max(WIDTHS) - 1, -1)])]
        m, start = min(places, len(at) - a), n_f
        y = rows[:m, :n_f]
        for k in range(1, max(WIDTHS)):
            wide = FILTERS * sum(w > k for w in WIDTHS)
            y[:, n_f - wide :] += rows[k : m + k, start : start + wide]
            start += wide
        tops.append(np.maximum(y.reshape(-1, WINDOW, n_f).max(axis=1), 0))
        tongues.append(rows[:m, start:].reshape(-1, WINDOW, LANGUAGES).sum(axis=1))
    tops, tongues = np.concatenate(tops), np.concatenate(tongues)
    n_win = -(-np.array([len(d) for d in docs]) // WINDOW)
    x = np.concatenate([np.maximum.reduceat(tops, first, axis=0), np.add.reduceat(tops, first, axis=0) / n_win[:, None]], axis=1)
    return x @ head[:-1] + head[-1], np.argmax(np.add.reduceat(tongues, first, axis=0), axis=1)


class Rows(dict):
    """Words numbered as they come; fresh: those that came since it was last emptied."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at


def score_toxicity(docs: DataFrame, net: Net, *, doc_id: str = "doc_id", text: str = "text", cut: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= cut) for every row, by its whole text alone.

    What a distinct word adds to each filter is computed once and kept in a table (bounded; emptied when full), and texts are
    packed into one array, so a word costs one look-up. A narrow pass without a shuffle. Null and empty texts have score 0; null ids stay null; repeated rows are
    scored each; empty tables give no rows; other columns are ignored. The score's logit is shifted by the threshold of the
    language that the text's own words show. 
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rows()
        table = added(net, np.zeros((0, N_PARTS), np.int64)) if net.head is not None else None
        size = len(table) if table is not None else 0

        def tell(docs: list[np.ndarray]) -> np.ndarray:
            nonlocal table, size
            if known.fresh:
                rows = added(net, np.frombuffer(b"".join(map(packed_parts, known.fresh)), np.uint16).reshape(-1, N_PARTS).astype(np.int64))
                a, b = len(known) - len(known.fresh), len(known)
                if b >= size:
                    size = max(b + 1, 2 * size)
                    table = np.concatenate([table[:a], np.zeros((size - a, table.shape[1]), np.float32)])
                table[a:b], table[-1] = rows[:-1], rows[-1]
                known.fresh = []
            logits, langs = judged(docs, table, net.head)
            return sigmoid(logits - net.shift[langs] + CUT)

        for batch in batches:
            out, docs, at, n = np.zeros(batch.num_rows), [], [], 0
            for i, t in enumerate(batch.column(1)):
                words = words_of(t.as_py()) if net.head is not None else []
                if not words:
                    continue
                docs.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                at.append(i)
                n += len(words)
                if n > 1 << 15 or len(docs) == 256:
                    out[at] = tell(docs)
                    docs, at, n = [], [], 0
                    if len(known) > 100_000:
                        known.clear()
            if docs:
                out[at] = tell(docs)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(out), "predicted": pa.array((out >= cut).astype(np.int32))})

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return narrow.mapInArrow(score, "doc_id long, score double, predicted int")
