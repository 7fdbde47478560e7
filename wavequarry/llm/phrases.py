"""Document fingerprints by Lempel-Ziv phrases: texts that share phrases compress alike."""

from __future__ import annotations

import bisect
import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_few, tidy, written

#: Hashes that a fingerprint keeps, of 32 bits each.
KEPT = 128
#: Ranges of ids for each partition of a shuffle, so that ranges are dealt evenly.
PER_TASK = 4
#: More rows than these that are equal in id and text are counted and worked out once.
COPIES = 1000
#: Phrases that are hashed at a time.
AT_ONCE = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def parse(text: str, seen: set[str], phrases: list[str]) -> None:
    """Parse text into phrases that are each one character longer than the longest one seen that the text goes on with.

    seen and phrases grow by what is found; the last phrase may be one that was seen.
    """
    phrase, add, append = "", seen.add, phrases.append
    for c in text:
        phrase += c
        if phrase not in seen:
            add(phrase)
            append(phrase)
            phrase = ""
    if phrase:
        append(phrase)


def ends_of(phrases: list[str], start: int = 0) -> np.ndarray:
    return start + np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))


def phrase_hashes(text: str, start: int, ends: np.ndarray) -> np.ndarray:
    """A hash of each phrase: of its characters by place and of its length."""
    out = []
    for a in range(0, len(ends), AT_ONCE):
        stops = ends[a : a + AT_ONCE]
        begin = start if a == 0 else int(ends[a - 1])
        starts = np.concatenate([[begin], stops[:-1]])
        lengths = stops - starts
        points = np.frombuffer(text[begin : stops[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
        offsets = starts - begin
        place = np.arange(len(points)) - np.repeat(offsets, lengths)
        h = np.add.reduceat(mixed((points + np.uint64(1)) * BASE) * powers[place], offsets)
        out.append(mixed(h + lengths.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def least_hashes(hashes: np.ndarray, kept: int) -> np.ndarray:
    """The `kept` smallest of the set's hashes, ascending: its minimum-hash signature."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    if len(h) > 8 * kept:  # phrases are different, so few of these are the same
        h = h[h <= np.partition(h, 2 * kept)[2 * kept]]
    return np.unique(h)[:kept]


class Parsed:
    """A text's phrases, so that texts with the same beginning are parsed from there on."""

    def __init__(self, text: str):
        self.text, self.phrases = text, []
        seen: set[str] = set()
        parse(text, seen, self.phrases)
        self.ends = ends_of(self.phrases)
        self.new = len(seen)  # all phrases, but for a last one that the text's end has cut short
        self.hashes = phrase_hashes(text, 0, self.ends)

    def edited(self, start: int, rest: str) -> tuple[str, np.ndarray]:
        """The text with rest in place of all from start on, and its phrases' hashes. Phrases up to start are the same."""
        text = self.text[:start] + rest
        same = min(int(np.searchsorted(self.ends, start, "right")), self.new)
        begin = int(self.ends[same - 1]) if same else 0
        new: list[str] = []
        parse(text[begin:], set(self.phrases[:same]), new)
        return text, np.concatenate([self.hashes[:same], phrase_hashes(text, begin, ends_of(new, begin))])


def named(signature: np.ndarray) -> str:
    """A fingerprint as text: eight hexadecimal digits a hash."""
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """The share that both signatures hold of the smallest hashes of their union, an estimate of the share of phrases that both texts have (exact up to `kept` phrases). Two empty ones are alike, an empty and another not at all."""
    both = np.concatenate([a, b])
    both.sort()
    again = np.flatnonzero(both[1:] == both[:-1])
    union = np.delete(both, again)[:kept]
    return float(np.count_nonzero(both[again] <= union[-1])) / len(union) if len(union) else 1.0


def results(rows: Iterator[tuple[int | None, str, str | None]], kept: int) -> Iterator[tuple]:
    """For rows (doc_id, text, next text) in their order: doc_id, n_chars, edited_sha256, both fingerprints, both likenesses.

    A next text of None says that the next row's text is the one; the last row's must be given.
    """

    def of(text: str) -> tuple[Parsed, np.ndarray]:
        parsed = Parsed(text)
        return parsed, least_hashes(parsed.hashes, kept)

    def row(doc_id: int | None, one: tuple[Parsed, np.ndarray], after: tuple[Parsed, np.ndarray]) -> tuple:
        (parsed, own), half = one, len(one[0].text) // 2
        text, hashes = parsed.edited(len(parsed.text) - half, after[0].text[:half])
        other = least_hashes(hashes, kept)
        return doc_id, len(parsed.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), named(own), named(other), likeness(own, other, kept), likeness(own, after[1], kept)

    held = None
    for doc_id, text, follows in rows:
        one = of(text)
        if held is not None:
            yield row(held[0], held[1], one)
        held = None
        if follows is None:
            held = (doc_id, one)
        else:
            yield row(doc_id, one, of(follows))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def batches_of(found: Iterator[tuple], size: int = 256) -> Iterator[dict[str, list]]:
    """Results in batches of columns."""
    held: list[tuple] = []
    for r in found:
        held.append(r)
        if len(held) == size:
            yield dict(zip([f for f, _ in FIELDS], map(list, zip(*held, strict=True)), strict=True))
            held = []
    if held:
        yield dict(zip([f for f, _ in FIELDS], map(list, zip(*held, strict=True)), strict=True))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", kept: int = KEPT) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is the signature of a text's set of Lempel-Ziv phrases (dictionary parsing character by character): its
    least `kept` hashes as text. The edited text has the first characters of the next document in place of its second half, as
    many, or all if there are fewer. Next is the next smaller id, after the smallest the greatest; null ids are the smallest,
    and rows of one id follow each other by a hash of their texts. near_edited and near_next compare the row's fingerprint with
    that of the edited text and of the next document.

    A null text is the empty text, with an empty fingerprint. Equal texts have equal fingerprints, wherever they stand. A
    single row is its own next one. No rows give no rows; extra columns are ignored.

    The ids and hashes alone are dealt into ranges first, PER_TASK for each partition of a shuffle; the first of each range, a
    pair of numbers, is known to all tasks. Then texts are shuffled once, by range, and the first text of each range also goes to
    the range before it, whose last document it follows. A task goes through its ranges with two texts at a time. Rows of one
    id are dealt by their texts; more than COPIES equal rows are one row with a number.
    """
    spark = docs.sparkSession
    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    n_ranges = PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = slim.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).repartitionByRange(n_ranges, *order).withColumn("range", F.spark_partition_id())
    keys = written(keys, "phrase_keys")
    # A pair a range: as many as the shuffle has partitions, times PER_TASK.
    firsts = keys.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("f")).orderBy("range").select("f.*").collect()
    heads = [(f["doc_id"] is None, ~(f["doc_id"] or 0), ~f["tie"]) for f in firsts]
    many = keys.where(F.col("n") > COPIES).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "n")
    hot = not many.isEmpty()
    rows = slim.withColumn("n", F.lit(1).cast("long"))
    if hot:
        met = join_few(slim, many, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")), "left", F.col("text")).drop("__id", "__tie")
        rows = met.where("n IS NULL").withColumn("n", F.lit(1).cast("long")).unionByName(met.where("n IS NOT NULL").groupBy("doc_id", "text", "tie").agg(F.count("*").alias("n")))

    @F.pandas_udf("range int, first boolean")
    def ranged(null: pd.Series, i: pd.Series, tie: pd.Series) -> pd.DataFrame:
        each = list(zip(null.tolist(), (~i).tolist(), (~tie).tolist(), strict=True))
        at = [bisect.bisect_right(heads, k) - 1 for k in each]
        return pd.DataFrame({"range": at, "first": [heads[r] == k for r, k in zip(at, each, strict=True)]})

    at = ranged(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long")), "tie")
    own = F.struct(F.col("at.range").alias("range"), F.lit(False).alias("guest"))
    guest = F.when(F.col("at.first"), F.struct(F.pmod(F.col("at.range") - 1, F.lit(max(len(heads), 1))).alias("range"), F.lit(True).alias("guest")))
    goes = rows.withColumn("at", at).withColumn("to", F.explode(F.filter(F.array(own, guest), lambda x: x.isNotNull())))
    dealt = goes.select("to.range", "to.guest", "doc_id", "tie", "n", "text").repartition("range").sortWithinPartitions("range", "guest", *order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, where = None, None
            for batch in batches:
                for part, guest, i, n, t in zip(*(batch.column(c) for c in range(5)), strict=True):
                    part, guest, n, t = part.as_py(), guest.as_py(), n.as_py(), t.as_py()
                    if held is not None:
                        yield (*held, t if guest else None)
                        held = None
                    assert not guest or part == where
                    if not guest:
                        i, where = i.as_py(), part
                        times.extend([n - 1, 1] if n > 1 else [1])
                        if n > 1:
                            yield i, t, t
                        held = (i, t)

        times: deque[int] = deque()
        for columns in batches_of(results(rows(), kept)):
            k = len(columns["doc_id"])
            yield pa.RecordBatch.from_pydict({**{f: pa.array(columns[f], kind) for f, kind in FIELDS}, "times": pa.array([times.popleft() for _ in range(k)], pa.int64())})
        tidy()

    out = dealt.select("range", "guest", "doc_id", "n", "text").mapInArrow(scan, f"{SCHEMA}, times long")
    if hot:
        out = written(out, "phrase_results")
        again = out.where("times > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES)))).repartition("doc_id", "part")
        again = again.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("part") * COPIES).cast("int"))))
        out = out.where("times = 1").unionByName(again.drop("part", "copy"))
    return out.drop("times")
