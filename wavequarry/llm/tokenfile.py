"""Token-ID output: blocks of concatenated ids whose document boundaries are Elias-Fano encoded."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, few, shared_dir, tidy

MAGIC = b"EFTK1\0\0\0"
#: Set bits between two entries of the select table.
EVERY = 64
#: Documents whose boundaries are read at once.
READ = 4096
#: How a vocabulary whose text can be cut into units normalises and splits it (fixed values, as its file has them).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Kinds of Latin-1 characters by code point.
WHITE, LETTER, DIGIT, OTHER = range(4)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each Latin-1 character, and its lower case."""
    kinds, lower = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        if unicodedata.category(c)[0] in "LN":
            kinds[i] = LETTER if unicodedata.category(c)[0] == "L" else DIGIT
        elif c.isspace() and not 0x1C <= i <= 0x1F:  # Python alone counts these four separators as space
            kinds[i] = WHITE
        lower[i] = ord(c.lower())
    return kinds, lower


KINDS, LOWER = _classes()
BLANK = np.full(256, LETTER, np.uint8)
BLANK[[9, 10, 11, 12, 13, 32]] = WHITE


class EliasFano:
    """A non-decreasing sequence of n whole numbers up to u: about 2 + log2(u / n) bits each.

    The low bits are packed side by side; the high bits are a unary bit string with a sampled select table of 32-bit places.
    """

    def __init__(self, n: int, width: int, first: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.width, self.first, self.low, self.high, self.samples = n, width, first, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        first = int(values[0]) if n else 0
        v = (values.astype(np.int64) - first).astype(np.uint64)  # wraps where the span is beyond 63 bits, as intended
        u = int(v[-1]) if n else 0
        width = max(0, (u // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        high = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(high[-1]) + 1) if n else 0, np.uint8)
        unary[high] = 1
        return cls(n, width, first, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), high[::EVERY].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, by the select table and a count of set bits from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        while left:
            at += 1
            left -= self.high[at >> 3] >> (at & 7) & 1
        low = 0
        for k in range(self.width):
            b = i * self.width + k
            low |= (self.low[b >> 3] >> (b & 7) & 1) << k
        return ((at - i) << self.width | low) + self.first

    def values(self, a: int, b: int) -> np.ndarray:
        """The a-th to the b-th value (b left out): select from the table, then on through that part of the unary bits alone."""
        if a >= b:
            return np.zeros(0, np.int64)
        at, last = int(self.samples[a // EVERY]), -(-b // EVERY)
        to = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[at >> 3 : (to >> 3) + 1], bitorder="little")[at & 7 :]
        left = a % EVERY
        places = np.flatnonzero(bits)[left : left + b - a] + at
        first = a * self.width
        packed = np.unpackbits(np.frombuffer(self.low, np.uint8)[first >> 3 : (b * self.width + 7) >> 3], bitorder="little")[first & 7 :]
        packed = packed[: (b - a) * self.width].reshape(b - a, self.width)
        low = (packed.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (((places - np.arange(a, b)).astype(np.uint64) << np.uint64(self.width)) + low).astype(np.int64) + self.first

    def dump(self) -> bytes:
        return struct.pack("<QQqQQ", self.n, self.width, self.first, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, first, low, high = struct.unpack_from("<QQqQQ", data, at)
        a = at + 40
        b, c = a + low, a + low + high
        end = c + 4 * -(-n // EVERY)
        return cls(n, width, first, bytes(data[a:b]), bytes(data[b:c]), np.frombuffer(data[c:end], "<u4")), end


def encode_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: header, document ids (nulls first, the rest ascending), boundaries, then ids of 2 or 4 bytes each."""
    nulls = sum(x is None for x in doc_ids)
    wide = 4 if len(ids) and int(ids.max()) >= 1 << 16 else 2
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    head = struct.pack("<8sQQQQ", MAGIC, len(doc_ids), nulls, len(ids), wide)
    return head + EliasFano.of(np.array(doc_ids[nulls:], np.int64)).dump() + EliasFano.of(bounds).dump() + ids.astype(f"<u{wide}").tobytes()


class Block:
    """A block read back: doc_ids, and the ids of the i-th document by its boundaries."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.n, nulls, n_ids, wide = struct.unpack_from("<8sQQQQ", view, 0)
        if magic != MAGIC:
            raise ValueError("not a token block")
        names, at = EliasFano.load(view, 40)
        self.bounds, at = EliasFano.load(view, at)
        self.doc_ids = [None] * nulls + names.values(0, names.n).tolist()
        self.ids = np.frombuffer(view[at : at + n_ids * wide], f"<u{wide}")

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class Memory:
    """Ids of the units met so far, in flat arrays, so that a text costs a few array operations and no Python object a unit.

    A unit of up to 15 bytes is found by these bytes and its length, packed into two 64-bit words, in a table with open
    addressing; a longer one in a dict. Where MOST units are held, the half that was met most often stays.
    """

    MOST, BITS = 300_000, 20

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]]):
        self.encode, self.long = encode, {}
        self.count, self.flat_end = 0, 0
        self.k1, self.k2, self.hits = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.int32)
        self.at, self.n, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.slots = np.full(1 << self.BITS, -1, np.int32)

    def home(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h = (k1 * np.uint64(0x9E3779B97F4A7C15)) ^ (k2 * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it isn't held."""
        at = self.home(k1, k2)
        out = self.slots[at].astype(np.int64)
        rest = np.flatnonzero((out >= 0) & ((self.k1[out] != k1) | (self.k2[out] != k2)))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)
            got = out[rest] = self.slots[at[rest]]
            rest = rest[(got >= 0) & ((self.k1[got] != k1[rest]) | (self.k2[got] != k2[rest]))]
        return out

    def place(self, numbers: np.ndarray) -> None:
        """Enter keys that aren't held yet into the table."""
        at = self.home(self.k1[numbers], self.k2[numbers])
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]  # of several for one slot the last stays
            left = self.slots[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & (len(self.slots) - 1)

    def add(self, units: list[bytes]) -> np.ndarray:
        """Numbers of new units."""
        ids = self.encode(units)
        n = np.array([len(x) for x in ids], np.int64)
        a, b, e = self.count, self.count + len(units), self.flat_end + int(n.sum())
        if b > len(self.n):
            grow = max(b, len(self.n) * 5 // 4) - len(self.n)
            self.k1, self.k2, self.hits, self.at, self.n = (np.concatenate([x, np.zeros(grow, x.dtype)]) for x in (self.k1, self.k2, self.hits, self.at, self.n))
        if e > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(e, len(self.flat) * 5 // 4) - len(self.flat), np.uint32)])
        if e > self.flat_end:
            self.flat[self.flat_end : e] = np.concatenate(ids)
        self.n[a:b], self.at[a:b], self.hits[a:b] = n, self.flat_end + np.cumsum(n) - n, 0
        self.count, self.flat_end = b, e
        return np.arange(a, b)

    def shrink(self) -> None:
        kept = np.sort(np.argsort(-self.hits[: self.count], kind="stable")[: self.MOST // 2])
        new = np.full(self.count, -1, np.int64)
        new[kept] = np.arange(len(kept))
        flat = self.gather(kept)
        n = self.n[kept]
        self.flat, self.flat_end, self.count = flat, len(flat), len(kept)
        self.at, self.n, self.k1, self.k2, self.hits = np.cumsum(n, dtype=np.int32) - n, n, self.k1[kept], self.k2[kept], self.hits[kept] // 2
        self.long = {u: int(new[i]) for u, i in self.long.items() if new[i] >= 0}
        self.slots[:] = -1
        self.place(np.flatnonzero(self.k2 > 0))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of units one after the other."""
        n = self.n[numbers]
        ends = np.cumsum(n)
        return self.flat[np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(self.at[numbers] - (ends - n), n)]

    def __call__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the units b[start:end]; b has 16 bytes more than the last of them."""
        if self.count > self.MOST:
            self.shrink()
        n = ends - starts
        words = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
        keep = ~np.uint64(0) >> ((8 - np.arange(8, dtype=np.uint64)) * np.uint64(8) % np.uint64(64))
        keep[0] = 0
        keep = np.append(keep, ~np.uint64(0))
        k1 = words[starts] & keep[np.minimum(n, 8)]
        # The second word's last byte is the length, so it is never 0 for a key.
        k2 = words[starts + 8] & keep[np.clip(n - 8, 0, 7)] | np.minimum(n, 16).astype(np.uint64) << np.uint64(56)
        short = n < 16
        out = np.full(len(n), -1, np.int64)
        if short.all():
            out = self.find(k1, k2)
        else:
            out[short] = self.find(k1[short], k2[short])
            for i in np.flatnonzero(~short).tolist():
                u = b[starts[i] : ends[i]].tobytes()
                number = self.long.get(u)
                if number is None:
                    number = self.long[u] = int(self.add([u])[0])
                    self.k2[number] = 0
                out[i] = number
        new = np.flatnonzero(out < 0)
        if len(new):
            order = new[np.lexsort((k2[new], k1[new]))]
            a, c = k1[order], k2[order]
            first = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
            heads = order[first]
            numbers = self.add([b[s:e].tobytes() for s, e in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)])
            self.k1[numbers], self.k2[numbers] = k1[heads], k2[heads]
            self.place(numbers)
            out[order] = numbers[np.cumsum(first) - 1]
        np.add.at(self.hits, out, np.int32(1))
        return out


def latin_units(b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what SPLIT finds in the first n of b, lower-cased Latin-1 characters."""
    kind = KINDS[b[:n]]
    edge = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    used = kind[starts] != WHITE
    starts, ends = starts[used], ends[used]
    # A lone apostrophe takes s, t, m, d, re, ve or ll from the letters behind it.
    marks = np.flatnonzero((b[starts] == ord("'")) & (ends - starts == 1))
    x, y = b[starts[marks] + 1], b[starts[marks] + 2]
    pair = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    taken = np.where(np.isin(x, np.frombuffer(b"stmd", np.uint8)), 1, np.where(pair, 2, 0))
    marks, taken = marks[taken > 0], taken[taken > 0]
    ends[marks] += taken
    starts[marks + 1] += taken
    left = starts < ends
    return starts[left], ends[left]


def blank_units(b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but ASCII white space in the first n bytes."""
    kind = np.concatenate([[False], BLANK[b[:n]] != WHITE, [False]])
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    return edge[::2], edge[1::2]


class Encoder:
    """Ids of whole texts. Each distinct unit is encoded by the library once a worker and then remembered.

    Where the vocabulary normalises and splits texts by NORMALIZER and SPLIT, no token spans white space, so texts are cut into
    units first: what SPLIT finds, for texts of Latin-1 characters in which no special token can be meant, and for all others
    the runs between ASCII white space. With any other vocabulary the library gets each text whole.
    """

    #: Bytes worked on at once.
    CHUNK = 1 << 18

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end_id], np.uint32)
        spec = json.loads(self.tokenizer.to_str())
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_units = spec["normalizer"] == NORMALIZER and splits[0].get("pattern") == {"Regex": SPLIT} and spec["model"].get("end_of_word_suffix") == "</w>"
        self.mark = os.path.commonprefix([t["content"] for t in spec["added_tokens"]])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a pre-token
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.latin = Memory(lambda units: self.ids([u.decode("latin-1") for u in units], True))
        self.blank = Memory(lambda units: self.ids([u.decode("utf-8", "surrogatepass") for u in units], False))

    def ids(self, units: list[str], single: bool) -> list[np.ndarray]:
        """Ids of each unit. Where each is a single pre-token: many at once, with blanks between them."""
        out: list[np.ndarray] = []
        for a in range(0, len(units), 1000):
            some = units[a : a + 1000]
            if single:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(self.last[ids]) + 1
                if len(cuts) == len(some):
                    out += np.split(ids, cuts[:-1])
                    continue
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def cut(self, texts: list[bytes], memory: Memory) -> list[np.ndarray]:
        """Ids of texts that are cut into units."""
        latin = memory is self.latin
        data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(16), np.uint8)
        if latin:
            data = LOWER[data]
        starts, ends = (latin_units if latin else blank_units)(data, len(data) - 16)
        numbers = memory(data, starts, ends)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        upto = np.append(0, np.cumsum(memory.n[numbers]))[np.searchsorted(starts, bounds)]
        return np.split(memory.gather(numbers), upto[:-1])

    def whole(self, text: bytes, memory: Memory) -> np.ndarray:
        """Ids of a long text, a part at a time; parts end at white space."""
        out, a = [], 0
        while a < len(text):
            b = a + self.CHUNK
            if b < len(text):
                gap = re.compile(rb"[\x20\x09-\x0D]").search(text, b)
                b = gap.start() if gap else len(text)
            out += self.cut([text[a:b]], memory)
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        out: list[np.ndarray] = [self.end] * len(texts)
        if not self.by_units:
            for i, t in enumerate(texts):
                out[i] = np.append(np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32), self.end)
            return out
        held: dict[Memory, list[tuple[int, bytes]]] = {self.latin: [], self.blank: []}
        size = dict.fromkeys(held, 0)

        def flush(memory: Memory) -> None:
            if held[memory]:
                for (i, _), ids in zip(held[memory], self.cut([t for _, t in held[memory]], memory), strict=True):
                    out[i] = np.append(ids, self.end)
            held[memory], size[memory] = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            memory, data = self.blank, None
            if self.mark and self.mark not in t:
                try:
                    memory, data = self.latin, t.encode("latin-1")
                except UnicodeEncodeError:
                    memory = self.blank
            data = t.encode("utf-8", "surrogatepass") if data is None else data
            if len(data) > self.CHUNK:
                out[i] = np.append(self.whole(data, memory), self.end)
                continue
            held[memory].append((i, data))
            size[memory] += len(data)
            if size[memory] > self.CHUNK:
                flush(memory)
        for memory in held:
            flush(memory)
        return out


@functools.cache
def encoder(path: str, end_id: int) -> Encoder:
    """One a Python worker, for all its tasks."""
    return Encoder(path, end_id)


def write_tokens(docs: DataFrame, out: str, *, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", block_tokens: int = 1 << 20, parts: int | None = None) -> None:
    """Write token blocks in ascending doc_id order under out, a folder any of Spark's file systems can hold.

    Documents are dealt by ranges of doc_id and a hash of the text (no task gets more than its range, however long), sorted and encoded in one
    stream a task; a block closes at block_tokens ids, so memory is bounded by one block and the documents of a few MB. Rows:
    part, block, n_docs, n_tokens, payload (a self-contained block). Null ids sort first; rows of one id follow each other in
    the order of their texts' hashes, and equal rows in that of their places in the input, which must be files or a written
    table, so many rows of one id, or without any, are dealt over several tasks too, equal or not; null and empty texts have
    only the end id. Empty tables give no blocks. Any file of the tokenizers library will do as tokenizer.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        names: list[int | None] = []
        runs: list[np.ndarray] = []
        held = number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, number
            payload = encode_block(names, np.array([len(r) for r in runs]), np.concatenate(runs))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())})
            names.clear()
            runs.clear()
            held, number = 0, number + 1
            return row

        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                some = batch.slice(a, 128)
                for name, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    if held >= block_tokens:
                        yield close()
                    names.append(name)
                    runs.append(ids)
                    held += len(ids)
        if names:
            yield close()
        tidy()

    hashed = narrow.withColumn("hash", F.xxhash64("text")).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    dealt = hashed.repartitionByRange(parts, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    dealt.mapInArrow(blocks, "part int, block int, n_docs long, n_tokens long, payload binary").write.parquet(out)


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files at out: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for.

    Where a block starts comes from the narrow columns of all blocks: sums by part, then within each part.
    """
    files = spark.read.parquet(out)
    sizes = files.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("passed"))
    in_part = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    starts = sizes.withColumn("in_part", in_part).join(parts, F.col("part") == F.col("p")).select("part", "block", (F.col("passed") + F.col("in_part")).alias("offset"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                block = Block(payload.as_py())
                for a in range(0, block.n, READ):
                    bounds = block.bounds.values(a, min(a + READ, block.n) + 1)
                    runs = [block.ids[x:y].astype("<u4") for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    cols = {
                        "part": pa.array([part.as_py()] * len(runs), pa.int32()), "block": pa.array([number.as_py()] * len(runs), pa.int32()), "doc_id": pa.array(block.doc_ids[a : a + READ], pa.int64()),
                        "at": pa.array(bounds[:-1], pa.int64()), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array([zlib.crc32(r) for r in runs], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array([r.astype(np.int32) for r in runs], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(cols)

    schema = "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.select("part", "block", "payload").mapInArrow(documents, schema)
    starts = F.broadcast(starts) if few(sizes, BROADCAST_ROWS) else starts
    out_cols = ["doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return rows.join(starts, ["part", "block"]).select(*out_cols)


def token_table(docs: DataFrame, *, tokenizer: str, end_id: int = 2, **columns: str) -> DataFrame:
    """Write docs as token files in the shared folder and read them back: one row a document."""
    import uuid

    out = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, tokenizer=tokenizer, end_id=end_id, **columns)
    return read_tokens(docs.sparkSession, out)
