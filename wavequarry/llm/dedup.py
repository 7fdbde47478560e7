"""Near-duplicates: min-max hashing with bands, exact confirmation on full shingle sets, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, tidy, written

#: Bands of three permutations; each permutation gives its minimum and its maximum, so a band has six values and 144
#: permutations give 288. A pair at similarity 0.8 misses all 48 bands with a probability of (1 - 0.8 ** 6) ** 48 < 5e-7 in
#: large sets. In small ones minimum and maximum agree less often: of 4 in 5 shingles with 4/5 * 3/4, a miss of 9e-6; 5 in 6: 5e-8.
BANDS, PER_BAND = 48, 3
PERMS = BANDS * PER_BAND
#: One bit of each of 256 values. At similarity 0.8, 25.6 of them differ on average, with a deviation of 4.8; more than 48 do with a probability under 1e-5.
SKETCH, MOST_DIFFERENT = 4, 48
#: Members of a hub that one task compares with it, about.
TOGETHER = 256
#: Most candidate ids to be broadcast (8 bytes each).
IDS = 1_000_000

_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1)
FLIP = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Words(dict):
    """Hashes of words, each computed once; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(data: bytes | None, k: int, words: Words) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes; the whole sequence as one if it is shorter.

    Words are runs of anything but ASCII white space, with A-Z lower-cased (bytes.lower and bytes.split do just that).
    """
    found = (data or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(k, len(h))
    out = h[: len(h) - k + 1]
    for j in range(1, k):
        out = mixed(out) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return np.unique(mixed(out + np.uint64(k)))


def min_max(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Under each permutation of the 32-bit values, the least and the greatest: two values for one evaluation."""
    v = (sets >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMS, 0xFFFFFFFF, np.uint32), np.zeros(PERMS, np.uint32)
    for a in range(0, len(v), 2048):
        h = (v[None, a : a + 2048] ^ FLIP[:, None]) * MULTIPLY[:, None]
        low, high = np.minimum(low, h.min(axis=1)), np.maximum(high, h.max(axis=1))
    return low, high


def signature(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Keys of the bands, the sketch of single bits, and a fingerprint of the whole set."""
    low, high = min_max(sets)
    values = np.stack([low, high], axis=1).reshape(BANDS, 2 * PER_BAND).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(values.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    bits = (np.stack([low, high], axis=1).ravel()[: 64 * SKETCH] * np.uint32(0x85EBCA6B)) >> np.uint32(31)
    sketch = np.packbits(bits.astype(np.uint8)).view(np.int64)
    return key.view(np.int64), sketch, xxhash.xxh3_128_digest(sets.tobytes())


def signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, n, print, bands, sketch of every row; a row without words has n = 0 and no print."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            n, prints, bands, sketches = [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), k, words)
                b, sk, fp = signature(s) if len(s) else (None, None, None)
                n.append(len(s))
                prints.append(fp)
                bands.append(b)
                sketches.append(sk)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "print": pa.array(prints, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.list_(pa.int64()))})
        tidy()

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("data"))
    return narrow.mapInArrow(scan, "doc_id long, n long, print binary, bands array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union holds for the full sets.

    Of the members that an a has, TOGETHER at most go to one task, with one copy of its text ahead of theirs. So a hub's text
    isn't sent once a pair, its members are spread over tasks, and a task holds one set and compares it with one at a time.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, hubs = Words(), None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, part, b, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                a, part, b, s = a.as_py(), part.as_py(), b.as_py(), shingles(data.as_py(), k, words)
                if (a, part) != at:
                    at, hubs = (a, part), []
                if b is None:  # an id can have several texts
                    hubs.append(s)
                    continue
                both = [(len(np.intersect1d(s, h, assume_unique=True)), len(s) + len(h)) for h in hubs]
                if any(100 * n >= percent * (size - n) for n, size in both):
                    found.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})
        tidy()

    pairs = written(pairs, "dedup_pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    members = dealt.join(texts.select(F.col("doc_id").alias("b"), "data"), "b").select("a", "part", "b", "data")
    hubs = dealt.select("a", "part").distinct().join(texts.select(F.col("doc_id").alias("a"), "data"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "data")
    both = hubs.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return both.mapInArrow(confirm, "a long, b long").distinct()


def whole_sets(texts: DataFrame, k: int) -> DataFrame:
    """doc_id and set, the shingles as hashes of 64 bits, as confirmed() compares them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [shingles(t.as_py(), k, words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "set": pa.array(sets, pa.list_(pa.int64()))})
        tidy()

    return texts.select("doc_id", "data").mapInArrow(scan, "doc_id long, set array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b).

    Each round every node points to the first of itself and its neighbours in a hashed order, and edges are contracted along
    the pointers, until none is left. The hashed order makes the number of rounds logarithmic also for long chains. Hubs are
    safe: the first neighbour is a combinable minimum, and the joins on hubs are split by adaptive execution.
    """
    cur = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}_edges")
    roots = None
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("f"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        to = written(first.select("node", F.least(own, "f")["id"].alias("to")), f"{name}_to")
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("u")), to.select(F.col("node").alias("b"), F.col("to").alias("v"))
        cur = written(cur.join(left, "a").join(right, "b").where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), f"{name}_edges")
        if roots is None:
            roots = to.withColumnRenamed("to", "root")
        else:
            nxt = to.select(F.col("node").alias("root"), "to")
            roots = written(roots.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}_roots")
    return roots if roots is not None else cur.select(F.col("a").alias("node"), F.col("b").alias("root"))


def similar(x: str, y: str, percent: int):
    """What both rows' sizes and sketches must fulfil for a link: the bound on sizes is exact, that on sketches has a wide margin."""
    least = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    differ = sum(F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH))
    return least & (differ <= MOST_DIFFERENT)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links, itself included, and kept says that it is the row's own. A link is a
    pair with 100 * intersection >= percent * union of the sets of distinct k-word shingles. Texts without words (null, empty,
    white space) have no shingles, link with nothing and are kept. Rows with a null id link with nothing, have a null component
    and are kept. Rows that share an id are judged by their own texts, but two that each stand for their class are joined by
    the id. Empty tables give no rows; other columns are ignored.

    1. Equal sets form classes by fingerprint (a combinable minimum), so copies never meet in pairs.
    2. Class representatives share a bucket where a band agrees. Each is compared with its bucket's first member, and linked
       members form components.
    3. In buckets whose members aren't of one component yet, each is compared with a member that the bucket's key picks.
    4. In buckets that still aren't of one component, all pairs across components are compared, each in its first common
       bucket, by size, sketch and then whole sets within the join, so only links come out. No bucket, however large, is cut or
       skipped; the work there grows with the members outside the bucket's largest component times its size.
    All links are confirmed on the full sets. Texts of candidates alone are written once for that.
    """
    sig = written(signatures(docs, doc_id, text, k), "dedup_signatures")
    some = sig.where(F.col("n").__gt__(0) & F.col("doc_id").isNotNull())
    # What is aggregated by a key is written before it is joined by that key: two plain shuffles, whose hot keys adaptive execution splits.
    classes = written(some.groupBy("print").agg(F.min("doc_id").alias("rep")), "dedup_prints")
    rows = written(some.join(classes, "print").select("doc_id", "rep", "n", F.when(F.col("doc_id") == F.col("rep"), F.struct("print", "bands", "sketch")).alias("s")), "dedup_classes")
    # An id can stand for several classes, each by its own text.
    reps = rows.where(F.col("s").isNotNull()).select("doc_id", "n", "s.print", "s.bands", "s.sketch").dropDuplicates(["doc_id", "print"]).drop("print")
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("members"), F.min("doc_id").alias("first")).where("members > 1").drop("members"), "dedup_keys")
    buckets = written(keys.join(shared, "key"), "dedup_buckets")
    ids = buckets.select("doc_id").distinct()
    ids = written(ids, "dedup_ids")
    ids_side = F.broadcast(ids) if few(ids, IDS) else ids
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("data"))
    texts = written(narrow.join(ids_side, "doc_id").distinct(), "dedup_texts")
    marks = written(reps.join(ids_side, "doc_id"), "dedup_marks")

    def likely(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) that sizes and sketches don't rule out."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        m = marks.select("doc_id", "n", "sketch")
        return pairs.join(m.alias("x"), F.col("a") == F.col("x.doc_id")).join(m.alias("y"), F.col("b") == F.col("y.doc_id")).where(similar("x", "y", percent)).select("a", "b")

    def unresolved(links: DataFrame, name: str) -> DataFrame:
        """Members of buckets that aren't of one component: key, doc_id, root."""
        roots = components(links, name)
        rooted = buckets.select("key", "doc_id").join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        rooted = written(rooted, f"{name}_rooted")
        mixed_keys = written(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), f"{name}_keys")
        return written(rooted.join(mixed_keys, "key"), f"{name}_open")

    links = written(confirmed(likely(buckets.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))), texts, k, percent), "dedup_links")
    open_1 = unresolved(links, "dedup_1")
    picked = written(open_1.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "doc_id").alias("h"), F.col("doc_id").alias("id"), "root")).alias("p")), "dedup_picked")
    pairs = open_1.join(picked, "key").where(F.col("root") != F.col("p.root")).select(F.col("doc_id").alias("a"), F.col("p.id").alias("b"))
    links = written(links.unionByName(confirmed(likely(pairs), texts, k, percent)), "dedup_links")
    open_2 = unresolved(links, "dedup_2")
    sets = written(whole_sets(texts.join(open_2.select("doc_id").distinct(), "doc_id"), k), "dedup_sets")
    # Each bucket's largest component meets the members outside it, not itself.
    roots_of = open_2.groupBy("key", "root").agg(F.count("*").alias("members"))
    top = written(roots_of.groupBy("key").agg(F.max(F.struct("members", "root")).alias("m")).select("key", F.col("m.root").alias("top")), "dedup_top")
    open_2 = open_2.join(top, "key").join(marks, "doc_id").join(sets, "doc_id")
    x, y = open_2.where("root <> top").alias("x"), open_2.alias("y")
    first_common = F.filter(F.zip_with(F.col("x.bands"), F.col("y.bands"), lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())[0]
    # The intersection stands in the condition once: written twice, it would be worked out ahead of the cheap bounds.
    enough = (100 + percent) * F.size(F.array_intersect("x.set", "y.set")) >= percent * (F.size("x.set") + F.size("y.set"))
    once = (F.col("y.root") == F.col("y.top")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once
    across = x.join(y, apart & similar("x", "y", percent) & (first_common == F.col("x.key")) & enough)
    last = written(across.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), "dedup_across")
    roots = components(links.unionByName(last), "dedup_3")
    least = written(roots.groupBy("root").agg(F.min("node").alias("least")), "dedup_least")
    named = written(roots.join(least, "root").select("node", "least"), "dedup_components")
    joined = rows.join(named, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "rep").alias("component_id"))
    rest = sig.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = joined.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: one of each component, and all without words or without an id.

    Where several rows have the kept id of a component, the one whose text has the least hash stays (of equal texts, any one).
    """
    found = written(near_duplicates(docs, doc_id=doc_id, text=text, k=k, percent=percent).select("doc_id", F.col("n_shingles") > 0, "kept").toDF("__id", "words", "kept"), "dedup_found")
    gone = written(found.where("not kept").select("__id").distinct(), "dedup_gone")
    twice = written(found.where("kept AND words AND __id IS NOT NULL").groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id"), "dedup_twice")
    one_side = lambda ids: F.broadcast(ids) if few(ids, IDS) else ids
    kept = docs.join(one_side(gone), docs[doc_id].cast("long") == F.col("__id"), "left_anti")
    if twice.isEmpty():
        return kept
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    inner = kept.join(one_side(twice), kept[doc_id].cast("long") == F.col("__id"), "left_semi").where(has_words)
    # A least row is a combinable aggregate, so an id with many rows is no single task.
    least = inner.groupBy(F.col(doc_id)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias("__row")).select("__row.*")
    rest = kept.join(one_side(twice.withColumn("__many", F.lit(True))), kept[doc_id].cast("long") == F.col("__id"), "left").where(F.col("__many").isNull() | ~has_words).select(docs.columns)
    return rest.unionByName(least)
