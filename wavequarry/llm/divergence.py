"""Source divergence audit: how far apart the sources of a lang are in their words, and which words set each source apart."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

SCALE = 1_000_000_000
#: Terms of a shard of a lang's vocabulary, about; with it a resident, a visitor and the heap of a meeting are bounded.
SHARD = 1 << 14
#: Different terms that a task counts before it hands its counts on.
HELD = 200_000
#: Bytes of visiting vectors that one lap of rounds sends, about. More rounds than that go into further laps.
LAP = 1 << 30

#: Bytes of terms: letters, A-Z as a-z, and whatever isn't ASCII; all else parts terms.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents with it): counts of whole texts, summed up in each task before they are handed on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                k = len(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * k, pa.string()), "source": pa.array([source] * k, pa.string()), "term": pa.array(list(n), pa.binary()).cast(pa.string()), "n": pa.array(list(n.values()), pa.int64()), "df": pa.array([df[t] for t in n], pa.int64())})
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = Counter(text.as_py().translate(TERM_BYTES).split())
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(own)
                df.update(own.keys())
                size += len(n)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()
        tidy()

    found = docs.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def chance(count: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + size)); in whole numbers of any size where 64 bits could overflow."""
    if len(count) and (int(count.max()) + 1) * SCALE >= 1 << 63:
        return np.array([1 + SCALE * (int(c) + 1) // (total + size) for c in count], np.int64)
    return 1 + SCALE * (count.astype(np.int64) + 1) // max(total + size, 1)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so 64 bits hold the square."""
    d = p - q
    return d * d // q


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: gaps between ascending ids and counts, each in the least width that holds them, compressed."""
    gaps = np.diff(ids, prepend=0)
    parts = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in (gaps, counts)]
    head = bytes([parts[0].itemsize, parts[1].itemsize]) + len(ids).to_bytes(6, "little")
    body = parts[0].tobytes() + parts[1].tobytes()
    return head + len(body).to_bytes(8, "little") + pa.compress(body, codec="lz4", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b, n, size = data[0], data[1], int.from_bytes(data[2:8], "little"), int.from_bytes(data[8:16], "little")
    body = pa.decompress(data[16:], decompressed_size=size, codec="lz4", asbytes=True)
    gaps, counts = np.frombuffer(body, f"u{a}", n), np.frombuffer(body, f"u{b}", n, a * n)
    return np.cumsum(gaps.astype(np.int64)), counts.astype(np.int64)


def settled(rows: DataFrame, top: int) -> DataFrame:
    """Each group's part of a shard: lang, source, shard, vector (compressed ids and counts) and heap, its terms with the highest values.

    rows: lang, source, shard, id, term, n, of_lang (occurrences in the lang), total, lang_total, vocabulary. A null id stands for a
    group without terms in the shard.
    """

    def settle(table: pa.Table) -> pa.Table:
        first = {c: table[c][0].as_py() for c in ("lang", "source", "shard", "total", "lang_total", "vocabulary")}
        rows = table.filter(pc.is_valid(table["id"])).sort_by("id")
        ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
        best: list[tuple[int, int]] = []
        if len(ids):
            p, q = chance(n, first["total"], first["vocabulary"]), chance(rows["of_lang"].to_numpy(), first["lang_total"], first["vocabulary"])
            ahead = np.flatnonzero(p > q)
            values = apart(p[ahead], q[ahead])
            # ids ascend with the terms' bytes, so ties go to the lesser term.
            best = heapq.nsmallest(top, zip((-values).tolist(), ahead.tolist(), strict=True))
        terms = rows["term"]
        heap = [[{"term": terms[i].as_py(), "value": -v} for v, i in best]]
        return pa.table({"lang": [first["lang"]], "source": [first["source"]], "shard": pa.array([first["shard"]], pa.int64()), "vector": pa.array([packed(ids, n)], pa.binary()), "heap": pa.array(heap, pa.list_(pa.struct({"term": pa.string(), "value": pa.int64()})))})

    return rows.groupBy("lang", "source", "shard").applyInArrow(settle, "lang string, source string, shard long, vector binary, heap array<struct<term:string,value:long>>")


def meetings(residents: DataFrame, first: int, last: int) -> DataFrame:
    """One lap: rounds first to last (exclusive) of every lang's tournament: lang, source, item, value, a row for each direction, meeting and shard.

    residents: lang, source, shard, place (of the source in its lang), teams (their number, made even by a bye), vector, total,
    vocabulary, terms (of the shard). By the circle method, in round r the last place meets r, and others meet whose places
    add up to 2 r modulo teams - 1. Of two that meet, one stays where it lives and the other's vector comes to it: the task
    that holds a resident sees it first and then its visitors by round, one at a time. Both directions are evaluated at once.
    """
    circle = F.col("teams") - 1
    rounds = F.sequence(F.lit(first), F.least(F.lit(last), circle) - 1)
    at_home = residents.where(F.col("teams") > first + 1)
    travels = at_home.withColumn("round", F.explode(rounds))
    opposite = F.pmod(2 * F.col("round") - F.col("place"), circle)
    rival = F.when(F.col("place") == circle, F.col("round")).when(opposite == F.col("place"), circle).otherwise(opposite)
    travels = travels.withColumn("rival", rival)
    # The lesser place is at home in even rounds, the greater in odd ones, so each group hosts about half of its meetings.
    away = F.when(F.col("round") % 2 == 0, F.col("place") > F.col("rival")).otherwise(F.col("place") < F.col("rival"))
    columns = ["lang", "shard", "host", "round", "source", "vector", "total", "vocabulary", "terms"]
    visitors = travels.where(away & (F.col("rival") < F.col("sources"))).withColumn("host", F.col("rival")).select(columns)
    both = visitors.unionByName(at_home.withColumn("host", F.col("place")).withColumn("round", F.lit(-1)).select(columns))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, where = None, None
        for batch in batches:
            out: dict[str, list] = {"lang": [], "source": [], "item": [], "value": []}
            names = batch.schema.names
            for row in zip(*[batch.column(c) for c in range(batch.num_columns)], strict=True):
                r = {k: v.as_py() for k, v in zip(names, row, strict=True)}
                ids, n = unpacked(r["vector"])
                own = (ids, chance(n, r["total"], r["vocabulary"]), int(chance(np.zeros(1, np.int64), r["total"], r["vocabulary"])[0]) if r["vocabulary"] else 1)
                if r["round"] < 0:
                    home, where = (r["source"], own), (r["lang"], r["shard"], r["host"])
                    continue
                assert home is not None and where == (r["lang"], r["shard"], r["host"])
                (name, (ids_a, p_a, none_a)), (ids_b, p_b, none_b) = home, own
                every = np.union1d(ids_a, ids_b)
                p, q = np.full(len(every), none_a, np.int64), np.full(len(every), none_b, np.int64)
                p[np.searchsorted(every, ids_a)] = p_a
                q[np.searchsorted(every, ids_b)] = p_b
                rest = r["terms"] - len(every)
                gap = (none_a - none_b) ** 2
                there, back = int(apart(p, q).sum()) + rest * (gap // none_b), int(apart(q, p).sum()) + rest * (gap // none_a)
                for a, b, v in ((name, r["source"], there), (r["source"], name, back)):
                    for k, x in zip(out, (r["lang"], a, b, v), strict=True):
                        out[k].append(x)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in out.items()})

    dealt = both.repartition("lang", "shard", "host").sortWithinPartitions("lang", "shard", "host", "round")
    return dealt.mapInArrow(meet, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200, shard: int = SHARD, lap: int = LAP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank.

    A term is a run of letters and characters beyond ASCII, A-Z lower-cased. A lang keeps the terms of at least `least` of its
    documents. Each (lang, source), and each lang, gives each kept term p = 1 + floor(10^9 (count + 1) / (N + V)). Pairs: for
    each other source of the lang the sum over all kept terms of floor((p - q)^2 / q). Terms: of those that occur in the
    source and have a higher p there than in the lang, the same value for one term; the `top` of them by value, then by the
    term's bytes. All in whole numbers.

    Null texts, langs and sources count as empty texts; a source whose documents are empty is a group like others. Without
    kept terms all pairs have the value 0. Repeated rows count as often as they are there. An empty table, and a lang of a
    single source, give no pairs. Extra columns are ignored.

    The vocabulary is dealt into shards, so no task holds a whole group; counts are summed up in each task first, so hot sources
    and terms are few rows. In each shard groups stay where they are and meet in the rounds of a tournament (`meetings`).
    """
    empty = lambda c: F.coalesce(docs[c], F.lit(""))
    slim = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("data"))
    groups = written(slim.select("lang", "source").distinct(), "audit_groups")
    counts = written(counted(slim), "audit_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("df").alias("df")).where(F.col("df") >= least)
    kept = written(kept.select("lang", "term", "of_lang"), "audit_kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("of_lang").alias("lang_total"))
    langs = groups.select("lang").distinct().join(langs, "lang", "left").na.fill(0).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / shard)).cast("long"))
    langs = written(langs, "audit_langs")
    dealt = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).drop("shards")
    words = written(dealt.withColumn("id", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")).cast("long")), "audit_terms")
    rows = written(counts.drop("df").join(words, ["lang", "term"]), "audit_rows")
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    known = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).withColumn("place", place).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    # An odd number of sources gets a bye, a place that nobody takes.
    known = written(known.join(langs, "lang").withColumn("teams", F.col("sources") + F.col("sources") % 2), "audit_known")
    each = known.select("lang", "source", "total", "lang_total", "vocabulary", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    full = each.join(rows, ["lang", "source", "shard"], "left")
    homes = written(settled(full, top), "audit_homes")
    sizes = words.groupBy("lang", "shard").agg(F.count("*").alias("terms"))
    residents = homes.drop("heap").join(known.drop("shards", "lang_total"), ["lang", "source"]).join(sizes, ["lang", "shard"], "left").na.fill(0, ["terms"])
    residents = written(residents, "audit_residents")
    size, teams = residents.agg(F.sum(F.length("vector") + 64), F.max("teams")).first()
    rounds = max((teams or 1) - 1, 1)
    per_lap = max(1, min(rounds, 2 * lap // max(size or 1, 1)))
    met = None
    for first in range(0, rounds, per_lap):
        part = written(meetings(residents, first, first + per_lap), "audit_meetings")
        met = part if met is None else met.unionByName(part)
    pairs = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = homes.select("lang", "source", F.explode("heap").alias("h")).select("lang", "source", F.lit("term").alias("part"), F.col("h.term").alias("item"), F.col("h.value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = pairs.unionByName(terms).withColumn("rank", rank.cast("int"))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
