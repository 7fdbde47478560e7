"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_few, written

WORD = r"[^\x20\x09-\x0D]+"


def order_key(doc_id: Column, seed: int) -> Column:
    """Seeded place of a document in its source: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], epochs: int) -> DataFrame:
    """Water-filling over one row a source (source, source_size).

    Sources by code point, null last, take the weights in turn. The budget is share of all sizes. In ascending order of
    cap / weight, the first source whose cap the common level doesn't reach ends the clamped ones; what these leave over is
    shared by weight among the rest. This is the fixed point of clamping and resharing, in one pass and in whole numbers
    up to the last division. Adds weight, target and whole (full repetitions).
    """
    num, den = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy("ratio", "rank")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array([F.lit(w).cast("long") for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("clamped_sum", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left", F.lit(num) * F.sum("source_size").over(all_rows) - F.lit(den) * F.col("clamped_sum"))
        .withColumn("place", F.row_number().over(everything))
        .withColumn("fits", F.col("left") * F.col("weight") <= F.lit(den) * F.col("cap") * F.col("weight_left"))
        .withColumn("first", F.min(F.when(F.col("fits"), F.struct("place", "left", "weight_left"))).over(all_rows))
    )
    free = F.col("place") >= F.col("first.place")
    level = (F.col("weight") * F.col("first.left")).cast("double") / (F.lit(den) * F.col("first.weight_left")).cast("double")
    s = s.withColumn("target", F.when(free, level).otherwise(F.col("cap").cast("double")))
    return s.select("source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"))


def cut(rows: DataFrame, rests: DataFrame, name: str, last: bool = False) -> DataFrame:
    """Where the rest of each source ends in the order of a key: source, key, left.

    rows: source, size, key (hexadecimal digits, evenly spread); rests: source, rest. Sizes are summed by the first three digits
    of the key (4,096 ranges a source), which says in which range the rest ends; only that range is then summed key by key. So
    no source is ever in one task, however large. key is the first one whose sizes go beyond the rest, and left what of the rest
    its rows have. last: instead the last key whose middle lies within the rest, or
    the beginning of the keys that is behind all those.
    """
    ranges = rows.groupBy("source", F.substring("key", 1, 3).alias("range")).agg(F.sum("size").alias("range_size"))
    at = (
        ranges.withColumn("upto", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")))
        .alias("r")
        .join(rests.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .where(F.col("upto") > F.col("rest"))
        .groupBy(F.col("r.source").alias("source"))
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("range_size")).alias("passed"), "rest")).alias("cut"))
        .select("source", "cut.*")
    )
    at = written(at, f"{name}_ranges")
    inside = join_few(rows.alias("d"), at.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.substring("d.key", 1, 3) == F.col("c.range")), "inner", F.col("d.key"))
    peers = inside.groupBy(F.col("d.source").alias("source"), F.col("c.range").alias("range"), F.col("d.key").alias("key")).agg(F.sum("d.size").alias("size"), F.first("c.passed").alias("passed"), F.first("c.rest").alias("rest"))
    peers = peers.withColumn("upto", F.col("passed") + F.sum("size").over(Window.partitionBy("source", "range").orderBy("key")))
    if last:
        ends = peers.where(2 * F.col("upto") - F.col("size") < 2 * F.col("rest")).groupBy("source").agg(F.max("key").alias("key"))
        out = at.select(F.col("source").alias("__source"), "range").join(ends, F.col("__source").eqNullSafe(F.col("source")), "left").select(F.col("__source").alias("source"), F.coalesce("key", "range").alias("key"), F.lit(0.0).alias("left"))
    else:
        ends = peers.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("key", "upto", "size", "rest")).alias("e"))
        out = ends.select("source", "e.key", (F.col("e.rest") - (F.col("e.upto") - F.col("e.size"))).alias("left"))
    return written(out, f"{name}_cut")


def at_key(rows: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """The rows whose key is the one where their source's rest ends."""
    e = ends.select(F.col("source").alias("__source"), F.col("key").alias("__key"))
    return join_few(rows, e, F.col("source").eqNullSafe(F.col("__source")) & (F.col(key) == F.col("__key")), "left_semi", F.col(key)).select(rows.columns)


def plan(slim: DataFrame, weights: tuple[int, ...], share: tuple[int, int], epochs: int) -> tuple[DataFrame, DataFrame]:
    """A row a source: source, source_size, target, whole, first and second; and rests: source and rest.

    slim has source, size, key (of the id) and text_key. Documents whose key is below first get one more repetition, and of those
    with that key those whose text_key is below second. Rows with both keys are equal in id and text; rests says how many words
    of theirs are to be taken once more.
    """
    sources = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    sources = written(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix_sources")
    first = cut(slim.select("source", "size", "key"), sources.select("source", "rest"), "mix_first")
    of_id = at_key(slim, first, "key").select("source", "size", F.col("text_key").alias("key"))
    second = cut(of_id, first.select("source", F.col("left").alias("rest")), "mix_second")
    same = lambda x: F.col("s.source").eqNullSafe(F.col(f"{x}.source"))
    out = sources.alias("s").join(first.alias("a"), same("a"), "left").join(second.alias("b"), same("b"), "left")
    ends = out.select(F.col("s.source").alias("source"), "s.source_size", "s.target", "s.whole", F.coalesce("a.key", F.lit("")).alias("first"), F.coalesce("b.key", F.lit("")).alias("second"))
    return written(ends, "mix_plan"), second.select("source", F.col("left").alias("rest"))


def equals(rows: DataFrame, rests: DataFrame) -> DataFrame:
    """Of rows (source, size, row, ...) that are equal in id and text within a source, as many as the rests' words, a row more or less by half: again, 1 or 0. They are picked by the hash of their row numbers, which must have been written."""
    keyed = rows.withColumn("__pick", F.md5(F.col("row").cast("string")))
    ends = cut(keyed.select("source", "size", F.col("__pick").alias("key")), rests, "mix_third", last=True)
    e = ends.select(F.col("source").alias("__source"), F.col("key").alias("__last"))
    met = join_few(keyed, e, F.col("source").eqNullSafe(F.col("__source")), "left", F.col("__pick"))
    return met.withColumn("again", F.coalesce((F.col("__pick") <= F.col("__last")).cast("int"), F.lit(0))).select(*rows.columns, "again")


def _keyed(docs: DataFrame, doc_id: str, text: str, seed: int) -> tuple[Column, Column]:
    return order_key(docs[doc_id], seed).alias("key"), F.md5(F.xxhash64(docs[text]).cast("string")).alias("text_key")


def _slim(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(
        docs[doc_id].alias("doc_id"),
        docs[source].alias("source"),
        F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *_keyed(docs, doc_id, text, seed),
        F.monotonically_increasing_id().alias("row"),
    )


def _again(key: str = "key", text_key: str = "text_key") -> Column:
    """One more repetition: 1, 0, or null for rows at both keys, which equals() decides."""
    return F.when(F.col(key) < F.col("first"), 1).when(F.col(key) > F.col("first"), 0).when(F.col(text_key) < F.col("second"), 1).when(F.col(text_key) > F.col("second"), 0)


def mix_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 17) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, repeats.

    Size is the number of words (runs of anything but ASCII white space); null and empty texts have size 0 and add nothing.
    A null source is a source of its own, the last. Rows of one id (or without any) in a source are in the order of a hash of
    their texts, and of rows that are equal in id and text as many are taken once more as come nearest, so each source's words
    are within half a document of its target. A source without words has target 0. Empty tables give no rows. Other columns are
    ignored. The texts are read once; what is written for the later steps is a narrow row a document.
    """
    slim = written(_slim(docs, doc_id, text, source, seed), "mix_sizes")
    sources, rests = plan(slim, weights, share, epochs)
    out = join_few(slim.alias("d"), sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "inner", F.col("d.key"))
    out = out.select("d.*", "s.source_size", "s.target", "s.whole", _again().alias("again"))
    ends = equals(out.where("again IS NULL").drop("again"), rests)
    both = out.where("again IS NOT NULL").unionByName(ends)
    repeats = (F.col("whole") + F.col("again")).cast("long")
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 17) -> DataFrame:
    """The mixture itself: each row of docs, with all its columns, as often as mix_counts() says. Texts aren't shuffled; those of rows that are equal in id and text, one such group a source, are written once."""
    slim = written(_slim(docs, doc_id, text, source, seed), "mix_sizes")
    sources, rests = plan(slim, weights, share, epochs)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of its own, which can't clash
    at = {k: f"c{docs.columns.index(c)}" for k, c in (("id", doc_id), ("text", text), ("source", source))}
    keyed = inner.withColumns(dict(zip(("key", "text_key"), _keyed(inner, at["id"], at["text"], seed), strict=True)))
    out = join_few(keyed, sources, F.col(at["source"]).eqNullSafe(F.col("source")), "inner", F.col("key")).withColumn("again", _again())
    size = F.coalesce(F.regexp_count(F.col(at["text"]), F.lit(WORD)), F.lit(0)).cast("long")
    ends = written(out.where("again IS NULL").select(*inner.columns, "source", "whole", size.alias("size"), F.monotonically_increasing_id().alias("row")), "mix_equal")
    both = out.where("again IS NOT NULL").select(*inner.columns, "whole", "again").unionByName(equals(ends, rests).select(*inner.columns, "whole", "again"))
    copies = F.explode(F.array_repeat(F.lit(1), (F.col("whole") + F.col("again")).cast("int")))
    return both.withColumn("copy", copies).select(inner.columns).toDF(*docs.columns)
