"""Benchmark decontamination: a prefix-filtered join of item-sized windows with the documents' words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few, written

#: Anything that isn't part of a word: ASCII without digits and a-z (after lower-casing).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle. Windows of fewer words are one shingle.
SHINGLE = 3
#: Most windows, and most single shingles, to be broadcast (counted); beyond that they are shuffled.
WINDOWS, TOKENS = 100_000, 1_000_000
#: Rows of 64 bits in the filter for more shingles than that: 8 MB and their keys.
BITS = 1 << 20
#: Stands for a document's end; no word has a blank.
END = " "


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATOR), ""), F.array().cast("array<string>"))


def shingle_at(words: Column, i: Column, size: int) -> Column:
    """Hash of the size words from place i on."""
    return F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)])


def windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of the items, numbered: window, words; and whose they are: window, item. An item of fewer words is one window."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = written(items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("words")).distinct(), "window_items")
    found = written(each.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"), "windows")
    return found, written(each.where(F.col("item").isNotNull()).join(found, "words").select("window", "item"), "window_owners")


def among(places: DataFrame, tokens: DataFrame) -> DataFrame:
    """The places whose token is one of tokens; where these are over TOKENS, some others too: a token sets one bit of BITS rows."""
    if few(tokens, TOKENS):
        return places.join(F.broadcast(tokens), "token", "left_semi")
    row, bit = F.pmod("token", F.lit(BITS)), F.shiftrightunsigned("token", 58).cast("int")
    bits = tokens.groupBy(row.alias("row")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(shiftrightunsigned(token, 58) AS INT))")).alias("mask"))
    return places.join(F.broadcast(bits), row == F.col("row")).where(F.bit_get("mask", bit) == 1).drop("row", "mask")


def placed(docs: DataFrame, sizes: list[int], with_end: bool) -> DataFrame:
    """A row for each word of each document: place, and the shingle that begins there for each of the sizes (with_end: also one row for the end)."""
    ends = F.concat("words", F.array(F.lit(END))) if with_end else F.col("words")
    rows = docs.select("*", F.posexplode(ends).alias("place", "word"))
    n = F.size("words")
    tokens = [F.when(F.col("place") + s <= n, shingle_at(F.col("words"), F.col("place"), s)) for s in sizes]
    if with_end:
        tokens[0] = F.when(F.col("place") == n, F.lit(0).cast("long")).otherwise(tokens[0])
    if len(tokens) == 1:
        return rows.withColumn("token", tokens[0])
    return rows.withColumn("token", F.explode(F.array(*tokens)))


def find_windows(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    Words are runs of digits, a-z and all characters beyond ASCII, after lower-casing A-Z. A window is size consecutive words
    of an item, or the whole of a shorter item; a word of a document inside any occurrence of a window is hit; n_items counts
    the items with a window that occurs. Texts that are null or without words have no words and no hits; such items have no
    windows; null item ids count as no item, though their windows hit. Rows with the same id and text come out as often as
    they are in docs. Empty tables on either side are fine; other columns are ignored.

    A window must occur whole, so one shingle of it must: its prefix is the one rarest in all documents. The shingle's hash
    joins the documents' places with it; what is left must lie within the document (place and length), and the window's words
    are compared with the document's. Up to WINDOWS windows are broadcast, so documents are read in place and only hits and one
    row a document are shuffled. Beyond that, the places whose shingle a filter of all prefixes lets through are shuffled with
    the few words around them and joined once; adaptive execution splits a shingle that is at very many places. Either way the
    documents are read twice or thrice, however many windows there are. Which items have a window is looked up after the hits.
    """
    found, owners = windows(benchmark, item_id, item_text, size)
    sizes = sorted(r[0] for r in found.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(F.col(text)).alias("words"))
    shingle = F.least(F.size("words"), F.lit(SHINGLE))
    every = found.select("window", "words", shingle.alias("s"), F.explode(F.sequence(F.lit(0), F.size("words") - shingle)).alias("offset"))
    hashed = reduce(lambda c, s: F.when(F.col("s") == s, shingle_at(F.col("words"), F.col("offset"), s)).otherwise(c), sizes, F.lit(None).cast("long"))
    every = written(every.select("window", "words", "offset", hashed.alias("token")), "window_shingles")
    vocabulary = written(every.select("token").distinct(), "window_tokens")
    counts = written(among(placed(base.select("words"), sizes, False).select("token"), vocabulary).groupBy("token").count(), "window_counts")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "token", "words")).alias("p")
    prefix = written(every.join(counts, "token", "left").groupBy("window").agg(rarest).select("p.token", "p.offset", "window", F.col("p.words").alias("item_words")), "window_prefixes")
    start, n = F.col("place") - F.col("offset"), F.size("item_words")
    hit = F.struct(start.alias("start"), n.alias("n"))
    no_hit, no_size = F.lit(None).cast("struct<start:int,n:int>"), F.lit(None).cast("int")
    if few(prefix, WINDOWS):
        end = prefix.sparkSession.range(1).select(F.lit(0).cast("long").alias("token"), F.lit(0).alias("offset"), F.lit(None).cast("long").alias("window"), F.lit(None).cast("array<string>").alias("item_words"))
        fits = (start >= 0) & (start + n <= F.size("words"))
        same = F.when(fits, F.slice("words", F.greatest(start, F.lit(0)) + 1, F.greatest(n, F.lit(0))) == F.col("item_words"))
        is_end = F.col("item_words").isNull() & (F.col("place") == F.size("words"))
        joined = placed(base, sizes, True).join(F.broadcast(prefix.unionByName(end)), "token").where(is_end | same)
        hits = joined.select("doc_id", "text_hash", F.when(is_end, F.size("words")).otherwise(no_size).alias("n_words"), F.when(~is_end, hit).otherwise(no_hit).alias("hit"), "window")
    else:
        first = F.greatest(F.col("place") - size, F.lit(0))
        near = among(placed(base, sizes, False), prefix.select("token").distinct()).select("doc_id", "text_hash", "token", "place", first.alias("first"), F.slice("words", first + 1, 2 * size + 1).alias("around"))
        same = F.when(start >= F.col("first"), F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, n) == F.col("item_words"))
        hits = near.join(prefix, "token").where(same).select("doc_id", "text_hash", no_size.alias("n_words"), hit.alias("hit"), "window")
        hits = hits.unionByName(base.select("doc_id", "text_hash", F.size("words").alias("n_words"), no_hit.alias("hit"), F.lit(None).cast("long").alias("window")))
    per_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").cast("int").alias("copies"), F.collect_set("hit").alias("hits"), F.collect_set("window").alias("windows")
    )
    spots = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    per_doc = written(per_doc.select("doc_id", "text_hash", "n_words", "copies", F.size(spots).cast("long").alias("n_hit"), "windows"), "window_hits")
    owners = F.broadcast(owners) if few(owners, WINDOWS) else owners
    listed = per_doc.where("n_hit > 0").withColumn("window", F.explode("windows")).join(owners, "window", "left").groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.first("copies").alias("copies"), F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("item_list")
    )
    out = per_doc.where("n_hit = 0").select("doc_id", "text_hash", "n_words", "copies", "n_hit", F.array().cast("array<string>").alias("item_list")).unionByName(listed)
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_list").cast("long").alias("n_items"), F.sha2(F.array_join("item_list", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, that no window hits."""
    hit = find_windows(docs, benchmark, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, size=size).where("contaminated")
    gone = written(hit.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    on = docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__hash"))
    return docs.join(F.broadcast(gone) if few(gone) else gone, on, "left_anti")
