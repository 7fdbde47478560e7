"""Merkle dataset manifest: exact ranks by digit histograms, and hash trees over the ranks' digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, join_few, written

FANOUT = 8
#: A chunk is a subtree of so many levels, worked out within one row.
LEVELS = 3
CHUNK = FANOUT**LEVELS
#: Digits of an id, of 16 bits and then of 12, from the first; the last histogram counts the ids that share all but their last digit.
SHIFTS = (48, 36, 24, 12)
#: Most different rows that may share all digits but the last before two more digits are told apart: the last, and one of the leaf.
BUCKET = 1 << 16


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, encoded one after another."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def group_key(lang: Column) -> Column:
    """A text for each lang that sorts nulls first and is never null."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), lang))


def digits(deep: bool) -> dict[str, Column]:
    """The digits by which rows are counted. A null id comes before all others. deep: two more, so that one id's rows are told apart by their leaf."""
    out = {f"d{k}": F.coalesce(F.shiftright("id", s), F.lit(-32769 if k == 0 else 0)) for k, s in enumerate(SHIFTS)}
    return out | ({f"d{len(SHIFTS)}": F.coalesce("id", F.lit(0)), f"d{len(SHIFTS) + 1}": F.substring("leaf", 1, 4)} if deep else {})


def digit_starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (grp, keys, n) with start: how many rows of the group come before, from running sums of n under each shorter prefix of the digits."""
    if len(keys) == 1:
        return counts.withColumn("start", F.sum("n").over(Window.partitionBy("grp").orderBy(*keys)) - F.col("n"))
    above = ["grp", *keys[:-1]]
    outer = digit_starts(counts.groupBy(*above).agg(F.sum("n").alias("n")), keys[:-1]).withColumnRenamed("start", "__outer").drop("n")
    inner = F.sum("n").over(Window.partitionBy(*above).orderBy(keys[-1])) - F.col("n")
    return counts.withColumn("__inner", inner).join(outer, above).withColumn("start", F.col("__outer") + F.col("__inner")).drop("__outer", "__inner")


def ranked(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows (grp, id, leaf, n, ...) with at: the rank in the group, by id and then leaf, of the first of their n copies.

    Digits of the id are counted, and the counts summed up level by level; rows are numbered only within those that share all
    counted digits. No window holds a whole group, and where ids repeat so often that it would, digits of the leaf go on.
    """
    some = rows.select("*", *[c.alias(k) for k, c in digits(False).items()])
    counts = written(some.groupBy("grp", *digits(False)).agg(F.sum("n").alias("n"), F.count("*").alias("m")), "manifest_counts")
    most = counts.agg(F.max("m")).first()[0] or 0
    keys = list(digits(most > bucket))
    if most > bucket:
        some = rows.select("*", *[c.alias(k) for k, c in digits(True).items()])
        counts = written(some.groupBy("grp", *keys).agg(F.sum("n").alias("n")), "manifest_counts")
    starts = digit_starts(counts.select("grp", *keys, "n"), keys).select("grp", *keys, "start")
    within = Window.partitionBy("grp", *keys).orderBy(F.asc_nulls_first("id"), "leaf").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum("n").over(within) - F.col("n")
    return some.withColumn("__inside", inside).join(starts, ["grp", *keys]).withColumn("at", F.col("start") + F.col("__inside")).drop("__inside", "start", *keys)


def chunked(nodes: DataFrame) -> DataFrame:
    """A row a chunk of CHUNK ranks: grp, chunk, size (nodes of the group), items, h0 (their hashes), the runs of eight of each level, and top.

    nodes: grp, at, n (copies), h, size, item. Levels end where the group has one node left, so only the only chunk of a group
    has fewer than LEVELS.
    """
    first, last = F.floor(F.col("at") / CHUNK), F.floor((F.col("at") + F.col("n") - 1) / CHUNK)
    runs = nodes.withColumn("chunk", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("at"), F.col("chunk") * CHUNK)
    runs = runs.withColumn("run", F.struct(start.alias("at"), (F.least(F.col("at") + F.col("n"), (F.col("chunk") + 1) * CHUNK) - start).cast("int").alias("n"), "h", "item"))
    rows = runs.groupBy("grp", "chunk").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("run")).alias("runs"))
    each = F.flatten(F.transform("runs", lambda r: F.array_repeat(F.struct(r["h"].alias("h"), r["item"].alias("item")), r["n"])))
    rows = rows.select("grp", "chunk", "size", each.alias("each")).select("grp", "chunk", "size", F.col("each.item").alias("items"), F.col("each.h").alias("h0"))

    def runs_of(level: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int")), lambda i: F.slice(level, i * FANOUT + 1, F.lit(FANOUT)))

    for k in range(LEVELS):
        rows = rows.withColumn(f"runs{k}", F.when(F.col("size") > FANOUT**k, runs_of(F.col(f"h{k}")))).withColumn(f"h{k + 1}", F.transform(f"runs{k}", lambda run: F.sha2(F.concat_ws("", run), 256)))
    return rows.withColumn("top", F.coalesce(*[F.col(f"h{k}")[0] for k in range(LEVELS, -1, -1)])).drop(*[f"h{k + 1}" for k in range(LEVELS)])


def siblings(p: Column, k: int) -> Column:
    """Left and right siblings, each as one text, that the node at place p of its chunk has at level k above it; null if there is no such level."""
    place = F.floor(p / FANOUT**k).cast("int")
    run, slot = F.get(f"runs{k}", F.floor(place / FANOUT).cast("int")), place % FANOUT
    return F.when(run.isNotNull(), F.struct(F.concat_ws("", F.slice(run, 1, slot)).alias("left"), F.concat_ws("", F.slice(run, slot + 2, F.lit(FANOUT))).alias("right")))


def opened(chunks: DataFrame) -> DataFrame:
    """Rows of chunks that know their path upwards: grp, at, item, h, path (siblings a level, from below), root."""

    def path(p: Column) -> Column:
        return F.filter(F.array(*[siblings(p, k) for k in range(LEVELS)]), lambda x: x.isNotNull())

    place = F.sequence(F.lit(0), F.size("h0") - 1)
    one = F.transform(place, lambda p: F.struct((F.col("chunk") * CHUNK + p).alias("at"), F.col("items")[p].alias("item"), F.col("h0")[p].alias("h"), F.concat(path(p), F.col("up")).alias("path")))
    return chunks.select("grp", F.explode(one).alias("x"), "root").select("grp", "x.*", "root")


def climbed(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Each node with its path and root, and (grp, root) of each group.

    Chunks are rows of CHUNK nodes; the tops of a group's chunks are the nodes of the next round, until each group has one. So a
    group of any size takes a shuffle of itself and few of its 512th part, and all chunks are of one size.
    """
    rounds, cur = [], nodes
    while True:
        chunks = written(chunked(cur), f"manifest_{name}_{len(rounds)}")
        rounds.append(chunks)
        above = chunks.where(F.col("size") > CHUNK)
        if above.isEmpty():
            break
        cur = above.select("grp", F.col("chunk").alias("at"), F.lit(1).cast("long").alias("n"), F.col("top").alias("h"), F.ceil(F.col("size") / CHUNK).alias("size"), F.lit(0).alias("item"))
    up = None
    for chunks in reversed(rounds):
        none = F.array().cast("array<struct<left:string,right:string>>")
        if up is None:
            known = chunks.withColumn("up", none).withColumn("root", F.col("top"))
        else:
            over = up.select("grp", F.col("at").alias("chunk"), F.col("path").alias("__path"), F.col("root").alias("__root"))
            known = chunks.join(over, ["grp", "chunk"], "left").withColumn("up", F.coalesce("__path", none)).withColumn("root", F.coalesce("__root", "top"))
        up = opened(known)
    roots = None
    for chunks in rounds:
        tops = chunks.where(F.col("size") <= CHUNK).select("grp", F.col("top").alias("root"))
        roots = tops if roots is None else roots.unionByName(tops)
    return up, roots


def numbered(groups: DataFrame) -> DataFrame:
    """groups with at, the place of grp in the order of its UTF-8 bytes: by ranges that are counted, so that any number of langs will do."""
    ranged = written(groups.repartitionByRange("grp").withColumn("__b", F.spark_partition_id()), "manifest_langs")
    starts = ranged.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__s"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("grp"))
    return ranged.withColumn("__at", inside).join(starts, "__b").withColumn("at", F.col("__s") + F.col("__at") - 1).drop("__b", "__s", "__at")


def manifest(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", tampered: Column | None = None, changed_text: Column | None = None, bucket: int = BUCKET) -> DataFrame:
    """The manifest with a proof for each row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row's leaf is the sha256 of its five values. A lang's leaves ascend by id; while there are several nodes, every eight in a
    row become the hash of their joined hex digests. What remains is the lang's subroot, and the subroots, in the order of their
    langs' bytes (null first), give the root in the same way. The proof is the hash of all siblings on the way up.
    folded_root is worked out from the row's leaf and its siblings alone; where tampered holds, from the leaf of a row with
    changed_text in place of the text. verified says whether it is the root.

    A null id comes before all others, rows of one id follow each other by leaf, and equal rows stand side by side. Null values
    and empty texts have leaves of their own. A lang of one row has its leaf as subroot, a single lang's subroot is the root.
    No rows give no rows. Extra columns are ignored, also those called like the ones used here.

    Ranks come from histograms of the ids' digits (`ranked`), the tree from subtrees by the rank's leading digits (`climbed`).
    The texts are read once and not shuffled; equal rows are counted first, so any number of copies is one row until the tree.
    """
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    changed_text = docs[text] if changed_text is None else changed_text
    values = [docs[c] for c in (doc_id, source, lang, n_chars)]
    other = F.when(tampered, leaf_hash(*values, changed_text))
    slim = docs.select(group_key(docs[lang]).alias("grp"), docs[doc_id].cast("long").alias("id"), leaf_hash(*values, docs[text]).alias("leaf"), other.alias("other"))
    rows = written(slim.groupBy("grp", "id", "leaf", "other").agg(F.count("*").alias("n")), "manifest_leaves")
    sizes = written(rows.groupBy("grp").agg(F.sum("n").alias("size")), "manifest_sizes")
    placed = join_few(ranked(rows, bucket).alias("r"), sizes.withColumnRenamed("grp", "__grp").alias("s"), F.col("grp") == F.col("__grp"), "inner", F.col("r.leaf"))
    nodes = placed.select("grp", "at", "n", F.col("leaf").alias("h"), "size", F.struct("id", "other").alias("item"))
    leaves, subroots = climbed(nodes, "leaves")
    langs = written(numbered(subroots), "manifest_subroots")
    total = langs.agg(F.count("*").alias("c")).first()["c"]
    tops, _ = climbed(langs.select(F.lit("").alias("grp"), "at", F.lit(1).cast("long").alias("n"), F.col("root").alias("h"), F.lit(total).cast("long").alias("size"), F.col("grp").alias("item")), "langs")
    tops = written(tops.select(F.col("item").alias("__grp"), F.col("h").alias("subroot"), F.col("path").alias("__over"), F.col("root").alias("top_root")), "manifest_tops")
    out = join_few(leaves, tops, F.col("grp") == F.col("__grp"), "inner", F.col("at"))
    path = F.concat("path", "__over")
    proof = F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"])))), 256)
    folded = F.aggregate(path, F.coalesce("item.other", "h"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    out = out.select(F.col("item.id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", F.col("top_root").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents whose rows of every third id (by crc32 of its digits, never for a null id) have their text's A-Z lower-cased after the tree was made."""
    return manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed_text=ascii_lower(F.col("text")))
