"""URL filters: host and path rules, and a path-template tree judged by smoothed labelled purity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: A segment is variable if it holds a digit, or if its parent has more children than this and it has less than an even share of the pages.
CHILDREN = 20
#: Siblings whose rates differ by at most this many standard errors are alike.
ERRORS = 2.0


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, with A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (host and path joined) that fits, and its verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def differ(hits: str, n: str, all_hits: str, all_n: str) -> Column:
    """Whether a branch's rate and its siblings' differ by more than ERRORS standard errors (of the add-one rates)."""
    rate = lambda h, m: (h + 1) / (m + 2)
    p, q = rate(F.col(hits), F.col(n)), rate(F.col(all_hits) - F.col(hits), F.col(all_n) - F.col(n))
    return F.abs(p - q) > ERRORS * F.sqrt(p * (1 - p) / (F.col(n) + 2) + q * (1 - q) / (F.col(all_n) - F.col(n) + 2))


def variable(segment: Column) -> Column:
    """* and the ending of a file's name for a segment with a digit; other segments as they are."""
    return F.when(segment.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0))).otherwise(segment)


def templates(paths: DataFrame) -> DataFrame:
    """Adds template to a row for each host and path with the counts n, labelled and bad.

    Level by level, from the root of each host to the last segment of its deepest path: a segment with a digit is variable, and
    so is a rare one among many siblings (written *). Siblings of one shape (whether most of their pages go deeper, and to
    variable children; written ~ with d and v) are merged where neither these shares nor their share of bad labels differs from
    that of the other siblings of the shape; a branch without labels has no such share to differ in, so it joins labelled ones
    that look like it, and their evidence reaches its pages.

    The tree's nodes are sums over the rows of paths, so a host of any size is spread over the cluster. Each round writes the
    paths that still have segments. A path that shares its template so far with no other has no siblings further down, so its
    template is finished at once; rounds go on only as deep as paths share templates.
    """
    size = F.size("segments")
    rows = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    done = [rows.where(size == 0)]
    rows, d = written(rows.where(size > 0), "url_level"), 0
    counts, keys = ("n", "labelled", "bad", "deeper", "varied"), ["host", "template"]
    while not rows.isEmpty():
        child = F.get("segments", F.lit(d + 1))
        rows = rows.withColumn("segment", variable(F.get("segments", F.lit(d)))).withColumn("deeper", F.when(size > d + 1, F.col("n")).otherwise(0)).withColumn("varied", F.when(child.rlike("[0-9]"), F.col("n")).otherwise(0))
        nodes = rows.groupBy(*keys, "segment").agg(F.count("*").alias("paths"), *[F.sum(x).alias(f"c_{x}") for x in counts])
        most = lambda x, mark: F.when(F.col(f"c_{x}") * 2 > F.col("c_n"), mark).otherwise("")
        nodes = written(nodes.withColumn("shape", F.concat(most("deeper", "d"), most("varied", "v"))), "url_nodes")
        parents = nodes.groupBy(*keys, "shape").agg(F.count("*").alias("like"), *[F.sum(f"c_{x}").alias(f"p_{x}") for x in counts])
        every = nodes.groupBy(*keys).agg(F.count("*").alias("children"), F.sum("c_n").alias("every_n"), F.sum("paths").alias("every_path"))
        rare = (F.col("children") > CHILDREN) & (F.col("c_n") * CHILDREN < F.col("every_n"))
        judged = (F.col("c_labelled") > 0) & (F.col("p_labelled") > F.col("c_labelled"))
        alike = (F.col("like") > 1) & ~differ("c_varied", "c_n", "p_varied", "p_n") & ~differ("c_deeper", "c_n", "p_deeper", "p_n") & (~judged | ~differ("c_bad", "c_labelled", "p_bad", "p_labelled"))
        kind = F.when(F.col("segment").startswith("*"), F.col("segment")).when(rare, "*").when(alike, F.concat(F.lit("~"), "shape")).otherwise(F.col("segment"))
        named = written(nodes.join(parents, [*keys, "shape"]).join(every, keys).select(*keys, "segment", kind.alias("kind"), (F.col("every_path") == 1).alias("alone")), "url_kinds")
        rest = F.transform(F.slice("segments", d + 2, F.greatest(size - (d + 1), F.lit(0))), variable)
        grown = F.concat_ws("/", "template", "kind", F.when(F.col("alone"), rest).otherwise(F.array().cast("array<string>")))
        rows = written(rows.join(named, [*keys, "segment"]).select("host", "path", "n", "labelled", "bad", "segments", grown.alias("template"), (F.col("alone") | (size == d + 1)).alias("ended")), "url_level")
        done.append(rows.where("ended").drop("ended"))
        rows, d = rows.where("not ended").drop("ended"), d + 1
    return reduce(DataFrame.unionByName, done).drop("segments")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, page_id: str = "page_id", url: str = "url", alpha: float = 4.0, purity: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share of every row.

    rules are (verdict, host/path) with verdict allow or block; they fit a host and its subdomains where the path starts with
    the rule's, the longest wins, and the pages they judge are the labelled ones. Other pages get the verdict of their
    template: block where its share of bad labels, smoothed by alpha pages at the overall rate, is at least purity. A template
    without labels is allowed. Null urls and those without :// have an empty host and path and are judged likewise; null ids
    stay null; repeated rows all count and come out; empty tables give no rows; other columns are ignored.
    """
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = written(base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled")), "url_rules")
    paths = ruled.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    placed = written(templates(paths), "url_templates")
    counts = placed.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    bad, labelled = placed.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    overall = (bad + 1) / (labelled + 2)
    share = (F.col("bad") + alpha * overall) / (F.col("labelled") + alpha)
    judged = placed.select("host", "path", "template").join(
        counts.select("host", "template", share.alias("bad_share"), (F.col("labelled") > 0).alias("known")), ["host", "template"]
    )
    verdict = F.coalesce("ruled", F.when(F.col("known") & (F.col("bad_share") >= purity), "block").otherwise("allow"))
    return ruled.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_share")
