"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dedup, divergence, manifest, mixing, phrases, quality, secrets, tokencount, tokenfile, topk, toxicity, urls
from .common import prepared, remainder, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = quality.fit_quality(docs, labels, allowed=~held_out)
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, sum(source_size) OVER ()::BIGINT AS total FROM src),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS weight, 2 * source_size AS cap FROM ranked),
o AS (SELECT *, row_number() OVER e AS place, coalesce(sum(cap) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clamped,
        (sum(weight) OVER () - coalesce(sum(weight) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weight_left
      FROM w WINDOW e AS (ORDER BY cap::DOUBLE / weight, rank)),
f AS (SELECT *, (3 * total - 2 * clamped) AS left_over, (3 * total - 2 * clamped) * weight <= 2 * cap * weight_left AS fits FROM o),
c AS (SELECT place, left_over, weight_left FROM f WHERE fits ORDER BY place LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN c.place IS NOT NULL AND f.place >= c.place THEN (f.weight * c.left_over)::DOUBLE / (2 * c.weight_left)::DOUBLE ELSE f.cap::DOUBLE END AS target FROM f LEFT JOIN c ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.k) AS own
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN 2 * upto - own < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken,
  (whole + CASE WHEN 2 * upto - own < 2 * rest THEN 1 ELSE 0 END)::BIGINT AS repeats FROM g
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 3) == 1
    net = toxicity.fit_toxicity(docs, labels, allowed=~held_out)
    return toxicity.score_toxicity(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def _op6_sql() -> str:
    def differ(hits: str, n: str) -> str:
        p, q = f"((c_{hits} + 1)::DOUBLE / (c_{n} + 2))", f"((p_{hits} - c_{hits} + 1)::DOUBLE / (p_{n} - c_{n} + 2))"
        return f"abs({p} - {q}) > 2.0 * sqrt({p} * (1 - {p}) / (c_{n} + 2) + {q} * (1 - {q}) / (p_{n} - c_{n} + 2))"

    rules = [("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/")]
    cases = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule, ruled = (" ".join(["CASE", *[f"WHEN {c[0]} THEN '{c[k]}'" for c in cases], "END"]) for k in (1, 2))
    counts = ("n", "labelled", "bad", "deeper", "varied")
    sums, totals = (", ".join(f"sum({a}{x})::BIGINT AS {b}_{x}" for x in counts) for a, b in (("", "c"), ("c_", "p")))
    shape = "CASE WHEN c_deeper * 2 > c_n THEN 'd' ELSE '' END || CASE WHEN c_varied * 2 > c_n THEN 'v' ELSE '' END"
    return rf"""WITH RECURSIVE b AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM b),
tree AS (SELECT host, path, count(*)::BIGINT AS n, count(ruled)::BIGINT AS labelled, count(CASE WHEN ruled = 'block' THEN 1 END)::BIGINT AS bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, '' AS template, 0::BIGINT AS d FROM r GROUP BY host, path
UNION ALL SELECT host, path, n, labelled, bad, segs, template, d FROM (
  WITH l AS (SELECT *, CASE WHEN regexp_matches(segs[d + 1], '[0-9]') THEN '*' || regexp_extract(segs[d + 1], '\.[A-Za-z]{{1,5}}$') ELSE segs[d + 1] END AS segment,
      CASE WHEN len(segs) > d + 1 THEN n ELSE 0 END AS deeper, CASE WHEN regexp_matches(coalesce(segs[d + 2], ''), '[0-9]') THEN n ELSE 0 END AS varied FROM tree WHERE len(segs) > d),
  c AS (SELECT *, {shape} AS shape FROM (SELECT host, template, segment, {sums} FROM l GROUP BY ALL)),
  p AS (SELECT host, template, shape, count(*) AS alike, {totals} FROM c GROUP BY ALL),
  e AS (SELECT host, template, count(*) AS children, sum(c_n)::BIGINT AS every_n FROM c GROUP BY ALL),
  k AS (SELECT host, template, segment, CASE WHEN starts_with(segment, '*') THEN segment WHEN children > 20 AND c_n * 20 < every_n THEN '*'
      WHEN alike > 1 AND NOT ({differ("varied", "n")}) AND NOT ({differ("deeper", "n")}) AND (NOT (c_labelled > 0 AND p_labelled > c_labelled) OR NOT ({differ("bad", "labelled")})) THEN '~' || shape ELSE segment END AS kind
      FROM c JOIN p USING (host, template, shape) JOIN e USING (host, template))
  SELECT l.host, l.path, l.n, l.labelled, l.bad, l.segs, l.template || '/' || k.kind AS template, l.d + 1 AS d FROM l JOIN k ON l.host = k.host AND l.template = k.template AND l.segment = k.segment)),
t AS (SELECT * FROM tree WHERE d = len(segs)),
o AS (SELECT (sum(bad)::BIGINT + 1)::DOUBLE / (sum(labelled)::BIGINT + 2) AS overall FROM t),
m AS (SELECT host, template, sum(labelled)::BIGINT AS labelled, (sum(bad)::BIGINT + 4.0::DOUBLE * any_value(overall)) / (sum(labelled)::BIGINT + 4.0::DOUBLE) AS bad_share FROM t, o GROUP BY host, template)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN m.labelled > 0 AND m.bad_share >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, t.template, m.bad_share
FROM r JOIN t ON r.host = t.host AND r.path = t.path JOIN m ON m.host = t.host AND m.template = t.template"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), vocabulary_path=tokenizer_path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


OP8_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: w[k:k + 9])) AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS size FROM iw),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT doc_id, size, k, w[k:k + size - 1] AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes)),
h AS (SELECT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
spots AS (SELECT doc_id, count(DISTINCT s)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS s FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path=tokenizer_path("piece_bpe_32k.model"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered_manifest(table(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    def leaf(text: str) -> str:
        each = [f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
        return f"sha256({' || '.join(each)})"

    # crc32 bit by bit over the bytes of the id's digits, which are ASCII.
    byte = "list_reduce(list_prepend(xor(c, ascii(id[i])::BIGINT), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, range(1, len(id) + 1)), lambda c, i: {byte}), 4294967295)"
    climb = "SELECT l + 1, g, r // 8, sha256(string_agg(h, '' ORDER BY r)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {0}) WHERE n > 1 GROUP BY l, g, r // 8"
    return f"""WITH RECURSIVE d AS (SELECT *, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other,
  CASE WHEN lang IS NULL THEN '-' ELSE ':' || lang END AS g FROM (SELECT *, doc_id::VARCHAR AS id FROM documents)),
x AS (SELECT doc_id, leaf, other, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
tree AS (SELECT 0 AS l, g, r, leaf AS h FROM x UNION ALL {climb.format("tree")}),
sub AS (SELECT g, arg_max(h, l) AS subroot, max(l) AS height FROM tree GROUP BY g),
lang AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS r FROM sub),
top AS (SELECT 0 AS l, '' AS g, r, subroot AS h FROM lang UNION ALL {climb.format("top")}),
root AS (SELECT arg_max(h, l) AS root, max(l) AS height FROM top),
steps AS (SELECT x.g, x.r, t.l, string_agg(t.h, '' ORDER BY t.r) FILTER (t.r < x.r // (8 ** t.l)::BIGINT) AS a, string_agg(t.h, '' ORDER BY t.r) FILTER (t.r > x.r // (8 ** t.l)::BIGINT) AS b
    FROM x JOIN sub USING (g) JOIN tree t ON t.g = x.g AND t.l < sub.height AND t.r // 8 = x.r // (8 ** (t.l + 1))::BIGINT GROUP BY ALL
  UNION ALL SELECT x.g, x.r, sub.height + t.l, string_agg(t.h, '' ORDER BY t.r) FILTER (t.r < lang.r // (8 ** t.l)::BIGINT), string_agg(t.h, '' ORDER BY t.r) FILTER (t.r > lang.r // (8 ** t.l)::BIGINT)
    FROM x JOIN sub USING (g) JOIN lang USING (g) JOIN root ON true JOIN top t ON t.l < root.height AND t.r // 8 = lang.r // (8 ** (t.l + 1))::BIGINT GROUP BY ALL),
proof AS (SELECT g, r, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY l) AS p FROM steps GROUP BY g, r),
fold AS (SELECT g, r, 0 AS l, coalesce(other, leaf) AS h FROM x UNION ALL SELECT f.g, f.r, f.l + 1, sha256(coalesce(s.a, '') || f.h || coalesce(s.b, '')) FROM fold f JOIN steps s ON s.g = f.g AND s.r = f.r AND s.l = f.l),
folded AS (SELECT g, r, arg_max(h, l) AS folded_root FROM fold GROUP BY g, r)
SELECT x.doc_id, x.leaf, sub.subroot, root.root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root.root AS verified
FROM x JOIN sub USING (g) JOIN root ON true JOIN folded USING (g, r) LEFT JOIN proof USING (g, r)"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
lt AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) AS p, 1 + (1000000000 * (lt.n + 1)) // (lt.total + v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term JOIN lt ON lt.lang = g.lang AND lt.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: prepared(f) for f in (op1_quality, op2_mixing, op3_toxicity, op4_near_duplicates, op5_top_k, op6_urls, op7_secrets, op8_decontamination, op9_tokens, op10_token_counts, op11_manifest, op12_divergence, op13_phrases)}
ORACLE_SQL = {"op2_mixing": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op5_top_k": OP5_SQL, "op6_urls": _op6_sql(), "op8_decontamination": OP8_SQL, "op11_manifest": _op11_sql(), "op12_divergence": OP12_SQL}
