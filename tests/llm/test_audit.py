"""Manifest, divergence audit and phrase fingerprints against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.llm import divergence, manifest, phrases
from wavequarry.session import ship

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(got, want):
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t: sha("".join(enc(v) for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], t)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            b = i // 8 * 8
            yield "".join(level[b:i]), "".join(level[i + 1 : b + 8])
            i //= 8

    by = defaultdict(list)
    for d in rows:
        by[d["lang"]].append(d)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        by[g].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
    trees = {g: tree([leaf(d, d["text"]) for d in by[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    for k, g in enumerate(langs):
        for i, d in enumerate(by[g]):
            p = [*path(trees[g], i), *path(top, k)]
            changed = d["doc_id"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0
            x = leaf(d, d["text"].translate(LOW) if changed else d["text"])
            for a, b in p:
                x = sha(a + x + b)
            yield d["doc_id"], leaf(d, d["text"]), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in p)), x, x == top[-1][0]


DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "A b", None, "s", 3), (None, "A b", None, "s", 3), (5, None, "en", None, None), (5, "X", "en", "s", 1), (-7, "Hé", "en", "s", 2), (2**62, "", "fr", "s", 0), (-(2**63), "Low", "de", "", 3)]


@pytest.mark.parametrize("bucket", [manifest.BUCKET, 10])
def test_manifest(spark, bucket):
    # One id holds most rows: 700 copies and 90 other texts; ids around the edges of digits.
    rows = ODD + [(9, "Same", "en", "s", 4)] * 700 + [(9, f"T{i}", "en", "s", 4) for i in range(90)] + [(i, "Up", "pt", "s", 1) for i in (65535, 65536, 65537, 2**32, 2**48 - 1, -1, 0)]
    docs = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(c) for c in ("leaf", "n", "id", "grp", "at", "root", "chunk")])
    lower = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    got = manifest.manifest(docs, tampered=lower, changed_text=manifest.ascii_lower(F.col("text")), bucket=bucket).collect()
    want = list(plain_manifest([r.asDict() for r in docs.collect()]))
    same(got, want)
    assert {r.verified for r in got} == {True, False}


def test_manifest_small(spark):
    docs = spark.createDataFrame(ODD, DOC)
    assert manifest.tampered_manifest(docs.limit(0)).collect() == []
    one = docs.where("doc_id = 5 AND text = 'X'")
    got = manifest.tampered_manifest(one).collect()
    same(got, plain_manifest([r.asDict() for r in one.collect()]))
    assert got[0].leaf == got[0].subroot == got[0].root and got[0].proof_sha256 == sha("")
    # A proof holds with the siblings alone, and a text of another meaning breaks it.
    same(manifest.manifest(docs).select("doc_id", "verified").collect(), [(r[0], True) for r in ODD])


def test_manifest_of_many_langs(spark):
    rows = [(i, f"Text {i}", f"l{i % 70}", "s", i) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    same(manifest.tampered_manifest(docs).collect(), plain_manifest([r.asDict() for r in docs.collect()]))


def plain_divergence(rows, least=3, top=200):
    counts, df, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        terms = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text or "").split(" ")
        own = Counter(t for t in terms if t)
        counts[lang or "", source or ""].update(own)
        df[lang or ""].update(own.keys())
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        groups = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        share = lambda g: {t: 1 + 10**9 * (n + 1) // (sum(g.values()) + len(kept)) for t, n in g.items()}
        p, q = {s: share(g) for s, g in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:most])]
    return out


@pytest.mark.parametrize(("shard", "lap", "sources"), [(divergence.SHARD, divergence.LAP, 5), (3, 1, 6), (3, 700, 5), (4, 1, 1)])
def test_divergence(spark, shard, lap, sources):
    ship(spark)
    rnd = random.Random(sources)
    words = ["The", "the", "über", "Éa", "naïve", "x", "zeta", "ETA", "word9word", "né-né", "中文", "b" * 40]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))), rnd.choice(["en", "fr", None]), f"s{rnd.randint(1, sources)}") for _ in range(90)]
    rows += [(None, None, None), ("", "xx", "a"), ("9 9", "xx", "b"), ("one", "yy", "a"), ("one", "yy", ""), ("one", "yy", None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").select("*", *[F.lit(1).alias(c) for c in ("term", "n", "value", "id", "shard", "place")])
    same(divergence.divergence(docs, shard=shard, lap=lap, top=4).collect(), plain_divergence(rows, top=4))
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_chances_of_any_size():
    # A count whose share no longer fits in 64 bits on the way.
    n = np.array([0, 5, 10**15], np.int64)
    assert divergence.chance(n, 10**16, 3).tolist() == [1 + 10**9 * (int(x) + 1) // (10**16 + 3) for x in n]
    ids, counts = np.array([0, 3, 70_000], np.int64), np.array([1, 300, 2**40], np.int64)
    back = divergence.unpacked(divergence.packed(ids, counts))
    assert [x.tolist() for x in back] == [ids.tolist(), counts.tolist()]
    none = divergence.unpacked(divergence.packed(ids[:0], counts[:0]))
    assert [len(x) for x in none] == [0, 0]


def plain_phrases(text):
    seen, out, w = set(), [], ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            out.append(w)
            w = ""
    return out + [w] * bool(w)


def test_phrases_and_edits():
    rnd = random.Random(1)
    for k in range(400):
        text = "".join(rnd.choice("ab"[: rnd.randint(1, 2)] if k % 3 else "abcdefgh é中\U0001f600") for _ in range(rnd.randint(0, 200)))
        parsed = phrases.Parsed(text)
        assert parsed.phrases == plain_phrases(text) and len(set(parsed.hashes.tolist())) == len(set(parsed.phrases))
        start, rest = rnd.randint(0, len(text)), "".join(rnd.choice("abz") for _ in range(rnd.randint(0, 100)))
        edited, hashes = parsed.edited(start, rest)
        assert edited == text[:start] + rest and hashes.tolist() == phrases.Parsed(edited).hashes.tolist()


def test_hashes_in_blocks(monkeypatch):
    text = "the quick brown fox " * 50
    whole = phrases.Parsed(text).hashes.tolist()
    monkeypatch.setattr(phrases, "AT_ONCE", 7)
    assert phrases.Parsed(text).hashes.tolist() == whole


def test_likeness_is_the_share_of_phrases():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    errors = []
    for _ in range(30):
        a = " ".join(rnd.choice(words) for _ in range(1500))
        b = a[: rnd.randint(0, len(a))] + " ".join(rnd.choice(words) for _ in range(700))
        x, y = (phrases.Parsed(t) for t in (a, b))
        true = len(set(x.phrases) & set(y.phrases)) / len(set(x.phrases) | set(y.phrases))
        errors.append(phrases.likeness(*[phrases.least_hashes(p.hashes, 128) for p in (x, y)]) - true)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.15
    none = np.zeros(0, np.uint32)
    some = phrases.least_hashes(phrases.Parsed("abc").hashes, 128)
    assert (phrases.likeness(none, none), phrases.likeness(none, some), phrases.likeness(some, some)) == (1.0, 0.0, 1.0)


def plain_fingerprints(rows, kept):
    """Rows in their order, each with its next; the signature from whole sets."""

    def signature(text):
        return sorted({int(h) >> 32 for h in phrases.Parsed(text).hashes})[:kept]

    def alike(a, b):
        union = sorted({*a, *b})[:kept]
        return sum(x in a and x in b for x in union) / len(union) if union else 1.0

    name = lambda s: "".join(f"{x:08x}" for x in s)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = signature(text), signature(edited), signature(after)
        yield i, len(text), sha(edited), name(a), name(b), alike(a, b), alike(a, c)


@pytest.mark.parametrize(("partitions", "copies"), [(1, 1000), (7, 30)])
def test_fingerprints(spark, monkeypatch, partitions, copies):
    ship(spark)
    rnd = random.Random(2)
    rows = [(i * 7 - 40, " ".join(rnd.choice(["the", "née", "of", "Σ", "data", "\U0001f600"]) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    rows += [(None, None), (1000, "a" * 3000), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", *[F.lit(1).alias(c) for c in ("tie", "n", "range", "first", "to")])
    ordered = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = phrases.fingerprints(docs, kept=32).collect()
        same(got, plain_fingerprints(ordered, 32))
        assert phrases.fingerprints(docs.limit(0)).collect() == []
        one = docs.where("doc_id = 1000")
        same(phrases.fingerprints(one, kept=32).collect(), plain_fingerprints([(1000, "a" * 3000)], 32))
        monkeypatch.setattr(phrases, "COPIES", copies)
        # One id on all rows, most of them equal: no range holds them all, and the copies but the last are like their next.
        hot = spark.createDataFrame([(3, "same text as ever")] * 400 + [(3, chr(97 + i) * 20) for i in range(20)], "doc_id long, text string").repartition(4)
        found = phrases.fingerprints(hot, kept=32).collect()
        assert len(found) == 420 and len({r.fingerprint for r in found}) == 21 and sum(r.near_next == 1.0 for r in found) == 399
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
