"""Token output: units of texts against the library, and how rows are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from wavequarry.llm import tokenfile
from wavequarry.llm.catalog import tokenizer_path
from wavequarry.session import ship


@pytest.fixture(scope="module", autouse=True)
def _ship(spark):
    ship(spark)


@pytest.mark.parametrize(("chunk", "most"), [(1 << 21, 600_000), (40, 100)])
def test_units_at_their_edges(chunk, most):
    """Contractions, kinds of characters, long units, texts in parts, a small memory."""
    from tokenizers import Tokenizer

    rng, path = random.Random(21), tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    latin, wide = "aZé' ßÀ².9\x85\xa0\t\n\x1c<|µªestmdrvl'''\x00", "aZé' ß²\x85\n\x1c—“ΣσİŁ<|endoftext|>́\x00"
    texts = ["".join(rng.choices(rng.choice((latin, wide)), k=rng.randrange(90))) for _ in range(2000)]
    texts += [None, "", "'", "'s", "'''s", "it's", "don't 've", "x'r", "x'l", "we'll'd", *["a" * n for n in (14, 15, 16, 17, 3000)], "-" * 40 + "'s"]
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    e = tokenfile.Encoder(path, 2)
    e.CHUNK, e.latin.MOST, e.blank.MOST = chunk, most, most
    got = [ids.tolist() for a in range(0, len(texts), 100) for ids in e(texts[a : a + 100])]
    assert e.by_units and got == want
    assert most > 100 or e.latin.count < 3000


def test_other_vocabularies_get_whole_texts():
    assert not tokenfile.Encoder(tokenizer_path("byte_bpe_50k.json"), 2).by_units


def test_rows_without_ids_are_dealt(spark, tmp_path):
    df = spark.createDataFrame([(None if i % 10 else i, f"text {i}") for i in range(440)], "doc_id long, text string")
    out = str(tmp_path / "tokens")
    tokenfile.write_tokens(df, out, tokenizer=tokenizer_path("word_bpe_49k.json"), parts=4)
    assert spark.read.parquet(out).agg(F.max("n_docs")).first()[0] < 200
    got = tokenfile.read_tokens(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 396 + [i for i in range(440) if i % 10 == 0]
