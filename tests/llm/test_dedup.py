"""Near-duplicates: shared ids, very long texts, and which rows stay."""

import random

import numpy as np
import pytest

from wavequarry.llm import dedup
from wavequarry.session import ship


@pytest.fixture(scope="module", autouse=True)
def _ship(spark):
    ship(spark)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_an_id_that_stands_for_two_classes(spark):
    words = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    x, y = map(" ".join, words)
    got = dedup.near_duplicates(frame(spark, [(5, x), (5, y), (6, x + " more"), (7, y + " more"), (8, "quite another text")]), k=4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


@pytest.mark.parametrize("share", [0.80001, 0.79999])
def test_long_texts_at_the_edge(spark, share):
    """150,000 words and more, in buckets that stay open until whole sets are compared."""
    rng = np.random.default_rng(3)
    n = 150_000
    a = rng.integers(0, 1 << 40, n)
    b = a.copy()
    cut = round(2 * n / (1 + share)) - n  # n common and this many on either side make the share
    both = n - cut
    b[both:] = rng.integers(0, 1 << 40, cut)
    x, y = " ".join(map(str, a)), " ".join(map(str, b))
    sets = [dedup.shingles(t.encode(), 4, dedup.Words()) for t in (x, y)]
    common = len(np.intersect1d(*sets))
    linked = 100 * common >= 80 * (len(sets[0]) + len(sets[1]) - common)
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(frame(spark, [(1, x), (2, y)]), k=4).collect()}
    assert got == {1: 1, 2: 1 if linked else 2}


def test_short_sets_keep_enough_room():
    """Distinct shingles that fall together as 32-bit hashes are fewer than the margin of the whole comparison."""
    rng = np.random.default_rng(4)
    for n in (1000, 130_000, 400_000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        lost = len(s) - len(np.unique((s >> np.uint64(32)).astype(np.uint32)))
        assert lost <= 6 + len(s) ** 2 / 2**31


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    rows = [(1, text), (1, text), (2, text + " end"), (3, ""), (3, ""), (None, text), (None, text), (1, ""), (4, "alone"), (4, "alone")]
    kept = sorted(((r[0] is not None, r[0] or 0, r[1]) for r in dedup.drop_near_duplicates(frame(spark, rows)).collect()))
    assert kept == sorted([(False, 0, text), (False, 0, text), (True, 1, text), (True, 1, ""), (True, 3, ""), (True, 3, ""), (True, 4, "alone")])


def test_only_links_leave_the_last_comparison(spark, monkeypatch):
    """Short texts that share buckets but aren't alike enough: no pair of them, however many there are, comes out of the join."""
    common = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join([*common, *(f"x{i}y{j}" for j in range(3))])) for i in range(24)]
    sizes, written = {}, dedup.written

    def counted(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "written", counted)
    got = dedup.near_duplicates(frame(spark, rows), k=4).collect()
    assert sizes["dedup_2_open"] > 24 and sizes["dedup_across"] == 0
    assert all(r["kept"] for r in got)
