"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks of queries and of candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Rows of a block of candidates and of a block of queries; with their scores these bound what a task holds.
CANDIDATES, QUERIES = 4096, 2048


def quantised(vec: Column) -> Column:
    """floor(256 * x) of each component as double, which holds it exactly. Null for vectors that are null or hold a component that is null or, times 256, not finite."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    # Through decimals or longs large values would be cut, so the floor is taken where there can be a fraction.
    floor = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return F.when(ok, F.transform(vec, lambda x: floor(x.cast("double") * SCALE)))


def rows_of(vectors: pa.ChunkedArray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of each component that isn't zero; rows are sparse and may differ in length. Weights as 64-bit whole numbers, or as Python's if exact."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(lists.offsets.to_numpy())
    weight = lists.flatten().to_numpy(zero_copy_only=False)
    weight = np.array([int(x) for x in weight], object) if exact else weight.astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = weight != 0
    return row[keep], term[keep], weight[keep]


def greatest(vectors: pa.ChunkedArray) -> float:
    """The greatest magnitude of a vector's components, times its length."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    all_of = lists.flatten().to_numpy(zero_copy_only=False)
    return float(np.abs(all_of).max()) * float(np.diff(lists.offsets.to_numpy()).max()) if len(all_of) else 0.0


def accumulate(queries: pa.ChunkedArray, candidates: pa.ChunkedArray) -> np.ndarray:
    """Scores of all queries (rows) against all candidates: for each term, its postings times the queries' weights are scattered into the dense scores. Where a sum could leave 64 bits, it is worked out in whole numbers of any size and held at their ends."""
    exact = greatest(candidates) * greatest(queries) >= float(1 << 62)
    row, term, weight = rows_of(candidates, exact)
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    starts = np.searchsorted(term, np.arange(int(term[-1]) + 2)) if len(term) else np.zeros(1, np.int64)
    scores = np.full((len(queries), len(candidates)), 0, object if exact else np.int64)
    for q, t, w in zip(*rows_of(queries, exact), strict=True):
        if t + 1 < len(starts) and (a := starts[t]) < (b := starts[t + 1]):
            if b - a == scores.shape[1]:  # a full posting list has each row once, in order
                scores[q] += weight[a:b] * w
            else:
                scores[q, row[a:b]] += weight[a:b] * w
    return np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64) if exact else scores


def best(names: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k highest scores of each row of scores, but for the query itself; ties to the smaller id."""
    out: tuple[list, list, list] = ([], [], [])
    for name, s in zip(names, scores, strict=True):
        other = np.flatnonzero(ids != name)
        s = s[other]
        if len(s) > k:
            at_least = np.partition(s, len(s) - k)[len(s) - k]
            pick = np.flatnonzero(s >= at_least)
        else:
            pick = np.arange(len(s))
        pick = pick[np.lexsort((ids[other[pick]], -s[pick]))[:k]]
        out[0].extend([int(name)] * len(pick))
        out[1].extend(ids[other[pick]].tolist())
        out[2].extend(s[pick].tolist())
    return out


def top_k(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", vec: str = "embedding", k: int = 5) -> DataFrame:
    """The k candidates of highest integer inner product for each query: query_id, rank (from 1), vec_id, score.

    queries says which rows are queries; candidates are all rows but those of the query's own id. Rows with a null id, a null
    vector or null or non-finite components take no part, nor do those with a component that isn't finite times 256. Scores are
    64-bit whole numbers; one beyond their range is held at its end, and such scores tie. Shorter vectors count as zero
    beyond their end. Ties go to the smaller id; rows of one id that tie all count. Empty tables, or no other rows, give no rows.

    Candidates are dealt into blocks by a hash of their places in the input, so that equal rows are dealt too, queries into blocks likewise; each pair of blocks is scored in
    one task that holds CANDIDATES + QUERIES rows and the scores of a few queries at a time, and returns k rows a query. All rows
    meet all queries, which is the exhaustive search asked for; nothing passes through the driver but two counts.
    """
    q = quantised(F.col(vec))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("v"), queries.alias("is_query")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    n_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    # The place is fixed before rows are copied, so that a row's copies keep to its block.
    rows = rows.withColumn("at", F.xxhash64(F.monotonically_increasing_id()))
    at = F.col("at")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("vec_id", "v", F.pmod(at, F.lit(n_blocks)).cast("int").alias("block"), every(q_blocks).alias("of"))
    asked = rows.where("is_query").select("vec_id", "v", every(n_blocks).alias("block"), F.pmod(at, F.lit(q_blocks)).cast("int").alias("of"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        if len(ids):
            step = max(1, (1 << 22) // len(ids))  # scores of 32 MB at a time
            for a in range(0, len(names), step):
                part = best(names[a : a + step], ids, accumulate(left["v"].slice(a, step), right["v"]), k)
                for x, y in zip(out, part, strict=True):
                    x.extend(y)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    scored = asked.groupBy("block", "of").cogroup(candidates.groupBy("block", "of")).applyInArrow(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
