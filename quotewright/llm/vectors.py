"""Exact top-k inner products by MaxScore, over shards of the vectors.

A dimension is a term, its column in a shard the posting list. What a term can add to a
query's score at most is its bound. Terms with low bounds that together cannot lift a
vector to the query's k-th best score so far are non-essential: the essential postings
are traversed for a block of vectors, the others are probed, highest bound first, only
for vectors that can still compete. The best of all shards are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotewright.llm.common import arrow_schema, stored

#: Vectors of a shard, queries of a block, vectors traversed at once, terms probed at once.
SHARD, QUERY_BLOCK, TRAVERSED, PROBED = 20_000, 2_000, 4_096, 8
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, its components times ``scale`` rounded down; one row per id.

    Rows without id or vector, or with missing or non-finite components, take no part.
    Of several vectors with one id the smallest counts.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return rows.select(F.col("vec_id").cast("long"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def longest(column: pa.ChunkedArray) -> int:
    return max((c.value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for c in column.chunks), default=0)


def max_score(query: np.ndarray, own: int, postings: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best vectors for a query; ``postings`` has a row per term, ids ascend."""
    bounds, floors = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    order = np.argsort(floors - bounds, kind="stable")
    rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the terms from each place on can add at most
    spread = np.append(np.cumsum((bounds - floors)[order][::-1])[::-1], 0)  # the same, above the least they add
    best_ids, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for start in range(0, len(ids), TRAVERSED):
        block = slice(start, start + TRAVERSED)
        full = len(best) == k
        least = best[-1] if full else None
        # non-essential: the last terms, as long as they alone cannot lift a vector to ``least``
        done = int(np.flatnonzero(spread <= least - floors.sum())[0]) if full and (spread <= least - floors.sum()).any() else len(order)
        essential = order[: max(1, done)]
        done = len(essential)
        score = query[essential] @ postings[essential, block]
        at = np.arange(start, start + len(score))
        while True:
            if full:
                alive = score + rest[done] > least  # an equal score loses to the smaller ids before it
                score, at = score[alive], at[alive]
            if done == len(order) or not len(at):
                break
            probe = order[done : done + PROBED]
            score = score + query[probe] @ postings[np.ix_(probe, at)]
            done += len(probe)
        other = ids[at] != own
        best_ids, best = np.concatenate((best_ids, ids[at][other])), np.concatenate((best, score[other]))
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
    return best_ids, best


def numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best ``candidates`` for each query but its own id.

    Both have vec_id and v, one row per id (``quantised``). Ties go to the smaller
    vec_id. Every block of queries meets every shard of candidates once.
    """
    shards = max(1, -(-candidates.count() // SHARD))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    left = queries.select("vec_id", "v", block.alias("block"), F.explode(numbers(shards)).alias("shard"))
    right = candidates.select("vec_id", "v", shard.alias("shard"), F.explode(numbers(blocks)).alias("block"))
    schema = arrow_schema(FOUND)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        width = max(longest(asked.column("v")), longest(held.column("v")))
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        held = held.sort_by("vec_id")
        ids, rows = held.column("vec_id").to_numpy(), matrix(held.column("v"), width)
        postings, high, low = np.ascontiguousarray(rows.T), rows.max(axis=0), rows.min(axis=0)
        asked_rows = matrix(asked.column("v"), width)
        if (np.abs(asked_rows).max(initial=0).astype(float) * np.abs(rows).astype(float).max(initial=0) * width) < 2**52:
            postings, high, low, asked_rows = (x.astype(np.float64) for x in (postings, high, low, asked_rows))  # exact, and faster
        found = [max_score(q, own, postings, ids, high, low, k) for q, own in zip(asked_rows, asked.column("vec_id").to_numpy(), strict=True)]
        sizes = [len(f[0]) for f in found]
        return pa.table([
            pa.array(np.repeat(asked.column("vec_id").to_numpy(), sizes), pa.int64()),
            pa.array(np.concatenate([f[0] for f in found]), pa.int64()),
            pa.array(np.concatenate([f[1] for f in found]).astype(np.int64), pa.int64())], schema=schema)

    cells = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
    ranked = cells.applyInArrow(search, FOUND).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` of the rows of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, against all."""
    rows = stored(quantised(vectors), "quantised")
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)


SQL = """
WITH sound AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) ranked WHERE rank <= 5
"""
