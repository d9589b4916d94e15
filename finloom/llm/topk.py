"""Exact top-k search by tiled matrix products.

Vectors are dealt into shards, queries into blocks; every (block, shard) pair
meets in one task of bounded size, which multiplies tile by tile, selects the
best of each tile, and merges the lists. The lists of all shards are merged by
Spark, partially before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 65536
BLOCK_ROWS = 8192
TILE = 4096
SCHEMA = "query_id long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray, dim: int, scale: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.astype(np.float64)).reshape(-1, dim)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Of one tile whose ids ascend: row numbers, ids and scores of each query's ``k`` best; ties to the smaller id."""
    n = scores.shape[1]
    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    if n and np.abs(scores).max() < 2**62 // (n + 1):
        key = scores * n + (n - 1 - np.arange(n))
    else:  # too large for one combined key
        order = np.argsort(-scores.astype(object), axis=1, kind="stable")
        key = np.empty_like(scores)
        np.put_along_axis(key, order, np.broadcast_to(np.arange(n)[::-1], scores.shape), 1)
    low = -np.iinfo(np.int64).max  # its negative exists too
    for q in np.flatnonzero(first < last):
        key[q, first[q] : last[q]] = low
    keep = min(k, n)
    place = np.argpartition(-key, keep - 1, axis=1)[:, :keep] if keep < n else np.tile(np.arange(n), (len(own), 1))
    used = np.take_along_axis(key, place, 1) != low
    rows = np.repeat(np.arange(len(own)), keep).reshape(place.shape)
    return [rows[used], ids[place[used]], np.take_along_axis(scores, place, 1)[used]]


def _merged(lists: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    rows, ids, scores = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return [rows[rank < k], ids[rank < k], scores[rank < k]]


def _product(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    top = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * max(queries.shape[1], 1)
    if top < 2**53:  # doubles hold every partial sum exactly
        return (queries @ tile.T).astype(np.int64)
    return queries.astype(np.int64) @ tile.T.astype(np.int64)


def top_k(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best other rows by the inner product of floor(scale * x).

    Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; vectors of different lengths do not meet.
    Fewer candidates than ``k`` give fewer rows. Repeated rows are candidates
    each for itself; of a repeated query id the smallest vector asks. No rows
    give no rows.
    """
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & ~bad).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS), min(n // 2048, 6)), max(1, -(-n_queries // BLOCK_ROWS))
    hashed = F.xxhash64("id", "v")
    candidates = rows.select(
        "id", "v", "dim", F.pmod(hashed, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    asking = rows.where("q").select(
        "id", "v", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            own, asked = right["id"].to_numpy(), _matrix(right["v"], dim, scale)
            order = np.lexsort((*asked.T[::-1], own))
            own, asked = own[order], asked[order]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            own, asked = own[first], asked[first]
            ids, values = left["id"].to_numpy(), _matrix(left["v"], dim, scale)
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            found = []
            for a in range(0, len(own), 512):
                lists = []
                for b in range(0, len(ids), TILE):
                    scores = _product(asked[a : a + 512], values[b : b + TILE])
                    lists.append(_best(scores, ids[b : b + TILE], own[a : a + 512], k))
                while len(lists) > 1:
                    lists = [_merged(lists[i : i + 2], k) for i in range(0, len(lists), 2)]
                rows_, ids_, scores_ = lists[0]
                found.append([own[a : a + 512][rows_], ids_, scores_])
            out = [np.concatenate(x) for x in zip(*found)]
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    keys = ["block", "shard", "dim"]
    lists = candidates.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(meet, SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
