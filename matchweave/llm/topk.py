"""Exact top-k inner products by no-random-access aggregation.

Each block of candidates keeps one sorted list per component. A query reads every list from
its good end (the top where its own component is positive, the bottom where it is negative)
in rounds, each twice as deep as the one before. What has been read of a candidate gives its lower and upper
score: an unread component lies between the list's worst value and the last value read. A
candidate whose upper score is under the k-th best lower score cannot qualify. When few can,
or the lists end, the scores of those left are computed exactly in 64-bit integers.

Queries and candidates meet in blocks of bounded size: a block of candidates takes each block
of queries in turn, keeps its best k per query, and a last ranking per query merges them.

Edge cases: vectors that are null or hold null or non-finite components take no part; vectors
of different lengths are never compared; rows that repeat a vec_id count once; ties go to the
smaller vec_id; fewer than k candidates are all returned; an empty table gives no rows.
Components are floor(scale * x) in 64-bit integers. Bounds are doubles; a slack above their
largest rounding error keeps every candidate that could qualify, so results are exact as long as
scores fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, usable

BLOCK, QUERY_BLOCK = 4096, 512
SCALE = 1024
#: A round that leaves at most this share of the pairs is the last one.
FEW = 0.02


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): the k best candidates of a block for each query."""
    n = len(ids)
    if not n or not len(query_ids):
        return []
    own = ids[:, None] == query_ids[None, :]
    alive = ~own
    if n > 4 * k:
        order = np.argsort(-x, axis=0, kind="stable")
        lists = np.take_along_axis(x, order, 0).astype(float)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), 0)
        values = x.astype(float)
        up, down = np.maximum(q, 0).T.astype(float), np.minimum(q, 0).T.astype(float)
        # what rounding can do to a sum of so many products of this size, and some
        slack = (np.abs(q) @ np.abs(values).max(0)) * (4 * x.shape[1] * np.finfo(float).eps)
        depths = [n >> i for i in range(5, 0, -1) if n >> i >= k]
        for depth in [*depths, n - n // 4]:
            top, bottom = (place < depth).astype(float), (place >= n - depth).astype(float)
            read = (values * top) @ up + (values * bottom) @ down
            upper = read + (1 - top) @ (up * lists[depth - 1][:, None]) + (1 - bottom) @ (down * lists[n - depth][:, None])
            lower = read + (1 - top) @ (up * lists[-1][:, None]) + (1 - bottom) @ (down * lists[0][:, None])
            lower[own] = -np.inf
            alive = (upper >= np.partition(lower, n - k, axis=0)[n - k] - 2 * slack) & ~own
            if alive.mean() <= FEW:
                break
    out = []
    for j, query in enumerate(query_ids):
        left = np.flatnonzero(alive[:, j])
        score = x[left] @ q[j]
        if len(left) > 4 * k:
            kth = np.partition(score, len(left) - k)[len(left) - k]
            keep = score >= kth
            left, score = left[keep], score[keep]
        first = np.lexsort((ids[left], -score))[:k]
        out += [(int(query), int(ids[left[i]]), int(score[i])) for i in first]
    return out


def search(rows: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by ``every``."""
    whole = usable(rows).withColumn("v", F.transform("embedding", lambda x: F.floor(x * scale).cast("long"))).select("vec_id", "dim", "v")
    is_query = F.col("vec_id") % every == 0
    n, m = rows.select(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    # rows of one vec_id share a block
    left = whole.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = whole.where(is_query).dropDuplicates(["vec_id"])
    right = asked.withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            candidates = candidates.drop_duplicates("vec_id")
            x, q = np.stack(candidates["v"].to_list()).astype(np.int64), np.stack(queries["v"].to_list()).astype(np.int64)
            ids = candidates["vec_id"].to_numpy()
            for at in range(0, len(ids), 2 * block):  # hashing can overfill a block
                for to in range(0, len(queries), 2 * query_block):
                    found += search_block(ids[at : at + 2 * block], x[at : at + 2 * block], queries["vec_id"].to_numpy()[to : to + 2 * query_block], q[to : to + 2 * query_block], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = left.groupBy("dim", "b", "q").cogroup(right.groupBy("dim", "b", "q")).applyInPandas(meet, "query_id long, vec_id long, score long")
    return best(met, k, nearest=False)
