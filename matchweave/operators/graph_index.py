"""Approximate vector search by navigable small-world graphs, one per block of vectors.

Vectors are dealt into blocks of bounded size. Each block becomes a layered graph: a vector is put
in on a random number of layers and linked, on each, to at most M others that a greedy search
with a bounded queue finds near it (2 M on the lowest), preferring links that lead to different
places. The graphs are a written table. A search walks down the layers of every block's graph
and keeps the nearest it meets; the best of all blocks are scored again exactly and merged.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import written

M, EF = 16, 200
#: Vectors of one graph, and queries that meet a graph in one task.
BLOCK, QUERIES = 8192, 2048


class Graph:
    """A layered neighbour graph over unit vectors; near means a large inner product."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF, seed: int = 0):
        self.x, self.m, self.visited = np.ascontiguousarray(vectors, np.float32), m, 0
        n = len(self.x)
        height = (-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int) if n else np.empty(0, int)
        self.levels: list[np.ndarray] = [np.full((n, m if k else 2 * m), -1, np.int32) for k in range(int(height.max(initial=0)) + 1)]
        self.entry = -1
        top = -1
        for i in range(n):
            if self.entry < 0:
                self.entry, top = i, int(height[i])
                continue
            at = [self.entry]
            for level in range(top, -1, -1):
                if level > height[i]:
                    at = [self._search(self.x[i], at, 1, level)[0][1]]
                    continue
                near = self._search(self.x[i], at, ef // 2, level)
                chosen = self._spread(near, m)
                self.levels[level][i, : len(chosen)] = chosen
                for j in chosen:
                    self._link(j, i, level)
                at = [j for _, j in near]
            if height[i] > top:
                self.entry, top = i, int(height[i])

    def _link(self, at: int, new: int, level: int) -> None:
        row = self.levels[level][at]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        ids = np.append(row, new)
        scores = self.x[ids] @ self.x[at]
        kept = self._spread(sorted(zip(scores.tolist(), ids.tolist()), reverse=True), len(row))
        row[:] = -1
        row[: len(kept)] = kept

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of near ones, best first, those that are nearer to the place than to one taken before; then the rest."""
        ids = np.array([j for _, j in near])
        between = self.x[ids] @ self.x[ids].T
        taken: list[int] = []
        for k, (score, _) in enumerate(near):
            if len(taken) == most:
                break
            if not taken or between[k, taken].max() < score:
                taken.append(k)
        for k in range(len(near)):
            if len(taken) == most:
                break
            if k not in taken:
                taken.append(k)
        return ids[taken].tolist()

    def _search(self, q: np.ndarray, starts: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest that a walk meets, best first."""
        links = self.levels[level]
        seen = np.zeros(len(self.x), bool)
        seen[starts] = True
        found = [(float(s), j) for s, j in zip(self.x[starts] @ q, starts)]
        self.visited += len(starts)
        open_ = [(-s, j) for s, j in found]
        heapq.heapify(open_)
        heapq.heapify(found)
        while len(found) > ef:
            heapq.heappop(found)
        while open_:
            s, j = heapq.heappop(open_)
            if len(found) >= ef and -s < found[0][0]:
                break
            near = links[j]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            self.visited += len(near)
            scores = self.x[near] @ q
            if len(found) >= ef:
                keep = scores > found[0][0]
                near, scores = near[keep], scores[keep]
            for s, j in zip(scores.tolist(), near.tolist()):
                if len(found) < ef:
                    heapq.heappush(found, (s, j))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, j))
                else:
                    continue
                heapq.heappush(open_, (-s, j))
        return sorted(found, reverse=True)

    def search(self, q: np.ndarray, k: int, ef: int = EF) -> list[int]:
        """Numbers of the k nearest found."""
        if self.entry < 0:
            return []
        at = [self.entry]
        for level in range(len(self.levels) - 1, 0, -1):
            at = [self._search(q, at, 1, level)[0][1]]
        return [j for _, j in self._search(q, at, max(ef, k), 0)[:k]]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, entry=self.entry, m=self.m, **{f"l{k}": v for k, v in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        made, stored = cls.__new__(cls), np.load(io.BytesIO(data))
        made.x, made.entry, made.m, made.visited = stored["x"], int(stored["entry"]), int(stored["m"]), 0
        made.levels = [stored[f"l{k}"] for k in range(len(stored.files) - 3)]
        return made


def _unit(x: pd.Series) -> np.ndarray:
    v = np.stack(x.to_list()).astype(float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable(rows: DataFrame, key: str) -> DataFrame:
    """(key, x): vectors without a direction, or with null, NaN or infinite components, take no part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    size = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    return rows.select(key, x.alias("x")).where(F.col(key).isNotNull() & F.coalesce(finite, F.lit(False)) & (size > 0))


def build(items: DataFrame, block: int = BLOCK, m: int = M, ef: int = EF) -> DataFrame:
    """(block, dim, ids, graph) of items (item_id, embedding): the index, written."""
    ready = _usable(items, "item_id").withColumn("dim", F.size("x"))
    blocks = max(1, -(-ready.count() // block))

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id", kind="stable")  # whatever the order in which rows arrive
        graph = Graph(_unit(rows["x"]), m, ef)
        return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "dim": rows["dim"].iloc[:1].to_numpy(), "ids": [rows["item_id"].to_numpy(np.int64)], "graph": [graph.dump()]})

    dealt = ready.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block", "dim").applyInPandas(make, "block int, dim int, ids array<long>, graph binary"), "graphs")


def search(index: DataFrame, items: DataFrame, queries: DataFrame, k: int, ef: int = EF, digits: int = 6) -> DataFrame:
    """(query_id, item_id, score, rank, visited): of each query (query_id, embedding) the k nearest items
    found, itself excluded, by exact cosine, ties to the smaller id; and how many vectors all graphs
    compared with it."""
    asked = _usable(queries, "query_id").withColumn("dim", F.size("x"))
    shares = max(1, -(-asked.count() // QUERIES))
    left = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    blocks = index.select(F.col("block").alias("at"), F.col("dim").alias("dim")).distinct()  # a row per graph
    right = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int")).join(blocks, "dim")

    def meet(graphs: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graphs) and len(some):
            graph, ids = Graph.load(graphs["graph"].iloc[0]), graphs["ids"].iloc[0]
            for name, q in zip(some["query_id"], _unit(some["x"]).astype(np.float32)):
                before = graph.visited
                found = ids[graph.search(q, k + 1, ef)]
                out.append((name, found[found != name][:k], graph.visited - before))
        return pd.DataFrame(out, columns=["query_id", "found", "visited"])

    met = written(left.groupBy("block", "dim", "share").cogroup(right.groupBy("at", "dim", "share")).applyInPandas(meet, "query_id long, found array<long>, visited long"), "found")
    seen = met.groupBy("query_id").agg(F.sum("visited").alias("visited"))
    pairs = met.select("query_id", F.explode("found").alias("item_id"))
    x, y = _usable(items, "item_id"), _usable(queries, "query_id").withColumnRenamed("x", "y")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    score = F.round(dot(F.col("x"), F.col("y")) / (F.sqrt(dot(F.col("x"), F.col("x"))) * F.sqrt(dot(F.col("y"), F.col("y")))), digits)
    scored = pairs.join(x, "item_id").join(y, "query_id").select("query_id", "item_id", score.alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).join(seen, "query_id").select("query_id", "item_id", "score", "rank", "visited")
