"""Approximate nearest neighbours: a forest of random-projection trees.

Each tree splits a bounded sample by hyperplanes between two random points, at the median, until
``LEAF`` sample rows are left. The sample is chosen by hash and follows the row count: ``SAMPLE``
rows, or a fiftieth of all where that is more, up to ``MAX_SAMPLE``. So a leaf holds ``LEAF`` rows
of a small table, up to fifty times as many of one of ten million rows, and more only beyond.
Every row of the table is then sent to its leaf in every tree. A query walks all trees with one
priority queue ordered by how little a side misses it, takes ``PROBES`` leaves in all, and its
candidates in those leaves are ranked by their exact distance in double precision.

Leaves meet their queries in groups of about ``GROUP`` rows: (tree, branch, slot). A branch is
some neighbouring leaves, and their number follows the row count, so a query goes only to the
branches it probes; where a single leaf is larger than a group, slots deal its rows. Each group
keeps its best k per query, and a last ranking merges them.

Edge cases: vectors that are null, all zero, or hold null or non-finite components take no
part; vectors of different lengths are never compared (one forest per length); rows that
repeat a vec_id count once; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, usable

TREES, LEAF, PROBES, SAMPLE, MAX_SAMPLE = 8, 100, 256, 20_000, 200_000
#: Rows of one tree in one group, about.
GROUP = 4000


@dataclass
class Tree:
    normal: np.ndarray  # (nodes, dim)
    offset: np.ndarray
    child: np.ndarray  # (nodes, 2): node, or -1 - leaf
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64) if len(self.normal) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            side = (np.einsum("ij,ij->i", x[open_], self.normal[node]) >= self.offset[node]).astype(int)
            at[open_] = self.child[node, side]
        return -1 - at


def grow(x: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
    r = np.random.default_rng(seed)
    normal, offset, child = [], [], []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(8):
                a, b = x[r.choice(rows, 2, replace=False)]
                w = a - b
                p = x[rows] @ w
                cut = np.median(p)
                right = p >= cut
                if 0 < right.sum() < len(rows):
                    size = np.linalg.norm(w)
                    node = len(normal)
                    normal.append(w / size)
                    offset.append(cut / size)
                    child.append([0, 0])
                    child[node] = [split(rows[~right]), split(rows[right])]
                    return node
        leaves += 1
        return -leaves

    split(np.arange(len(x)))
    return Tree(np.array(normal).reshape(-1, x.shape[1]), np.array(offset), np.array(child, np.int64).reshape(-1, 2), leaves)


def probe(forest: list[Tree], q: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the most promising leaves over all trees, by one priority queue."""
    sides = [t.normal @ q - t.offset for t in forest]
    queue = [(0.0, k, 0 if len(t.normal) else -1) for k, t in enumerate(forest)]
    out = []
    while queue and len(out) < probes:
        miss, k, node = heapq.heappop(queue)
        while node >= 0:
            side = sides[k][node]
            near, far = forest[k].child[node, int(side >= 0)], forest[k].child[node, int(side < 0)]
            heapq.heappush(queue, (max(miss, abs(side)), k, int(far)))
            node = int(near)
        out.append((k, -1 - node))
    return out


def fit(rows: DataFrame, sizes: dict[int, int], trees: int, leaf: int, sample: int) -> dict[int, list[Tree]]:
    """A forest per vector length, from about ``sample`` rows of each or a fiftieth of them."""
    forests = {}
    for dim, n in sizes.items():
        want = min(max(sample, n // 50), max(sample, MAX_SAMPLE))
        every = max(1, -(-n // want))
        some = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(every)) == 0)).limit(2 * want)
        taken = some.select("vec_id", "embedding").toArrow().combine_chunks().sort_by("vec_id")
        x = taken["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        forests[dim] = [grow(x, 100 + t, leaf) for t in range(trees)]
    return forests


def search(rows: DataFrame, k: int = 10, every: int = 100, trees: int = TREES, leaf: int = LEAF, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by ``every``."""
    whole = usable(rows).where(F.exists("embedding", lambda x: x != 0))
    sizes = {r["dim"]: r["count"] for r in whole.groupBy("dim").count().collect()}  # lengths are few
    forests = fit(whole, sizes, trees, leaf, sample)
    n = max(sizes.values(), default=0)
    branches = max(8, n // GROUP)
    slots = max(1, n // (GROUP * min([branches, *(t.leaves for forest in forests.values() for t in forest)])))
    is_query = F.col("vec_id") % every == 0

    def branch(leaves: np.ndarray, tree: Tree) -> np.ndarray:
        return leaves * branches // max(1, tree.leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, g in batch.groupby("dim"):
                x = np.stack(g["embedding"].to_list())
                for t, tree in enumerate(forests[dim]):
                    leaves = tree.route(x)
                    yield pd.DataFrame({"dim": dim, "tree": t, "branch": branch(leaves, tree), "leaf": leaves, "vec_id": g["vec_id"].to_numpy(), "embedding": g["embedding"].to_numpy()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                at = {}
                for t, x in probe(forests[r.dim], r.embedding, probes):
                    at.setdefault((t, int(branch(x, forests[r.dim][t]))), []).append(x)
                rows += [(r.dim, t, b, leaves, r.vec_id, r.embedding) for (t, b), leaves in sorted(at.items())]
            yield pd.DataFrame(rows, columns=["dim", "tree", "branch", "leaves", "query_id", "embedding"])

    indexed = whole.mapInPandas(place, "dim int, tree int, branch int, leaf int, vec_id long, embedding array<double>").withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(slots)))
    asked = (
        whole.where(is_query)
        .dropDuplicates(["vec_id"])
        .mapInPandas(ask, "dim int, tree int, branch int, leaves array<int>, query_id long, embedding array<double>")
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    )

    def meet(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            candidates = candidates.drop_duplicates("vec_id").sort_values("leaf")
            x, ids, leaf_of = np.stack(candidates["embedding"].to_list()), candidates["vec_id"].to_numpy(), candidates["leaf"].to_numpy()
            for r in queries.itertuples():
                mine = np.flatnonzero(np.isin(leaf_of, r.leaves) & (ids != r.query_id))
                d = x[mine] - r.embedding
                score = np.sqrt((d * d).sum(1))
                first = np.lexsort((ids[mine], score))[:k]
                found += [(r.query_id, int(ids[mine[i]]), float(score[i])) for i in first]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["dim", "tree", "branch", "slot"]
    met = indexed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return best(met.dropDuplicates(["query_id", "vec_id"]), k, nearest=True)
