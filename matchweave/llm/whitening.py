"""Whitening of embeddings: principal components, each scaled to variance 1.

The fit list is each distinct vector once, in fixed point. The scatter of the centred list is summed
in tasks (a matrix of dimensions squared each) and added up. It is then factored on the driver,
where it is as small as the vectors are short: pivoted Cholesky gives V = L L' up to the rows'
order, and stops where the rank ends; one-sided Jacobi rotates the columns of L until they are
orthogonal. Their squared norms are V's eigenvalues and the normalised columns its eigenvectors,
to full relative precision, as no eigenvalue is ever formed from V itself. All vectors are
projected in tasks.

Edge cases: rows whose vector is null or empty, or holds null or non-finite entries, drop out;
vectors of different lengths are fitted apart; equal vectors count once in the fit, however many
rows have them, and each row gets its own result; components beyond the rank of the list (none, if
all vectors are equal) do not exist and give no rows; equal eigenvalues may share their plane in
any way; ``deviation`` is null where it passes 64 bits; entries beyond 2^56 in size are refused
with an error; a null vec_id is kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import finite

COMPONENTS = 16
#: Fixed point: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 56)
#: Vectors that are multiplied at once.
ROWS = 4096

_SCHEMA = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L of shape (d, rank) with v = L L', columns by falling pivot; rows are in v's own order."""
    d = len(v)
    left, done = v.diagonal().copy(), np.zeros(d, bool)
    columns: list[np.ndarray] = []
    tolerance = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for _ in range(d):
        pivot = int(np.where(done, -np.inf, left).argmax())
        if left[pivot] <= tolerance:
            break
        made = np.array(columns)  # (rank so far, d)
        column = v[:, pivot] - (made.T @ made[:, pivot] if columns else 0.0)
        column = column / np.sqrt(left[pivot])
        column[done] = 0.0
        column[pivot] = np.sqrt(left[pivot])
        columns.append(column)
        done[pivot] = True
        left = left - column * column
    return np.array(columns).T.reshape(d, len(columns))


def jacobi(factor: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns) of factor @ factor.T, by falling eigenvalue: columns are
    rotated in pairs, all disjoint pairs of a round at once, until every pair is orthogonal."""
    g = factor.copy()
    k = g.shape[1]
    if k > 1:
        ring = list(range(k + k % 2))  # with an odd number, one column rests each round
        for _ in range(sweeps):
            worst = 0.0
            for _ in range(len(ring) - 1):
                pairs = np.array([(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if max(a, b) < k])
                p, q = pairs[:, 0], pairs[:, 1]
                x, y = g[:, p], g[:, q]
                a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
                size = np.sqrt(a * b)
                ratio = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
                worst = max(worst, float(ratio.max()))
                turn = ratio > tolerance
                zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
                t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
                cos = 1 / np.sqrt(1 + t * t)
                sin = cos * t
                g[:, p], g[:, q] = cos * x - sin * y, sin * x + cos * y
                ring = [ring[0], ring[-1], *ring[1:-1]]
            if worst <= k * tolerance:
                break
    value = (g * g).sum(0)
    order = np.argsort(-value, kind="stable")
    value, g = value[order], g[:, order]
    return value, g / np.sqrt(value)


@dataclass
class Fit:
    """What one length of vectors needs: n and S of the list, V's trace, eigenvalues and eigenvectors."""

    n: int
    total: list[int]
    trace: float
    value: np.ndarray
    vector: np.ndarray
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n without losing digits: the whole part of the mean goes first, exactly."""
        whole = np.array([s // self.n for s in self.total], np.int64)
        rest = np.array([s % self.n / self.n for s in self.total])
        return (x - whole).astype(float) - rest

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        return self.centred(x) @ self.vector[:, :components] / np.sqrt(self.value[:components])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exactly."""
        whole = np.array([s // self.n for s in self.total], np.int64)
        away = x - whole
        if self.n * (float(np.abs(away).max(initial=0)) + 1) < 2.0**62 / max(1, x.shape[1]) ** 0.5 and (self.n * (float(np.abs(away).max(initial=0)) + 1)) ** 2 * x.shape[1] < 2.0**62:
            v = self.n * away - np.array([s % self.n for s in self.total], np.int64)
            return (v * v).sum(1).tolist()
        rest = [s % self.n for s in self.total]
        sums = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in away.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def fixed(rows: DataFrame) -> DataFrame:
    """(vec_id, x, dim) of the rows that take part, in fixed point."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    rows = rows.where(finite(F.col("c")) & (F.size("c") > 0))
    inside = F.forall("c", lambda v: F.abs(v) <= LARGEST)
    checked = F.when(inside, F.col("c")).otherwise(F.raise_error(F.lit(f"an entry is beyond {LARGEST:.0f}")).cast("array<double>"))
    return rows.select("vec_id", F.transform(checked, lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x")).withColumn("dim", F.size("x"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at : at + ROWS]


def _gram(rows: DataFrame, project, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of ``size`` values per vector that ``project`` makes; each task adds
    up its own, so size * (size + 1) sums leave it at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(size), np.zeros((size, size))
        for part in _blocks(batches):
            y = project(_stack(part["x"]))
            once += y.sum(0)
            twice += y.T @ y
        yield pd.DataFrame({"i": np.arange(size * (size + 1)), "v": np.concatenate([once, twice.ravel()])})

    made = rows.select("x").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    sums = np.zeros(size * (size + 1))
    for r in made.collect():  # size * (size + 1) rows
        sums[r["i"]] = r["v"]
    return sums[:size], sums[size:].reshape(size, size)


def fit(listed: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """The fit of distinct vectors x of one length."""
    sums = listed.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    total = [0] * dim
    for r in sums:
        total[r["i"]] = int(r["s"])
    model = Fit(int(sums[0]["n"]), total, 0.0, np.empty(0), np.empty((dim, 0)))
    scatter = _gram(listed, model.centred, dim)[1] / model.n
    model.trace = float(scatter.trace())
    model.value, model.vector = jacobi(pivoted_cholesky(scatter))
    k = min(components, len(model.value))
    if k:
        once, twice = _gram(listed, lambda x: model.whiten(x, k), k)
        mean = once / model.n
        model.error = float(np.abs(twice / model.n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema["vec_id"].dataType
    usable = fixed(rows)
    listed = cut(usable.select("x", "dim").dropDuplicates(["x"]), "fit-list")
    models = {r["dim"]: fit(listed.where(F.col("dim") == r["dim"]), r["dim"], components) for r in listed.select("dim").distinct().collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(batches):
            for dim, same in part.groupby("dim"):
                model = models[dim]
                k = min(components, len(model.value))
                if not k:
                    continue
                x = _stack(same["x"])
                yield pd.DataFrame({
                    "vec_id": np.repeat(same["vec_id"].to_numpy(), k),
                    "component": np.tile(np.arange(1, k + 1), len(x)),
                    "n": model.n,
                    "deviation": pd.array(np.repeat(np.array(model.deviation(x), object), k), "Int64"),
                    "whitened": model.whiten(x, k).ravel(),
                    "explained": np.tile(model.value[:k] / model.trace, len(x)),
                    "identity_error": model.error,
                })

    source = usable.withColumn("vec_id", F.col("vec_id").cast("string"))  # a batch with nulls would make ids floats
    made = source.mapInPandas(run, _SCHEMA.format(kind="string"))
    return made.withColumn("vec_id", F.col("vec_id").cast(kind))
