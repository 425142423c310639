"""What the two vector searches share: which rows take part, and the blocks they meet in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components (false for a null vector)."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).withColumn("dim", F.size("embedding"))


def best(scored: DataFrame, k: int, nearest: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller vec_id."""
    from pyspark.sql.window import Window as W

    order = F.col("score") if nearest else F.col("score").desc()
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
