"""Ranking metrics against graded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ordered(ranking: DataFrame) -> DataFrame:
    """Adds each item's position in its query: by rank (none goes last), then score, then id."""
    w = W.partitionBy("query_id").orderBy(F.coalesce("rank", F.lit(10**9)), F.desc("score"), "doc_id")
    return ranking.withColumn("position", F.row_number().over(w))


def metrics(ranking: DataFrame, labels: DataFrame, cuts: tuple[int, ...] = (5, 10), positive: int = 2) -> DataFrame:
    """Per query: reciprocal rank, NDCG and recall at each cut.

    ``ranking``: query_id, doc_id, rank, score; ``labels``: query_id, doc_id, grade, and ``seq`` where
    a pair may have several labels: the one with the highest counts. Items without a label keep their position with grade 0; the ideal order and the number of positives come
    from all labels of the query; queries without labels drop out."""
    last = F.max_by("grade", "seq") if "seq" in labels.columns else F.max("grade")
    labels = labels.groupBy("query_id", "doc_id").agg(last.alias("grade"))
    gain = lambda grade, at: (F.pow(F.lit(2.0), grade) - 1) / F.log2(at + 1.0)
    ideal = labels.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    best = ideal.groupBy("query_id").agg(F.count_if(F.col("grade") >= positive).alias("positives"), *[F.sum(F.when(F.col("at") <= k, gain(F.col("grade"), F.col("at"))).otherwise(0.0)).alias(f"ideal_{k}") for k in cuts])
    graded = ordered(ranking).join(labels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit = F.col("grade") >= positive
    got = graded.groupBy("query_id").agg(
        F.min(F.when(hit, F.col("position"))).alias("first"),
        *[F.sum(F.when(F.col("position") <= k, gain(F.col("grade"), F.col("position"))).otherwise(0.0)).alias(f"dcg_{k}") for k in cuts],
        *[F.count_if(hit & (F.col("position") <= k)).alias(f"hits_{k}") for k in cuts],
    )
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    out = got.join(best, "query_id")
    return out.select("query_id", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), *[share(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_{k}") for k in cuts], *[share(f"hits_{k}", "positives").alias(f"recall_{k}") for k in cuts])


def averages(per_query: DataFrame) -> DataFrame:
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])
