"""Applications as a stream with state: the last event of each user about each job.

The state of a user and job is the time, number and status of the last event seen. A later event
replaces it; a late one, older than the state, changes nothing, nor does one that is delivered
again: what goes on downstream is the state. Of events of one time the larger number is the later.
An application stands until another event replaces it, so state has no timeout: it grows with
pairs, not events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import Store

_ROW = "user_id long, job_id long, applied_us long, event_id long, status string"
KEYS, ORDER = ["user_id", "job_id"], ["applied_us", "event_id"]


def changes(events: DataFrame) -> DataFrame:
    """(user_id, job_id, applied_us, event_id, status): of a stream of (user_id, job_id, applied_at,
    event_id, status), the last event known of each user and job that a batch names, one per batch. Events
    without a user, job, time or number are no applications.

    A task folds its own events of a pair before they meet its state, and no pair is a call of its own."""
    rows = events.select("user_id", "job_id", F.unix_micros(F.col("applied_at").cast("timestamp")).alias("applied_us"), "event_id", "status").dropna(subset=["user_id", "job_id", "applied_us", "event_id"])
    last = rows.groupBy(*KEYS).agg(F.max(F.struct("applied_us", "event_id", "status")).alias("last"))
    return last.select(*KEYS, "last.*")


def store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, KEYS, ORDER)


def drain(events: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over what has arrived and keeps each batch's changes in a store."""
    kept = store(events.sparkSession, path)
    changes(events).writeStream.outputMode("update").foreachBatch(kept.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str) -> DataFrame:
    return store(spark, path).current(_ROW)


def listed(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Applications with the title and company of their job (job_id, title, company), where it is known."""
    return applications.join(jobs.select("job_id", "title", "company"), "job_id", "left")
