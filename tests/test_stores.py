"""Stores that batches replace bucket by bucket, and applications as a stream with state."""

import pytest
from pyspark.sql import functions as F

from matchweave.streaming import applications, ingest

SCHEMA = "id long, v string, at long"


def rows_of(store):
    return {r.id: (r.v, r.at) for r in store.current(SCHEMA).collect()}


def test_batches_touch_their_buckets_only(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "s"), ["id"], ["at"], bucket=F.floor(F.col("id") / 100))
    assert rows_of(store) == {}
    batches = [
        spark.range(1000).selectExpr("id", "'a' AS v", "1L AS at"),
        spark.createDataFrame([(5, "b", 2), (5, "c", 3), (6, "late", 0), (1234, "new", 1)], SCHEMA),
        spark.createDataFrame([(5, "d", 3), (950, None, 9)], SCHEMA),
    ]
    for k, b in enumerate(batches):
        store.upsert(b, k)
        if k == 0:
            first = set(store.current(SCHEMA).inputFiles())
    want = {r.id: (r.v, r.at) for r in ingest.changed(batches[:2], ["id"], "at").collect()} | {950: (None, 9)}
    got = rows_of(store)
    assert {k: v for k, v in got.items() if k != 5} == {k: v for k, v in want.items() if k != 5} and got[5] in (("c", 3), ("d", 3)) and got[1234] == ("new", 1) and got[6] == ("a", 1)
    # buckets 1 to 8 are still the first batch's files
    same = [f for f in store.current(SCHEMA).inputFiles() if f in first]
    assert {f.split("bucket=")[1].split("/")[0] for f in same} == {str(b) for b in range(1, 9)}
    assert store.committed()[1] == {0: 2, **{b: 0 for b in range(1, 9)}, 9: 2, 12: 1}
    kept = {p.name for p in (tmp_path / "s" / "rows" / "version=0").iterdir() if p.is_dir()}
    assert kept == {f"bucket={b}" for b in range(1, 10)}  # bucket 9 was in the state before


def test_a_batch_that_ends_before_its_commit_counts_for_nothing(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "s"), ["id"], ["at"], buckets=4)
    store.upsert(spark.createDataFrame([(1, "a", 1), (2, "a", 1)], SCHEMA), 0)
    batch = spark.createDataFrame([(1, "b", 2), (3, "b", 2)], SCHEMA)
    store.write(batch, 1)  # and no commit
    assert rows_of(store) == {1: ("a", 1), 2: ("a", 1)}
    store.upsert(batch, 1)
    store.upsert(batch, 1)  # delivered again
    store.upsert(spark.createDataFrame([(1, "old", 9)], SCHEMA), 0)
    assert rows_of(store) == {1: ("b", 2), 2: ("a", 1), 3: ("b", 2)}
    store.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert rows_of(store) == {1: ("b", 2), 2: ("a", 1), 3: ("b", 2)} and store.committed()[0] == 2


EVENTS = "user_id long, job_id long, applied_at timestamp, event_id long, status string"


@pytest.mark.parametrize("restart", [False, True])
def test_applications_with_late_and_repeated_events(spark, tmp_path, restart):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m, 0, m)
    parts = [
        [(1, 10, t(5), 1, "view"), (1, 10, t(7), 2, "click"), (2, 10, t(1), 3, "view"), (None, 10, t(1), 4, "none"), (3, 1, None, 5, "none")],
        [(1, 10, t(6), 6, "late"), (1, 10, t(7), 2, "click"), (2, 10, t(1), 7, "tie"), (2**60 + 1, 11, t(3), 8, "view")],
        [(2, 10, t(1), 6, "smaller"), (2**60 + 1, 11, t(4), 9, None)],
    ]
    source, path, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        if restart:
            applications.drain(spark.readStream.schema(EVENTS).parquet(source), path, state)
    if not restart:
        applications.drain(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source), path, state)
    got = {(r.user_id, r.job_id): (r.event_id, r.status) for r in applications.current(spark, path).collect()}
    assert got == {(1, 10): (2, "click"), (2, 10): (7, "tie"), (2**60 + 1, 11): (9, None)}
    jobs = spark.createDataFrame([(10, "engineer", "acme")], "job_id long, title string, company string")
    listed = {r.job_id: r.title for r in applications.listed(applications.current(spark, path), jobs).collect()}
    assert listed == {10: "engineer", 11: None}


def test_many_applications_keep_state_without_a_call_each(spark, tmp_path):
    source = str(tmp_path / "in")
    e = spark.range(300_000).selectExpr("id % 150000 AS user_id", "id % 7 AS job_id", "timestamp_seconds(id % 1000) AS applied_at", "id AS event_id", "string(id) AS status")
    e.write.parquet(source)
    stream = applications.changes(spark.readStream.schema(e.schema).parquet(source))
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    applications.drain(spark.readStream.schema(e.schema).parquet(source), str(tmp_path / "store"), str(tmp_path / "state"))
    got = applications.current(spark, str(tmp_path / "store"))
    want = e.groupBy("user_id", "job_id").agg(F.max(F.struct(F.unix_micros("applied_at").alias("applied_us"), "event_id", "status")).alias("x")).select("user_id", "job_id", "x.*")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()
