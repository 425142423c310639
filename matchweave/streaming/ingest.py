"""Incremental ingest as Structured Streaming jobs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import written

#: Buckets of a store's keys, unless the keys' own order gives better ones.
BUCKETS = 64


def read_stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, with the schema that they have; ``files`` of them a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(f"{sf_dir}/{name}.parquet*")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class Store:
    """The last row of each key, in folders that batches replace bucket by bucket.

    A batch reads only the buckets that its keys fall into, merges them with its own rows and writes
    their new versions beside the old ones. Then one small file, put in place by a rename, names the
    version of every bucket: that is the commit. Until then readers see the state before, and a batch
    that runs again overwrites what it had written. Versions that no longer count go at the next
    commit, so that a reader of the last state can finish.

    ``bucket`` tells a row's bucket, an integer: by default a hash of the keys; for keys that arrive in
    order, a range of them (such as ``floor(id / 1000000)``) makes a batch touch few buckets."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], bucket: Column | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order
        self.bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if bucket is None else bucket

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def committed(self) -> tuple[int, dict[int, int]]:
        """(number of the last batch, version of each bucket); (-1, {}) before the first commit."""
        fs, folder = self._file("commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]
        if not done:
            return -1, {}
        line = self.spark.read.text(f"{self.path}/commits/{max(done)}.json").first()[0]
        return max(done), {int(b): v for b, v in json.loads(line).items()}

    def _folder(self, bucket: int, version: int) -> str:
        return f"rows/version={version}/bucket={bucket}"

    def write(self, batch: DataFrame, number: int) -> dict[int, int] | None:
        """Writes the new versions of the buckets that the batch touches; None if it is committed already."""
        last, versions = self.committed()
        if number <= last:
            return None
        rows = latest(batch, self.keys, *self.order).withColumn("bucket", self.bucket.cast("long"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # a number per bucket
        old = [f"{self.path}/{self._folder(b, versions[b])}" for b in touched if b in versions]
        if old:
            known = self.spark.read.schema(batch.schema).parquet(*old)
            rows = latest(rows.drop("bucket").unionByName(known), self.keys, *self.order).withColumn("bucket", self.bucket.cast("long"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={number}")
        return versions | {b: number for b in touched}

    def commit(self, number: int, versions: dict[int, int]) -> None:
        before = self.committed()[1]
        fs, ready = self._file(f"commits/.{number}.json")
        out = fs.create(ready, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        done = self._file(f"commits/{number}.json")[1]
        if not fs.rename(ready, done):
            raise OSError(f"could not commit {done}")
        self._clear(number, before, versions)

    def _clear(self, number: int, *kept: dict[int, int]) -> None:
        """Deletes the folders that neither this state nor the one before names, and old commits."""
        named = {(b, v) for versions in kept for b, v in versions.items()}
        fs, rows = self._file("rows")
        for version in fs.listStatus(rows) if fs.exists(rows) else []:
            v = int(version.getPath().getName().removeprefix("version="))
            if v < number:
                folders = [s.getPath() for s in fs.listStatus(version.getPath()) if s.isDirectory()]
                gone = [p for p in folders if (int(p.getName().removeprefix("bucket=")), v) not in named]
                for p in [version.getPath()] if len(gone) == len(folders) else gone:
                    fs.delete(p, True)
        fs, commits = self._file("commits")
        for s in sorted((s for s in fs.listStatus(commits) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0] != "."), key=lambda s: int(s.getPath().getName().removesuffix(".json")))[:-2]:
            fs.delete(s.getPath(), False)

    def upsert(self, batch: DataFrame, number: int) -> None:
        # read for its buckets and for its rows, and a batch with state must not be worked out twice
        versions = self.write(written(batch, "batch"), number)
        if versions is not None:
            self.commit(number, versions)

    def current(self, schema) -> DataFrame:
        """The last row of each key: the files of one commit."""
        _, versions = self.committed()
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{self._folder(b, v)}" for b, v in sorted(versions.items())])


def upsert(stream: DataFrame, store: Store, checkpoint: str) -> None:
    """Drains the stream into the store, a commit per batch."""
    stream.writeStream.foreachBatch(store.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen(stream: DataFrame, time: str, keys: list[str], lateness: str) -> DataFrame:
    """The stream without repeats of a key within ``lateness``."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def changed(batches: list[DataFrame], keys: list[str], *order: str) -> DataFrame:
    """What a store holds after all the batches, worked out at once."""
    return latest(reduce(DataFrame.unionByName, batches), keys, *order)
