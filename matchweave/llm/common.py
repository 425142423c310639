"""What the training-data operators share: table reads, tables that cut lineage, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can see: spark.checkpoint.dir, else (tests) a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and losing an
    executor costs nothing that was written."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows, chosen by the hash of a column, and never more than twice as many.
    Nothing is sorted, and nothing but those rows leaves the tasks."""
    every = max(1, -(-df.count() // size))
    return df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).limit(2 * size)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Keeps the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word, taken eight bytes at a time where the words lie; none becomes a
    Python object. Words end where ``bytes.split()`` ends them: at 0x20 and 0x09 to 0x0D."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = (data != 0x20) & (data - np.uint8(9) > 4)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))
    h = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    longer, at = slice(None), 0
    while len(start):
        part = eight[start + at] & _FIRST[np.minimum(length - at, 8)]
        h[longer] = mix((h[longer] ^ part) * np.uint64(0x9E3779B97F4A7C15))
        at += 8
        keep = np.flatnonzero(length > at)
        start, length = start[keep], length[keep]
        longer = keep if isinstance(longer, slice) else longer[keep]
    return h


def rolling(hashes: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Hash of each run of ``width`` words (polynomial over the 64-bit word hashes, mixed)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m = np.uint64(multiplier)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= m
        out += hashes[j : j + n]
    return mix(out)


def repeated_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key, those whose key occurs more than once."""
    last: pd.DataFrame | None = None
    kept = False
    for batch in batches:
        if last is not None:
            batch = pd.concat([last, batch], ignore_index=True)
        key = batch["key"].to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(False, same) | np.append(same, False)
        if last is not None:
            keep[0] |= kept
        # the last row waits for its successor
        kept = bool(keep[-1])
        yield batch.iloc[:-1][keep[:-1]]
        last = batch.iloc[-1:]
    if last is not None and kept:
        yield last
