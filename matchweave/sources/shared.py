"""The folder that all executors see, and tables in it that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new path below spark.checkpoint.dir; only a local session without one gets a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written and read back: its lineage ends there, and executors may be lost."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table is broadcast.
FEW = 250_000


def bounded(df: DataFrame) -> DataFrame:
    """A written table for a join: broadcast if it has few rows, else dealt and sorted. Its files are packed,
    so their size, which Spark goes by, may be a hundredth of what the driver would hold."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")
