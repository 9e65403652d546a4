"""The folder that driver and executors share, and results written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Only a local master, as in tests, gets one of its own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it again: later jobs restart from those files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that are broadcast at most; beyond, both sides of a join are shuffled.
BROADCAST_ROWS = 1_000_000


def bounded(small: DataFrame) -> DataFrame:
    """Written, and broadcast where it has at most BROADCAST_ROWS rows of a few numbers; beyond, joins shuffle it."""
    small = cut(small)
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
