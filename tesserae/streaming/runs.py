"""Streams that run until their source ends, restart where they stopped, and write each batch once."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tesserae.storage import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """State on the executors' disks, which stateful processors need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def finish(writer: DataStreamWriter, state: str) -> StreamingQuery:
    """Runs all batches that are there now; a run with the same `state` folder goes on behind the last batch that was finished."""
    query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_files(stream: DataFrame, base: str) -> StreamingQuery:
    """All rows of an append stream under base/out; the sink's log names each batch's files, so a batch that runs twice counts once."""
    return finish(stream.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/state")


def to_batches(path: str, only_new: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch replaces its own folder path/batch=<number>, so a batch that comes again changes nothing.

    With `only_new`, rows whose value there an earlier batch has are left out, and a batch holds each value once.
    """

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if only_new is not None:
            rows = rows.dropDuplicates([only_new])
            earlier = [f"{path}/batch={n}" for n in written(spark, path) if n < number]
            if earlier:
                rows = rows.join(spark.read.parquet(*earlier).select(only_new).distinct(), only_new, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def written(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that a table holds whole."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(top):
        return []
    found = [s.getPath() for s in store.listStatus(top) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The table that updates make: of each key the row of the last batch that wrote it."""
    numbers = written(spark, path)
    if not numbers:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", path).schema(f"{schema}, batch long").parquet(*[f"{path}/batch={n}" for n in numbers])
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a table of batches."""
    numbers = written(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/batch={n}" for n in numbers]) if numbers else spark.createDataFrame([], schema)


def in_steps(rows: DataFrame, time: str, steps: int, path: str) -> Iterator[int]:
    """Writes rows in `steps` parts of rising time, and stops after each: one part of the time between the first and the last row each.

    Rows without a time come first.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = ((high - low) // steps + 1) if low is not None else 1
    step = F.coalesce(F.floor((at - F.lit(low)) / F.lit(width)), F.lit(0)) if low is not None else F.lit(0)
    for i in range(steps):
        rows.where(step == i).write.mode("append").parquet(path)
        yield i
