"""JSON lines with an explicit schema: tolerant reads, resumable appends, last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.window import Window

BAD = "_corrupt_record"


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows, and in `_corrupt_record` the text of those that don't parse; blank lines are skipped."""
    wider = StructType([*schema.fields]).add(BAD, StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", wider, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.select(parsed.alias("r")).select("r.*")


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def read_if_there(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As `read`; no rows where the path leads nowhere."""
    from pyspark.errors import AnalysisException

    try:
        return read(spark, path, schema)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], StructType([*schema.fields]).add(BAD, StringType()))


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def bad_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col(BAD).isNotNull()).alias("n_bad"))


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key, the one written last; by an aggregate, so that a key written very often is no window."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__last"), F.max(order).alias(order))
    return best.select(key, order, *[F.col("__last")[c].alias(c) for c in others]).select(rows.columns)


def append_new(rows: DataFrame, path: str, key: str, existing: DataFrame | None) -> None:
    """Append the rows whose key isn't there yet."""
    pending = rows if existing is None else rows.join(existing.select(key).distinct(), key, "left_anti")
    pending.write.mode("append").json(path)
