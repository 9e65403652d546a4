"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.shipping import ship
from tesserae.storage import cut, shared_dir, shuffle_parts  # noqa: F401

#: Words are maximal runs of anything but these ASCII white-space characters (as a Java class).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
_TO_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str | None) -> list[str]:
    """The words of a text, by the ASCII white space named above only."""
    return [] if not text else [w for w in text.translate(_TO_SPACE).split(" ") if w]


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches, one at a time, so that only one batch is held."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def batched(found: Iterator[tuple], schema: pa.Schema, size: int = 2000, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows or about `max_bytes` of text and binary values."""
    held: list[tuple] = []
    n = 0
    for row in found:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= size or n >= max_bytes:
            yield _batch(held, schema)
            held, n = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def with_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns an operator works on, under names that clash with no other column."""
    ship(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text"))


#: Rows that are broadcast at most; beyond, both sides of a join are shuffled.
BROADCAST_KEYS = 1_000_000


def bounded(small: DataFrame) -> DataFrame:
    """Written, and broadcast where it has at most BROADCAST_KEYS rows of a few numbers; beyond, joins shuffle it."""
    small = cut(small)
    return F.broadcast(small) if small.count() <= BROADCAST_KEYS else small


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
