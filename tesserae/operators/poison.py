"""Maps that rows can't break: a row that raises becomes an error, and a batch that dies is tried again in smaller ones.

`function` works on a list of rows at a time, as measuring or parsing in batches does.  If it raises, the batch is halved
until the failing row is alone; the others are done all the same.  Results and errors are one table, written once, of
which good and bad rows are two views; nothing runs twice to tell them apart.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

from tesserae.shipping import ship
from tesserae.storage import cut

BATCH_ROWS = 256
#: Characters of an error's text that are kept.
ERROR_CHARS = 300


def tried(batch: list[dict], function: Callable[[list[dict]], list[dict]]) -> Iterator[tuple[dict, dict | None, str | None, int]]:
    """(row, result, error, tries) in the order of the rows: a result each, or the error of the row alone and how many calls it was part of."""
    waiting = deque([(batch, 1)])
    while waiting:
        rows, tries = waiting.popleft()
        try:
            found = function(rows)
            if len(found) != len(rows):
                raise ValueError(f"{len(found)} results of {len(rows)} rows")
        except Exception as error:
            if len(rows) == 1:
                yield rows[0], None, f"{type(error).__name__}: {error}"[:ERROR_CHARS], tries
            else:
                half = len(rows) // 2
                waiting.extendleft([(rows[half:], tries + 1), (rows[:half], tries + 1)])
            continue
        yield from ((row, result, None, tries) for row, result in zip(rows, found, strict=True))


def guarded(rows: DataFrame, keep: list[str], function: Callable[[list[dict]], list[dict]], result: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """`keep`, the fields of `result` (a DDL string; null for a failed row), error (null for a good row) and tries; each row once, written."""
    ship(rows.sparkSession)
    fields = _parse_datatype_string(result).fields
    schema = StructType([*[rows.schema[k] for k in keep], *fields, StructField("error", StringType()), StructField("tries", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, batch_rows):
                out = []
                for row, found, error, tries in tried(batch.slice(first, batch_rows).to_pylist(), function):
                    out.append({**{k: row[k] for k in keep}, **({f.name: None for f in fields} if found is None else found), "error": error, "tries": tries})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return cut(rows.mapInArrow(run, schema))


def good(found: DataFrame) -> DataFrame:
    return found.where("error IS NULL").drop("error", "tries")


def errors_by_kind(found: DataFrame) -> DataFrame:
    """(kind, n): failed rows by the error's type."""
    return found.where("error IS NOT NULL").groupBy(F.substring_index("error", ":", 1).alias("kind")).agg(F.count("*").alias("n"))
