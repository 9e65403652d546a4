"""Rows and the marker that follows them, in the order of their log, without a task that holds a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.ranks import ranged, same
from tesserae.storage import bounded


def next_marker(rows: DataFrame, groups: list[str], order: list[Column], marker: Column, name: str = "marker", parts: int | None = None) -> DataFrame:
    """The rows with `name`, the marker of the first later row of their group that has one; null without.

    Logs are cut by ranges of the order.  Within a range rows look ahead; those that no marker of their range follows
    take the first one of a later range, of which one row for each range and group tells.
    """
    found = ranged(rows.withColumn("__marker", marker), [*[F.col(g).asc_nulls_first() for g in groups], *order], parts)
    has = F.when(F.col("__marker").isNotNull(), F.col("__at"))
    each = found.groupBy("__range", *groups).agg(F.min_by("__marker", has).alias("__first"))
    # read backwards, so that a window grows by one row at a time
    after = Window.partitionBy(*groups).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    later = each.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.last("__first", ignorenulls=True).over(after).alias("__later"))
    back = Window.partitionBy("__range", *groups).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
    seen = found.withColumn("__next", F.last("__marker", ignorenulls=True).over(back))
    keys = same([F.col("__range"), *[F.col(g) for g in groups]], [F.col("__r"), *[F.col(f"__g{i}") for i in range(len(groups))]])
    return seen.join(bounded(later), keys).select(*rows.columns, F.coalesce("__next", "__later").alias(name))
