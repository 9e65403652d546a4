"""Places in an order, and the first of a group, without a task that holds all rows.

An order over all rows is made by ranges: rows are dealt by ranges of the order and sorted within them, ranges are
counted, and the sums over earlier ranges are the offsets.  Groups that are cut by ranges continue in the next one.
The first rows of a group in hash order are found by counting: leading digits of the hash tell which rows lie before
the last one wanted, and only the rows that share its digits are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.storage import bounded, cut, shuffle_parts

#: Bits of monotonically_increasing_id below the partition's number.
_PLACE_BITS = 33
#: Leading hex digits by which a hash is counted.
DIGITS = 4


def same(left: list[Column], right: list[Column]) -> Column:
    """Whether all keys are equal, nulls to nulls; true without keys."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def ranged(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows, dealt by ranges of the order and sorted in them, with __range and __at, the place within it; written.

    `order` should tell rows apart: rows that are equal in it share a range.
    """
    parts = parts or shuffle_parts(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    low = F.lit((1 << _PLACE_BITS) - 1).cast("long")
    return cut(dealt.select(*rows.columns, F.shiftright("__id", _PLACE_BITS).cast("int").alias("__range"), F.col("__id").bitwiseAND(low).alias("__at")))


def numbered(rows: DataFrame, order: list[Column], name: str = "place", groups: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """The rows with `name`, their place (from 0) in the order, over all rows or within each of `groups`.

    What passes between ranges is one row for each range and group in it.
    """
    groups = groups or []
    found = ranged(rows, [*[F.col(g).asc_nulls_first() for g in groups], *order], parts)
    each = found.groupBy("__range", *groups).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = each.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    keys = same([F.col("__range"), *[F.col(g) for g in groups]], [F.col("__r"), *[F.col(f"__g{i}") for i in range(len(groups))]])
    return found.join(bounded(shift), keys).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(name))


def first_by_hash(rows: DataFrame, group: str, digest: Column, quotas: DataFrame) -> DataFrame:
    """Of each group the `quota` rows (from quotas: group, quota) that come first by `digest`, a hash in hex.

    Groups are counted by the hash's leading digits.  Rows below the digits of the last wanted row are taken unsorted;
    those with these digits, one in 16**DIGITS of the group, are sorted.  No window holds a group.
    """
    marked = rows.withColumn("__hash", digest).withColumn("__bin", F.substring("__hash", 1, DIGITS))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy("__bin"))
    counts = marked.groupBy(group, "__bin").agg(F.count("*").alias("c")).withColumn("upto", upto)
    own = quotas.select(F.col(group).alias("__group"), "quota").where("quota > 0")
    counts = counts.join(own, F.col(group).eqNullSafe(F.col("__group")))
    last = counts.groupBy("__group").agg(F.max("quota").alias("quota"), F.min(F.when(F.col("upto") >= F.col("quota"), F.struct("__bin", (F.col("quota") - F.col("upto") + F.col("c")).alias("rest")))).alias("last"))
    # a group with fewer rows than its quota has no last bin: all its rows are taken
    border = bounded(last.select("__group", F.col("last.__bin").alias("__last"), F.col("last.rest").alias("__rest")))
    met = marked.join(border, F.col(group).eqNullSafe(F.col("__group")))
    whole = met.where(F.col("__last").isNull() | (F.col("__bin") < F.col("__last")))
    place = F.row_number().over(Window.partitionBy(group).orderBy("__hash"))
    edge = met.where(F.col("__bin") == F.col("__last")).withColumn("__place", place).where(F.col("__place") <= F.col("__rest"))
    return whole.select(rows.columns).unionByName(edge.select(rows.columns))
