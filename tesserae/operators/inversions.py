"""Pairs whose order changes between two measures, counted without forming them.

Rows of equal group and measures are counted first.  The different ones are dealt by ranges of the first measure, and
once more by ranges of the second.  A pair in opposite orders then lies in one range of the first measure, or in
different ranges of the first and one of the second, or in different ranges of both.  The first two kinds are counted
inside a range each, the third over the table of how many rows each pair of ranges holds.  Inside a range the count goes
bit by bit of the second measure's rank, so that n rows take n log n steps; no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ranks import ranged, same
from tesserae.storage import cut, shuffle_parts


def opposite(group: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """How many pairs within a group have x rising and y falling; row i stands for n[i] equal rows."""
    if len(group) < 2:
        return 0
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    if int(n.sum()) >= 1 << 31:
        n = n.astype(object)  # exact beyond 64 bits
    order = np.lexsort((x, group))
    group, x, rank, n = group[order], x[order], rank[order], n[order]
    start = np.ones(len(group), bool)
    start[1:] = group[1:] != group[:-1]
    prefix = np.cumsum(start)  # the group, then with the leading bits of the rank
    total = 0
    for bit in reversed(range(int(rank.max()).bit_length())):
        one = (rank >> bit & 1).astype(bool)
        # rows of one prefix together, still in the order of x; those with the bit set that have a smaller x are above those without
        order = np.argsort(prefix, kind="stable")
        p, ones, own = prefix[order], one[order], n[order]
        xs = x[order]
        before = np.cumsum(np.where(ones, own, 0)) - np.where(ones, own, 0)
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (xs[1:] != xs[:-1])
        head = np.ones(len(p), bool)
        head[1:] = p[1:] != p[:-1]
        at = np.arange(len(p))
        smaller = before[np.maximum.accumulate(np.where(first, at, 0))] - before[np.maximum.accumulate(np.where(head, at, 0))]
        total += int((smaller[~ones] * own[~ones]).sum())
        prefix = np.unique(2 * prefix + one, return_inverse=True)[1]
    return total


def _counted(rows: DataFrame, by: str, group: list[str], x: str, y: str) -> DataFrame:
    """One row a task: opposite pairs of rows that share `by` and group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            every = pd.concat(held)
            found = opposite(every["__g"].to_numpy(), every["x"].to_numpy(), every["y"].to_numpy(), every["n"].to_numpy())
            yield pd.DataFrame({"pairs": [str(found)]})

    # a hash of group and range tells those of one task apart
    keyed = rows.select(F.xxhash64(by, *group).alias("__g"), F.col(x).alias("x"), F.col(y).alias("y"), "n")
    return keyed.repartition(shuffle_parts(rows.sparkSession), "__g").mapInPandas(run, "pairs string").select(F.col("pairs").cast("decimal(38,0)").alias("pairs"))


def opposite_pairs(counts: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """One row (pairs): over groups, the pairs with x rising and y falling.  counts: group, x, y, n, each (group, x, y) once."""
    parts = shuffle_parts(counts.sparkSession)
    by_x = ranged(counts, [F.col(group), F.col(x), F.col(y)], parts).withColumnRenamed("__range", "__p").drop("__at")
    inside = _counted(by_x, "__p", [group], x, y)
    # equal second measures are no pairs, so rows of a range that share one are one row
    less = by_x.groupBy(group, "__p", y).agg(F.sum("n").alias("n"))
    by_y = ranged(less, [F.col(group), F.col(y), F.col("__p")], parts).drop("__at")
    # a second measure may be cut by ranges; its rows go to the range of its first ones
    own = by_y.groupBy(group, y).agg(F.min("__range").alias("__q")).select(F.col(group).alias("__group"), F.col(y).alias("__y"), "__q")
    by_y = cut(by_y.join(own, same([F.col(group), F.col(y)], [F.col("__group"), F.col("__y")])).select(group, y, "n", "__p", "__q"))
    across = _counted(by_y, "__q", [group], "__p", y)
    cells = by_y.groupBy(group, "__p", "__q").agg(F.sum("n").alias("n"))
    apart = _counted(cells.withColumn("__all", F.lit(0)), "__all", [group], "__p", "__q")
    return inside.unionByName(across).unionByName(apart).agg(F.coalesce(F.sum("pairs"), F.lit(0).cast("decimal(38,0)")).alias("pairs"))


def reordered_pairs(rows: DataFrame, group: str, before: str, after: str) -> DataFrame:
    """One row: n_pairs of a group that differ in a measure, n_changed of them whose order changes, or that only the second tells apart."""
    rows = rows.where(F.col(group).isNotNull() & F.col(before).isNotNull() & F.col(after).isNotNull())
    counts = cut(rows.groupBy(group, before, after).agg(F.count("*").alias("n")))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    pairs = lambda c: F.coalesce(F.sum((wide(c) * wide(c) - wide(c)) / 2), F.lit(0)).cast("decimal(38,0)")
    equal = counts.agg(pairs("n").alias("equal"))
    tied = counts.groupBy(group, before).agg(F.sum("n").alias("n")).agg(pairs("n").alias("tied"))
    every = counts.groupBy(group).agg(F.sum("n").alias("n")).agg(pairs("n").alias("every"))
    found = every.crossJoin(tied).crossJoin(equal).crossJoin(opposite_pairs(counts, group, before, after))  # one row each
    long = lambda c: c.cast("decimal(38,0)")
    return found.select(long(F.col("every") - F.col("equal")).alias("n_pairs"), long(F.col("pairs") + F.col("tied") - F.col("equal")).alias("n_changed"))
