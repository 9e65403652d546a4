"""Bootstrap intervals of medians, without repeating rows.

A row's weight in a replicate is a Poisson(1) number that a fixed function gives of the row's key and the replicate, so a
replicate is the group with each row as often as its weight says, and any engine can repeat it.  A replicate's median
lies near the group's: of a large group only the values around its median, some square roots of its size to each side,
meet in order, and a value that many rows share as the sums of their weights; of the others it is enough how much weight
lies below and above.  Replicates whose median
lies outside these values are found by that, and their group is done again with more of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.selection import at_places, percentiles
from tesserae.storage import bounded, cut, shuffle_parts

RESAMPLES = 2000
#: Groups up to this size are taken whole.
LARGE = 100_000
#: Groups up to this size pass one by one through tasks that have many.
SMALL = 4_096
#: Square roots of a group's size that are taken on each side of its median.
SPREAD = 8
#: Rows of a group with one value beyond which only their weights' sums go on.
HOT = 5_000
#: Replicates that one task makes of a group, and weights that it holds at a time.
BLOCK = 200
CELLS = 1 << 22

#: A prime, and the factors of the function of key and replicate.
PRIME = 2147483647
FACTOR, ADDED, STEP, LEFT, RIGHT = 1103515245, 12345, 69069, 31, 17
#: Where the function's values begin to mean a weight of 1, 2, and so on: the distribution of a Poisson(1) number.
BOUNDS = [math.floor(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(9)]


def weights(keys: np.ndarray, first: int, last: int) -> np.ndarray:
    """A row for each key, a column for each replicate from `first` up to before `last`."""
    a = ((keys.astype(np.int64) % PRIME) * FACTOR + ADDED) % PRIME
    c = (np.arange(first, last, dtype=np.int64) * STEP + 7) % PRIME
    u = (a[:, None] + c) % PRIME * ((a[:, None] * LEFT + c * RIGHT + 1) % PRIME) % PRIME
    return np.searchsorted(BOUNDS, u, "right").astype(np.int32)


def weight_sql(key: str, replicate: str) -> str:
    """The same as an expression of SQL."""
    a = f"((({key}) % {PRIME} * {FACTOR} + {ADDED}) % {PRIME})"
    c = f"(({replicate} * {STEP} + 7) % {PRIME})"
    u = f"((({a} + {c}) % {PRIME}) * (({a} * {LEFT} + {c} * {RIGHT} + 1) % {PRIME}) % {PRIME})"
    return f"len(list_filter([{', '.join(map(str, BOUNDS))}], lambda t: t <= {u}))"


def _sums(rows: DataFrame, resamples: int) -> DataFrame:
    """(g, side, v, b, w): the weight of all rows that share g, side and v (g, key, side, v), in each replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (g, side, v), own in batch.groupby(["g", "side", "v"], sort=False, dropna=False):
                keys, total, step = own["key"].to_numpy(), np.zeros(resamples, np.int64), max(1, CELLS // resamples)
                for at in range(0, len(keys), step):
                    total += weights(keys[at : at + step], 0, resamples).sum(axis=0)
                yield pd.DataFrame({"g": g, "side": side, "v": v, "b": np.arange(resamples), "w": total})

    found = rows.select("g", "key", "side", "v").mapInPandas(run, "g long, side int, v double, b int, w long")
    return found.groupBy("g", "side", "v", "b").agg(F.sum("w").alias("w"))


def _inside(rows: DataFrame, sums: DataFrame, resamples: int) -> DataFrame:
    """(g, b, total, median): null without weight, and where the middle isn't among the rows (g, key, v) and the sums of side 0."""

    def medians(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * BLOCK
        last = min(resamples, first + BLOCK)
        beyond = np.zeros((2, last - first), np.int64)
        for i, side in enumerate((-1, 1)):
            some = told[told["side"] == side]
            beyond[i, some["b"].to_numpy().astype(np.int64) - first] = some["w"].to_numpy()
        hot = told[told["side"] == 0]
        repeated, at = np.unique(hot["v"].to_numpy().astype(float), return_inverse=True)
        heavy = np.zeros((len(repeated), last - first), np.int64)
        heavy[at, hot["b"].to_numpy().astype(np.int64) - first] = hot["w"].to_numpy()
        keys, v = own["key"].to_numpy().astype(np.int64), np.concatenate([own["v"].to_numpy().astype(float), repeated])
        order = np.argsort(v, kind="stable")
        v = v[order]
        out, total = np.full(last - first, np.nan), np.zeros(last - first, np.int64)
        step = max(1, CELLS // max(1, len(v)))
        for a in range(0, last - first, step):
            b = min(last - first, a + step)
            upto = np.cumsum(np.concatenate([weights(keys, first + a, first + b), heavy[:, a:b]])[order], axis=0, dtype=np.int64)
            for i in range(a, b):
                here = upto[:, i - a]
                total[i] = beyond[0, i] + beyond[1, i] + here[-1]
                places = np.array([(total[i] - 1) // 2, total[i] // 2]) - beyond[0, i]
                if total[i] and places[0] >= 0 and places[1] < here[-1]:
                    low, high = v[np.searchsorted(here, places, "right")]
                    out[i] = low if low == high else low + 0.5 * (high - low)
        return pd.DataFrame({"g": int(key[0]), "b": np.arange(first, last), "total": total, "median": out})

    blocks = -(-resamples // BLOCK)
    kept = rows.select("g", "key", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    blocked = sums.withColumn("block", F.floor(F.col("b") / BLOCK).cast("int"))
    return kept.groupBy("g", "block").cogroup(blocked.groupBy("g", "block")).applyInPandas(medians, "g long, b int, total long, median double")


def _own(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(g, key, v) of the rows that have all three."""
    whole = F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(value).isNotNull()
    return rows.where(whole).select(F.col(group).cast("long").alias("g"), F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("v"))


def medians(rows: DataFrame, group: str, key: str, value: str, resamples: int = RESAMPLES, large: int = LARGE, spread: float = SPREAD) -> DataFrame:
    """(group, b, median): of each group and replicate with any weight.  Rows without a group, key or value are left out; written."""
    own = cut(_own(rows, group, key, value))
    sizes = cut(own.groupBy("g").agg(F.count("*").alias("n")))
    out = None
    while True:
        reach = F.when(F.col("n") <= large, F.col("n")).otherwise(F.ceil(F.sqrt(F.col("n").cast("double")) * spread))
        middle = F.floor((F.col("n") - 1) / 2)
        places = sizes.select("g", F.greatest(F.lit(0), middle - reach).cast("long").alias("low"), F.least(F.col("n") - 1, middle + 1 + reach).cast("long").alias("high"))
        wanted = places.select("g", F.explode(F.array_distinct(F.array("low", "high"))).alias("place"))
        at = at_places(own, ["g"], "v", wanted, sizes)
        around = bounded(at.groupBy("g").agg(F.min("value").alias("low"), F.max("value").alias("high")))
        side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
        marked = cut(own.join(around, "g").select("g", "key", "v", side.alias("side")))
        hot = bounded(marked.where("side = 0").groupBy("g", "v").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("g", "v", F.lit(True).alias("hot")))
        marked = marked.join(hot, ["g", "v"], "left")
        sums = _sums(marked.where("side <> 0 OR hot").withColumn("v", F.when(F.col("side") == 0, F.col("v"))), resamples)
        found = cut(_inside(marked.where("side = 0 AND hot IS NULL"), sums, resamples))
        again = cut(found.where("total > 0 AND median IS NULL").select("g").distinct())
        done = found.where("total > 0").join(bounded(again), "g", "left_anti").select(F.col("g").alias(group), "b", "median")
        out = done if out is None else out.unionByName(done)
        if again.isEmpty():
            return out
        sizes, spread = cut(sizes.join(bounded(again), "g", "left_semi")), 4 * spread


def _whole(keys: np.ndarray, v: np.ndarray, resamples: int) -> np.ndarray:
    """The medians of the replicates that have any weight, of a group that is held whole."""
    order = np.argsort(v, kind="stable")
    v, out, step = v[order], [], max(1, CELLS // len(v))
    for first in range(0, resamples, step):
        upto = np.cumsum(weights(keys[order], first, min(resamples, first + step)), axis=0, dtype=np.int64)
        total = upto[-1]
        upto, total = upto[:, total > 0], total[total > 0]
        low, high = (v[(upto <= place).sum(axis=0)] for place in ((total - 1) // 2, total // 2))
        with np.errstate(invalid="ignore"):
            out.append(np.where(low == high, low, low + 0.5 * (high - low)))
    return np.concatenate(out)


def _small_intervals(own: DataFrame, resamples: int, wanted: list[float]) -> DataFrame:
    """(g, low, high) of groups of at most SMALL rows (g, key, v), which lie together in a task and pass through it one by one."""

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        g, keys, v = rows["g"].to_numpy().astype(np.int64), rows["key"].to_numpy().astype(np.int64), rows["v"].to_numpy().astype(float)
        found, starts = [], [0, *(np.flatnonzero(np.diff(g)) + 1)]
        for a, b in zip(starts, [*starts[1:], len(g)], strict=True):
            m = np.sort(_whole(keys[a:b], v[a:b], resamples))
            if len(m):
                places = [(len(m) - 1) * q for q in wanted]
                lows, highs = [m[int(np.floor(x))] for x in places], [m[int(np.ceil(x))] for x in places]
                found.append((g[a], *[lo + (x - np.floor(x)) * (hi - lo) for x, lo, hi in zip(places, lows, highs, strict=True)]))
        return pd.DataFrame(found, columns=["g", "low", "high"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            # the last group may go on in the next batch
            last = int(np.searchsorted(rows["g"].to_numpy(), rows["g"].iloc[-1], "left"))
            rest = rows.iloc[last:]
            if last:
                yield told(rows.iloc[:last])
        if rest is not None:
            yield told(rest)

    dealt = own.repartition(shuffle_parts(own.sparkSession), "g").sortWithinPartitions("g")
    return dealt.mapInPandas(run, "g long, low double, high double")


def intervals(rows: DataFrame, group: str, key: str, value: str, resamples: int = RESAMPLES, level: float = 0.95, small: int = SMALL) -> DataFrame:
    """(group, low, high): the bootstrap interval of each group's median; written.  Groups of at most `small` rows are taken whole, many by a task."""
    tail = (1 - level) / 2
    own = cut(_own(rows, group, key, value))
    larger = bounded(own.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > small).select("g"))
    found = cut(_small_intervals(own.join(larger, "g", "left_anti"), resamples, [tail, 1 - tail]))
    if not larger.isEmpty():
        middle = medians(own.join(larger, "g", "left_semi"), "g", "key", "v", resamples)
        found = found.unionByName(percentiles(middle, ["g"], "median", {"low": tail, "high": 1 - tail}).drop("n"))
    return found.withColumnRenamed("g", group)
