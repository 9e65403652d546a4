"""Values at given places of groups in order, and exact percentiles from them, for groups of any size.

A double has 64 bits that sort as it does.  Of groups with more than `large` values, these are counted by their leading
DIGIT_BITS bits; only the bin that holds a wanted place goes on, and is counted by its next bits, until it has at most
`large` values or one value only, which takes four rounds at most.  Bins and smaller groups are finished by counts of
their distinct values.  What passes between rounds is one row for each large group and wanted place.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.ranks import same
from tesserae.storage import bounded, cut

DIGIT_BITS = 16
#: Values that one task sorts.
LARGE = 1 << 20


def order_bits(value: Column) -> Column:
    """64 bits, as a long read without sign, that sort as doubles do: both zeros alike, NaN last.

    The exponent is floor(log2), put right by one where the logarithm was rounded over a power of two; dividing by
    that power leaves the mantissa exactly.
    """
    v = value.cast("double")
    size = F.least(F.abs(v), F.lit(sys.float_info.max))
    near = F.floor(F.log2(F.greatest(size, F.lit(2.0**-1022)))).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(power(near) > size, near - 1).when((near < 1023) & (power(near + 1) <= size), near + 1).otherwise(near)
    # values below 2**-1022 have no leading one; they count steps of 2**-1074
    small = size < 2.0**-1022
    mantissa = F.when(small, size * 2.0**537 * 2.0**537).otherwise((size / power(exponent) - 1) * 2.0**52).cast("long")
    bits = F.when(small, mantissa).otherwise(F.shiftleft((exponent + 1023).cast("long"), 52) + mantissa)
    bits = F.when(F.abs(v) == float("inf"), F.lit(0x7FF0000000000000)).otherwise(bits)
    top = F.lit(-(1 << 63)).cast("long")
    signed = F.when(v < 0, F.bitwise_not(bits.bitwiseOR(top))).otherwise(bits.bitwiseOR(top))
    return F.when(F.isnan(v), F.lit(-1).cast("long")).when(v == 0, top).otherwise(signed)


def _finish(values: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, place, value).  values: keys, __prefix, __value; wanted: keys, __prefix, __before, place."""
    by = [*keys, "__prefix"]
    counts = values.groupBy(*by, "__value").agg(F.count("*").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("__value")))
    own = wanted.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], "__before", "place")
    inside = F.col("place") - F.col("__before")
    met = counts.join(bounded(own), same([F.col(k) for k in by], [F.col(f"__k{i}") for i in range(len(by))]) & (F.col("upto") > inside) & (F.col("upto") - F.col("c") <= inside))
    return met.select(*keys, "place", F.col("__value").alias("value"))


def _narrowed(values: DataFrame, keys: list[str], wanted: DataFrame, depth: int) -> DataFrame:
    """One round: `wanted` with the next digits of the bin that holds each place, the rows before that bin, and its size."""
    by = [*keys, "__prefix"]
    active = wanted.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)])
    own = values.withColumn("__prefix", _prefix(depth))
    met = own.join(bounded(active.distinct()), same([F.col(k) for k in by], [F.col(f"__k{i}") for i in range(len(by))]), "left_semi")
    counts = met.groupBy(*by, _prefix(depth + DIGIT_BITS).alias("__next")).agg(F.count("*").alias("c"))
    # the last digits in rising order; a prefix has at most 2**DIGIT_BITS of them
    digit = F.col("__next").bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(digit)))
    targets = wanted.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], "__before", "place")
    inside = F.col("place") - F.col("__before")
    hit = counts.join(bounded(targets), same([F.col(k) for k in by], [F.col(f"__k{i}") for i in range(len(by))]) & (F.col("upto") > inside) & (F.col("upto") - F.col("c") <= inside))
    return hit.select(*keys, F.col("__next").alias("__prefix"), (F.col("__before") + F.col("upto") - F.col("c")).alias("__before"), "place", F.col("c").alias("__size"))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("__bits", 64 - depth) if depth else F.lit(0).cast("long")


def at_places(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, sizes: DataFrame, large: int = LARGE) -> DataFrame:
    """(keys, place, value) for wanted (keys, place); sizes: keys, n.  Nulls are left out of the order."""
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__value"))
    sized = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("n").alias("__size"))
    both = same([F.col(k) for k in keys], [F.col(f"__k{i}") for i in range(len(keys))])
    wanted = cut(wanted.join(sized, both).select(*keys, F.lit(0).cast("long").alias("__prefix"), F.lit(0).cast("long").alias("__before"), "place", "__size"))
    waiting = wanted.where(F.col("__size") > large)
    if waiting.isEmpty():
        return _finish(values.withColumn("__prefix", F.lit(0).cast("long")), keys, wanted)
    big = bounded(waiting.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct())
    out = _finish(values.join(big, both, "left_anti").withColumn("__prefix", F.lit(0).cast("long")), keys, wanted.where(F.col("__size") <= large))
    values = cut(values.join(big, both, "left_semi").withColumn("__bits", order_bits(F.col("__value"))))
    for depth in range(0, 64, DIGIT_BITS):
        now = cut(_narrowed(values, keys, waiting, depth))
        last = depth + DIGIT_BITS == 64
        done = now if last else now.where(F.col("__size") <= large)
        out = out.unionByName(_taken(values.withColumn("__prefix", _prefix(depth + DIGIT_BITS)), keys, done))
        waiting = now.where(F.col("__size") > large)
        if last or waiting.isEmpty():
            return out
    return out


def _taken(values: DataFrame, keys: list[str], done: DataFrame) -> DataFrame:
    """Finishes bins, from their rows only."""
    by = [*keys, "__prefix"]
    chosen = done.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]).distinct()
    own = values.join(bounded(chosen), same([F.col(k) for k in by], [F.col(f"__k{i}") for i in range(len(by))]), "left_semi")
    return _finish(own.select(*by, "__value"), keys, done)


def values_at(rows: DataFrame, keys: list[str], value: str, index: dict[str, Column], large: int = LARGE) -> DataFrame:
    """Per group: the keys, n, and the values at these places (from 0) in order, each a column of `n`; nulls are left out, groups without a value too."""
    if not keys:
        return values_at(rows.withColumn("__all", F.lit(0)), ["__all"], value, index, large).drop("__all")
    sizes = cut(rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0"))
    places = sizes.select(*keys, "n", *[c.cast("long").alias(f"__at{i}") for i, c in enumerate(index.values())])
    names = [f"__at{i}" for i in range(len(index))]
    wanted = places.select(*keys, F.explode(F.array_distinct(F.array(*names))).alias("place"))
    found = at_places(rows, keys, value, wanted, sizes, large)
    told = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("__values"))  # one entry a place
    told = told.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__values")
    met = places.join(told, same([F.col(k) for k in keys], [F.col(f"__k{i}") for i in range(len(keys))]))
    return met.select(*keys, "n", *[F.col("__values")[F.col(n)].alias(name) for n, name in zip(names, index, strict=True)])


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], large: int = LARGE) -> DataFrame:
    """Per group: the keys, n (values that aren't null), and exact percentiles, linear between the two nearest places."""
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    index = {f"{name}__{side}": how(place(q)) for name, q in wanted.items() for side, how in (("low", F.floor), ("high", F.ceil))}
    found = values_at(rows, keys, value, index, large)
    part = lambda q: place(q) - F.floor(place(q))
    low, high = (lambda name: F.col(f"{name}__low").cast("double")), (lambda name: F.col(f"{name}__high").cast("double"))
    return found.select(*keys, "n", *[(low(name) + part(q) * (high(name) - low(name))).alias(name) for name, q in wanted.items()])
