"""Mixing and splitting of training examples: budgets by water-filling, stratified samples, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import hash_order
from tesserae.operators.ranks import first_by_hash, numbered
from tesserae.storage import bounded, cut


def quotas(sizes: DataFrame, group: str, budget: DataFrame) -> DataFrame:
    """(group, quota): the largest common cap whose takes fit the budget; what is left goes to the largest groups, by name.

    sizes: one row per group (`n`); budget: one row (`budget`).  The candidates for the cap are the group sizes: between
    two of them the sum grows by the number of larger groups with each step, so the cap follows by division; every candidate's
    take fits, so the greatest is the cap.
    """
    w = Window.orderBy("n", group)  # over one row per group only
    by = sizes.crossJoin(budget).withColumns({"below": F.sum("n").over(w) - F.col("n"), "above": F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1})
    cap = by.agg(F.max("budget").alias("budget"), F.sum("n").alias("total"), F.max("n").alias("most"), F.max(F.when(F.col("below") < F.col("budget"), F.least("n", F.floor((F.col("budget") - F.col("below")) / F.col("above"))))).alias("c"))
    cap = cap.select("budget", F.when(F.col("total") <= F.col("budget"), F.col("most")).otherwise(F.coalesce("c", F.lit(0))).alias("cap"))
    taken = sizes.crossJoin(cap).withColumn("take", F.least("n", "cap"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), group))
    rest = F.col("budget") - F.sum("take").over(Window.partitionBy())
    extra = taken.withColumns({"place": place, "rest": rest})
    return extra.select(group, (F.col("take") + F.when((F.col("n") > F.col("cap")) & (F.col("place") <= F.col("rest")), 1).otherwise(0)).alias("quota"))


def water_fill(rows: DataFrame, group: str, key: str, budget: DataFrame, seed: int = 0) -> DataFrame:
    """At most `budget` rows, as evenly over groups as their sizes allow, those first in hash order within a group."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    return first_by_hash(rows, group, hash_order(seed, F.col(key)), cut(quotas(sizes, group, budget)))


def mix(rows: DataFrame, group: str, key: str, core: Column, repair: Column, target: int | Column, generic_share: float, repair_share: float, seed: int = 0) -> DataFrame:
    """(the columns of rows, part): core rows up to the target; generic ones up to their share of both and what is left of the target; repairs up to their share of all.

    Each part is water-filled over its groups.  Budgets are one-row tables, made from counts.
    """
    counts = rows.agg(F.count("*").alias("n"), F.count_if(core & ~repair).alias("n_core"), F.count_if(~core & ~repair).alias("n_generic"), F.count_if(repair).alias("n_repair"))
    counts = counts.withColumn("core", F.least(F.col("n_core"), F.lit(target) if isinstance(target, int) else target))
    room = (F.lit(target) if isinstance(target, int) else target) - F.col("core")
    allowed = F.floor(F.col("core") * generic_share / (1 - generic_share))
    counts = counts.withColumn("generic", F.least("n_generic", F.greatest(F.lit(0), F.least(room, allowed))).cast("long"))
    counts = counts.withColumn("repair", F.least("n_repair", F.floor((F.col("core") + F.col("generic")) * repair_share / (1 - repair_share))).cast("long"))
    out = None
    for name, chosen in (("core", core & ~repair), ("generic", ~core & ~repair), ("repair", repair)):
        taken = water_fill(rows.where(chosen), group, key, counts.select(F.col(name).cast("long").alias("budget")), seed).withColumn("part", F.lit(name))
        out = taken if out is None else out.unionByName(taken)
    return out


def systematic_sample(rows: DataFrame, stratum: str, key: str, step: int, offset: int, seed: int = 0, unique: str | None = None) -> DataFrame:
    """Every `step`-th row of all strata one after another, each in hash order.  With `unique`, a row whose value there occurs more than once gives way to the next of its stratum, less than `step` on, whose value is its own."""
    placed = numbered(rows, [F.col(stratum).asc_nulls_first(), hash_order(seed, F.col(key))], "__place")
    hit = F.pmod(F.col("__place") - offset, F.lit(step)) == 0
    if unique is None:
        return placed.where(hit & (F.col("__place") >= offset)).drop("__place")
    placed = cut(placed)
    many = bounded(rows.groupBy(unique).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(unique).alias("__many")))
    marked = placed.join(many, F.col(unique).eqNullSafe(F.col("__many")), "left").withColumn("__own", F.col("__many").isNull() & F.col(unique).isNotNull())
    # each hit answers for itself and the places up to the next one
    marked = marked.withColumn("__hit", F.col("__place") - F.pmod(F.col("__place") - offset, F.lit(step))).where("__hit >= 0")
    nearest = marked.groupBy("__hit", stratum).agg(F.max(hit).alias("__is"), F.min(F.when(F.col("__own"), F.col("__place"))).alias("__next"))
    chosen = nearest.where(F.col("__is") & F.col("__next").isNotNull()).select(F.col("__next").alias("__place"))
    return placed.join(chosen, "__place", "left_semi").drop("__place")


def scarce_copies(n: Column, wanted: int = 150, most: int = 3) -> Column:
    """How often each row of a group of n is taken."""
    return F.least(F.lit(most), F.ceil(wanted / n)).cast("int")


def upsample(rows: DataFrame, key: str, copies: Column) -> DataFrame:
    """Each row `copies` times; copies after the first have a marked `id`."""
    each = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    name = F.col(key).cast("string")
    return each.withColumn("id", F.when(F.col("__copy") == 0, name).otherwise(F.concat(name, F.lit("#dup"), F.col("__copy").cast("string")))).drop("__copy")
