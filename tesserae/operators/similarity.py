"""The most similar item of each row, by Jaccard similarity of sets, without comparing all pairs.

Elements that items have are numbered by how many rows hold them, the rarest first, so that elements that nearly all rows
hold come last.  The items of a row's first elements give it a first similarity.  An item that reaches it must share
so many elements that, in this order, it shares one early in both sets (prefix filter), and its size lies between
bounds (length filter).  Only items found that way, by an inverted index of the elements, are compared, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ranks import numbered
from tesserae.storage import bounded, cut

#: First elements of a row whose items give its first similarity.
SEEDS = 10
#: Rounding of the bounds; comparisons themselves are exact.
SLACK = 1e-9


def _known(sets: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """(key, size, element): the elements of each set that items have, with the size of the whole set; written."""
    sized = sets.select(key, F.size("elements").alias("size"), "elements")  # a size beside the generator would be taken for each element
    each = sized.select(key, "size", F.explode_outer("elements").alias("element")).where("element IS NOT NULL")
    return cut(each.join(vocabulary, "element", "left_semi"))


def _numbered_sets(known: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """(key, size, ids): the numbers of each set's elements, in order."""
    return cut(known.join(places, "element").groupBy(key).agg(F.max("size").alias("size"), F.sort_array(F.collect_list("id")).alias("ids")))


def _jaccard(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def _compared(pairs: DataFrame, rows: DataFrame, items: DataFrame, row: str, item: str) -> DataFrame:
    """(row, best): the greatest (similarity, -item, shared) over a row's pairs (row, item), each once."""
    found = pairs.join(rows, row).join(items.select(item, F.col("size").alias("__size"), F.col("ids").alias("__ids")), item)
    shared = F.size(F.array_intersect("ids", "__ids"))
    scored = found.select(row, item, shared.alias("shared"), "size", "__size")
    return scored.groupBy(row).agg(F.max(F.struct(_jaccard(F.col("shared"), F.col("size"), F.col("__size")).alias("score"), (-F.col(item)).alias("less"), "shared")).alias("best"))


def best_matches(rows: DataFrame, row: str, items: DataFrame, item: str) -> DataFrame:
    """(row, item, score, shared) of each row that shares an element with any item: the most similar one, of equal ones that of the smallest number.

    rows and items: a key that tells them apart, and `elements`, an array without repetitions.
    """
    vocabulary = bounded(items.select(F.explode("elements").alias("element")).distinct())
    own = _known(rows, row, vocabulary)
    counts = own.groupBy("element").agg(F.count("*").alias("n"))
    places = bounded(numbered(counts, [F.col("n"), F.col("element")], "id").select("element", F.col("id").cast("int").alias("id")))
    own, asked = _numbered_sets(own, row, places), _numbered_sets(_known(items, item, vocabulary), item, places)
    index = asked.select(F.col(item), F.col("size").alias("__size"), F.size("ids").alias("__known"), F.posexplode("ids").alias("__at", "id"))
    index = bounded(index)
    small = bounded(asked)
    seeds = own.select(row, F.explode(F.slice("ids", 1, SEEDS)).alias("id")).join(index, "id").select(row, item).distinct()
    first = cut(_compared(seeds, own, small, row, item))
    # an item as similar as the first shares at least `need` elements
    known, score = F.size("ids"), F.col("best.score")
    least = F.ceil(score * F.col("size") - SLACK)
    begun = own.join(first, row).select(row, "size", known.alias("known"), score.alias("score"), F.slice("ids", 1, F.greatest(known - least + 1, F.lit(0)).cast("int")).alias("early"))
    begun = begun.select(row, "size", "known", "score", F.posexplode("early").alias("at", "id"))
    need = F.ceil(F.col("score") / (1 + F.col("score")) * (F.col("size") + F.col("__size")) - SLACK)
    most = F.least(F.col("known") - F.col("at"), F.col("__known") - F.col("__at"))
    near = (F.col("__size") >= F.col("score") * F.col("size") - SLACK) & (F.col("size") >= F.col("score") * F.col("__size") - SLACK)
    met = begun.join(index, "id").where(near & (most >= need)).select(row, item).distinct()
    second = _compared(met, own, small, row, item)
    best = first.unionByName(second).groupBy(row).agg(F.max("best").alias("best"))
    return best.select(row, (-F.col("best.less")).alias(item), F.col("best.score").alias("score"), F.col("best.shared").alias("shared"))
