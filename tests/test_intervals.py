"""Bootstrap intervals of many small groups."""

from __future__ import annotations

import random

from tesserae.operators import bootstrap


def test_small_groups_go_together(spark):
    """Taken whole, many by a task, or one by one as large ones: the same intervals, for groups of one row, ties and nulls too."""
    rng = random.Random(5)
    made = [(g, 1000 * g + i, float(rng.choice([1, 2, rng.random()]))) for g in range(40) for i in range(g % 13 + 1)] + [(None, 1, 1.0), (1, None, 1.0), (2, 2, None)] + [(50, 99_000 + i, i / 7) for i in range(300)]
    rows = spark.createDataFrame(made, "g long, k long, v double").repartition(3)
    one = lambda small: {r["g"]: (r["low"], r["high"]) for r in bootstrap.intervals(rows, "g", "k", "v", 230, small=small).collect()}
    together = one(bootstrap.SMALL)
    assert len(together) > 35 and together == one(0) == one(5)
    assert bootstrap.intervals(rows.where("false"), "g", "k", "v", 230).count() == 0
