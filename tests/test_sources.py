"""Source texts are dealt to all tasks, and looked at no more often than they differ."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tesserae.functions import code
from tesserae.plans import code as plans
from tesserae.plans.registry import Tables
from tesserae.storage import shuffle_parts


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sources_are_dealt(spark, sf_dir):
    """part is one small file, which alone would be one task."""
    x = Tables(spark, sf_dir)
    assert x.part.rdd.getNumPartitions() == 1
    for df in (plans.sources(x), plans.rename(x)):
        assert df.rdd.getNumPartitions() == shuffle_parts(spark) > 1


def test_features_are_made_once(spark, sf_dir):
    """The keys and the join read what was written."""
    assert "EvalPython" not in plan(plans.source_features(Tables(spark, sf_dir)))


def test_equal_texts_are_looked_at_once():
    seen = []
    found = code._told(pd.Series(["a", None, "b", "a", None]), lambda c: (seen.append(c), c)[1:] * 2, ["x", "y"])
    assert len(seen) == 3 and found["x"].tolist() == ["a", None, "b", "a", None] and list(found) == ["x", "y"]


def test_parses(spark, sf_dir):
    """Only whether a text parses is told, without its features."""
    texts = ["x = 1", "def f(:", "", None, "x = 1", "\0", "(" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = [r["p"] for r in rows.select("i", code.parses(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [True, False, True, True, True, False, False]
    assert "ast_key" not in plan(plans.format_guard(Tables(spark, sf_dir)))
