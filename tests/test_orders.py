"""Places, selection, hash thresholds and inversion counts against plain definitions, with groups cut by ranges and ties."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import curation, inversions, ranks, selection


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_numbered(spark, groups):
    """One length for all rows, and groups of which one holds most rows; null groups are a group."""
    rng = random.Random(1)
    rows = [(i, 7, rng.choice(["a"] * 8 + ["b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, n int, g string").repartition(5)
    got = {r["k"]: r["place"] for r in ranks.numbered(df, [F.col("n"), F.desc("k")], groups=groups, parts=16).collect()}
    want = {}
    for g in {r[2] for r in rows} if groups else {0}:
        own = sorted((k for k, _, h in rows if not groups or h == g), reverse=True)
        want |= {k: i for i, k in enumerate(own)}
    assert got == want
    sizes = ranks.ranged(df, [F.col("n"), F.desc("k")], 16).groupBy("__range").count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 1000
    assert ranks.numbered(df.limit(0), [F.col("n")], groups=groups).count() == 0


def test_first_by_hash(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 11}") for i in range(4000)]
    df = spark.createDataFrame([*rows, (5000, None), (5001, None)], "k long, g string")
    quotas = spark.createDataFrame([("hot", 1500), ("g0", 5), ("g1", 10_000), ("g2", 0), (None, 1)], "g string, quota long")
    digest = F.sha2(F.col("k").cast("string"), 256)
    got = {}
    for r in ranks.first_by_hash(df, "g", digest, quotas).collect():
        got.setdefault(r["g"], set()).add(r["k"])
    order = {r["k"]: r["h"] for r in df.select("k", digest.alias("h")).collect()}
    for g, n in (("hot", 1500), ("g0", 5), ("g1", 10_000), (None, 1)):
        own = sorted((order[k], k) for k, h in [*rows, (5000, None), (5001, None)] if h == g)
        assert got.pop(g) == {k for _, k in own[:n]}
    assert not got


def test_order_bits(spark):
    special = [0.0, -0.0, 1.0, -1.0, 2.0**-1074, -(2.0**-1074), 2.0**-1022, 2.0**-1022 - 2.0**-1074, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 8.0, math.nextafter(8.0, 0), math.nextafter(8.0, 9)]
    rng = np.random.default_rng(2)
    made = [*special, *(rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist(), *[2.0**e for e in range(-1070, 1024, 13)], *[math.nextafter(2.0**e, 0) for e in range(-1020, 1024, 11)]]
    got = [(r["v"], r["b"] & (1 << 64) - 1) for r in spark.createDataFrame([(v,) for v in made], "v double").select("v", selection.order_bits(F.col("v")).alias("b")).collect()]
    for v, b in got:
        plain = struct.unpack("<Q", struct.pack("<d", v + 0.0 if v else 0.0))[0]
        assert b == (plain ^ (1 << 64) - 1 if v < 0 else plain | 1 << 63), v
    nan = spark.range(1).select(selection.order_bits(F.lit(float("nan"))).alias("b")).first()["b"]
    assert nan & (1 << 64) - 1 > max(b for _, b in got)


def test_percentiles_of_large_groups(spark):
    """A group of all-different values over many magnitudes, one of a single value, small ones, and groups without values."""
    rng = np.random.default_rng(3)
    hot = (rng.normal(size=20_000) * 10.0 ** rng.integers(-3, 3, 20_000)).tolist()
    near = [1.0 + i * 2.0**-52 for i in range(3000)]
    rows = [("hot", v) for v in hot] + [("near", v) for v in near] + [("one", 2.5)] * 4000 + [("small", v) for v in (3.0, -1.0, 7.0, None)] + [("none", None), (None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for large in (100, 1 << 20):
        got = {r["g"]: r for r in selection.percentiles(df, ["g"], "v", wanted, large).collect()}
        assert set(got) == {"hot", "near", "one", "small", None}
        for g, r in got.items():
            own = [v for h, v in rows if h == g and v is not None]
            assert r["n"] == len(own)
            for name, q in wanted.items():
                assert math.isclose(r[name], float(np.quantile(own, q)), rel_tol=1e-12), (g, name)
    whole = selection.percentiles(df, [], "v", {"p": 0.37}, 50).first()
    assert math.isclose(whole["p"], float(np.quantile([v for _, v in rows if v is not None], 0.37)), rel_tol=1e-12)
    assert selection.percentiles(df.limit(0), ["g"], "v", wanted).count() == 0


def test_opposite():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 200):
        g, x, y, w = rng.integers(0, 3, n), rng.integers(0, 8, n), rng.integers(0, 9, n) / 4, rng.integers(1, 4, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if g[i] == g[j] and x[i] < x[j] and y[i] > y[j])
        assert inversions.opposite(g, x, y, w) == want
    big = np.array([1 << 33, 1 << 33])
    assert inversions.opposite(np.zeros(2), np.array([0, 1]), np.array([1, 0]), big) == 1 << 66


def test_reordered_pairs(spark):
    """A hot group, many ties in both measures."""
    rng = random.Random(6)
    rows = [("hot" if i % 4 else f"g{i % 5}", rng.randrange(12) / 4, rng.randrange(300) / 7 if i % 2 else 3.0) for i in range(900)]
    df = spark.createDataFrame([*rows, ("hot", None, 1.0), (None, 1.0, 2.0)], "g string, a double, b double")
    want = [0, 0]
    for i, (g, a0, a1) in enumerate(rows):
        for h, b0, b1 in rows[:i]:
            if g == h and (a0, a1) != (b0, b1):
                want[0] += 1
                want[1] += (a0 == b0) or ((a0 < b0 and a1 > b1) or (a0 > b0 and a1 < b1))
    got = inversions.reordered_pairs(df, "g", "a", "b").first()
    assert [int(got["n_pairs"]), int(got["n_changed"])] == want
    assert tuple(map(int, inversions.reordered_pairs(df.limit(0), "g", "a", "b").first())) == (0, 0)


def test_sample_over_strata(spark):
    """Every step-th of all strata in turn equals places counted by hand."""
    rows = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(500)], "k long, s string")
    order = [r["k"] for r in rows.orderBy("s", F.sha2(F.concat(F.lit("0:"), F.col("k").cast("string")), 256)).collect()]
    assert {r["k"] for r in curation.systematic_sample(rows, "s", "k", 20, 3).collect()} == set(order[3::20])


def test_bootstrap_medians(spark, monkeypatch):
    """Groups beyond and below the bound, with ties; the window of a large one too narrow at first; rows of weight 0 only."""
    from tesserae.operators import bootstrap

    rng = np.random.default_rng(5)
    rows = [(1, i, float(v)) for i, v in enumerate(rng.normal(size=700))] + [(2, i, float(v)) for i, v in enumerate(rng.integers(0, 3, 300))] + [(3, 5, 1.0), (4, 6, 2.0), (4, 7, 8.0), (None, 1, 1.0), (5, 1, None)]
    df = spark.createDataFrame(rows, "g long, k long, v double").repartition(4)
    want = {}
    for g in (1, 2, 3, 4):
        own = [(k, v) for h, k, v in rows if h == g]
        w = bootstrap.weights(np.array([k for k, _ in own]), 0, 230)
        for b in range(230):
            drawn = np.repeat([v for _, v in own], w[:, b])
            if len(drawn):
                want[g, b] = float(np.median(drawn))
    assert len(want) < 4 * 230
    for large, spread, hot in ((1 << 20, 8, 5000), (100, 8, 20), (100, 0.2, 50)):
        monkeypatch.setattr(bootstrap, "HOT", hot)
        got = {(r["g"], r["b"]): r["median"] for r in bootstrap.medians(df, "g", "k", "v", 230, large, spread).collect()}
        assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)
    w = bootstrap.weights(np.arange(3000), 0, 300)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08


def test_best_matches(spark):
    """A word that all rows and items hold, words that most hold, equal scores, sets without partners, sizes far apart."""
    from tesserae.operators import similarity

    rng = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    made = lambda k, n: sorted({"all", *rng.sample(common, k), *(f"r{rng.randrange(400)}" for _ in range(n))})
    items = [(i, made(rng.randrange(0, 25), rng.randrange(0, 12))) for i in range(60)] + [(60, ["all"]), (61, ["lone"]), (62, [])]
    rows = [(i, made(rng.randrange(0, 30), rng.randrange(0, 30))) for i in range(400)] + [(400, items[7][1]), (401, ["nothing"]), (402, []), (403, None), (404, ["all", "x1", "x2"])]
    got = {r["r"]: (r["i"], round(r["score"], 12), r["shared"]) for r in similarity.best_matches(spark.createDataFrame(rows, "r long, elements array<string>"), "r", spark.createDataFrame(items, "i long, elements array<string>"), "i").collect()}
    want = {}
    for r, own in rows:
        scores = [(-len(set(own or []) & set(e)) / len(set(own or []) | set(e)), i, len(set(own or []) & set(e))) for i, e in items if set(own or []) & set(e)]
        if scores:
            s, i, n = min(scores)
            want[r] = (i, round(-s, 12), n)
    assert got == want and got[400][1] == 1.0
