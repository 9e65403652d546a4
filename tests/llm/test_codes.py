"""Vector codes against SQL and a plain version; the filter against all distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tesserae.llm import codes
from tests.comparing import assert_same

SCHEMA = "vec_id long, embedding array<double>, label string, code int"


def brute(rows, rounds, parts, n_entries):
    kept = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sub = dim // parts
        books = [[r[1][p * sub : (p + 1) * sub] for r in own[:n_entries]] for p in range(parts)]

        def near(p, v, books=books):
            return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(books[p]))

        for _ in range(rounds):
            for p in range(parts):
                groups = {}
                for r in own:
                    v = r[1][p * sub : (p + 1) * sub]
                    groups.setdefault(near(p, v)[1], []).append(v)
                books[p] = [[sum(c) // len(c) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for k, v, label in own:
            found = [near(p, v[p * sub : (p + 1) * sub]) for p in range(parts)]
            out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), label, digest))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((k, c, e, total[label], d) for k, c, e, label, d in out), key=repr)


def made():
    rng = np.random.default_rng(3)
    rows = [(i, (np.round(rng.normal(size=8), 1)).tolist(), [None, "a", "b"][i % 3]) for i in range(120)]
    rows += [(7, [0.5] * 8, "a"), (7, [0.5] * 8, "a"), (None, [-0.5] * 8, None), (500, None, "a"), (501, [float("nan")] + [0.0] * 7, "a"), (502, [None] + [0.0] * 7, "b"), (503, [float("inf")] * 8, "b")]
    return [*rows, (600, [1.0, 2.0, 3.0], "a"), (601, [], "c"), (602, [0.25, 0.5, 0.75, -0.001], "c"), (603, [1.25, 0.5, 0.75, 3.0], "c")]


@pytest.mark.parametrize("entries", [5, 256])
def test_rounds(spark, entries):
    rows = made()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    coded, books = codes.encode(df, rounds=2, entries=entries)
    got = [(r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label_error"], codes.codebooks_digest(books[r["dim"]])) for r in codes.with_label_error(coded).collect()]
    assert sorted(got, key=repr) == brute(rows, 2, 4, entries)


def test_filter_keeps_ties_and_skips_the_far():
    rng = np.random.default_rng(4)
    entries = np.concatenate([rng.integers(-900, 900, (200, 6)), np.zeros((3, 6), np.int64)])
    entries[150] = entries[20]
    parts = np.concatenate([rng.integers(-2000, 2000, (1500, 6)), entries[[20, 150, 200, 202]]])
    index, error, refined = codes.Filter(entries).nearest(parts)
    distance = np.square(parts[:, None, :] - entries[None]).sum(axis=2)
    assert (index == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    assert refined < distance.size / 4


def test_too_large_fails():
    with pytest.raises(OverflowError):
        codes._check(np.full((1, 2), 1 << 40), np.zeros((1, 2), np.int64))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    coded, books = codes.encode(df)
    assert codes.with_label_error(coded).count() == 0 and books == {}


def test_query(spark, sf_dir):
    assert_same(codes.op11_vector_codes(spark, sf_dir), sf_dir, codes.ORACLE_SQL)
