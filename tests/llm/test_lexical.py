"""Lexical search against scores of all pairs, in small tiles, blocks and lists."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import lexical
from tests.comparing import assert_same

DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string, doc_id int"


def brute(docs, items, k):
    held = [(d, Counter(lexical.terms_of(t))) for d, t in docs if lexical.terms_of(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in lexical.terms_of(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made(n_docs: int):
    rng = random.Random(n_docs)
    words = [f"w{i}" for i in range(60)] + ["É", "the", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n_docs)]
    docs += [(None, docs[0][1]), (None, docs[0][1]), (5, docs[0][1]), (9000, None), (9001, ""), (9002, " .,;"), (9003, "w1 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(25)]
    return docs, [*items, (3, "the w1"), (None, "w2 w2 w7"), (100, None), (101, ""), (102, "absent"), (103, docs[0][1])]


@pytest.mark.parametrize("tile_docs, block_chars", [(16, 120), (4096, 1 << 20)])
def test_all_pairs(spark, monkeypatch, tile_docs, block_chars):
    monkeypatch.setattr(lexical, "TILE_DOCS", tile_docs)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", block_chars)
    docs, items = made(300)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS).repartition(4)
    idf = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(df, idf, 6).collect()]
    assert sorted(got, key=repr) == brute(docs, items, 6)
    for empty in (lexical.search(df.limit(0), idf), lexical.search(df, idf.limit(0))):
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_bounds_prune():
    """Rare terms settle an item: the many documents that hold only its frequent terms aren't rescored, and seeds alone bound from the first tile on."""
    n = 3000
    columns = lexical.Tile.columns(list(range(n)), [10] * n, [0] * n + [1] * 40 + [2] * 30, [*range(n), *range(40), *range(30)], [1] * (n + 70))
    tile = lexical.Tile(*columns)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in (n, 40, 30)], np.int64)
    impacts = tile.impacts(weight, n, 10 * n)
    seeds = np.array([0, *[int(np.sort(impacts[tile.starts[t] : tile.starts[t + 1]])[-20]) for t in (1, 2)]], np.int64)
    scorer = lexical.Scorer([(np.array([0, 1, 2]), np.array([1, 1, 1]))], seeds, 20)
    scorer.see(tile, impacts)
    assert scorer.rescored <= 40
    assert sorted(scorer.best[0][0].tolist()) == list(range(20))


def test_query(spark, sf_dir):
    assert_same(lexical.op12_lexical_search(spark, sf_dir), sf_dir, lexical.ORACLE_SQL)
