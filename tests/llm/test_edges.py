"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for the numbered operators and the stages."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from tesserae.llm import bpe, chat, lines, minhash, packing, pieces, quality, secrets, substring, suffixes, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run long, least string, __gone string, __quality string"
PASSAGE = " ".join(f"word{i} is next{i} to the old{i} wall{i}" for i in range(30)) + "."
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")

OPERATORS = {
    "bpe": lambda d: bpe.digest_documents(d, PATH, public_tokenizers.PATTERN),
    "quality": quality.measure,
    "minhash": minhash.near_duplicates,
    "lines": lambda d: lines.remove_repeats(d, removed="n_removed_lines"),
    "substring": substring.remove_repeats,
    "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
    "suffixes": suffixes.remove_repeats,
    "pieces": lambda d: pieces.digest_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
}


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 1, 7, "x", "y", "z") for k, t in rows], SCHEMA)


ODD = [(1, PASSAGE), (2, None), (3, ""), (4, PASSAGE), (4, PASSAGE), (None, PASSAGE), (5, "é\n \n\t" * 3), (6, "long words and lines\n" * 30_000), (7, " ")]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    got = OPERATORS[name](table(spark, ODD)).collect()
    keys = [r["doc_id"] for r in got]
    if name == "packing":  # one row a piece: documents begin once each
        keys = [r["doc_id"] for r in got if r["start"] == 0]
    assert Counter(keys) == Counter(k for k, _ in ODD)


def test_repeated_keys_lose_no_text(spark):
    a, b = PASSAGE, " ".join(f"other{i} thing{i}" for i in range(60))
    got = minhash.near_duplicates(table(spark, [(1, a), (2, a), (3, b), (3, a), (4, b), (4, b)])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["kept"]) for r in got) == [(1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True), (4, 3, False), (4, 3, False)]
    left = minhash.keep_first(table(spark, [(1, a), (2, a), (3, b), (3, a), (4, b), (3, b), (None, a), (None, None), (7, None), (8, ""), (9, " ")])).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, a), (3, b), (0, a), (0, ""), (7, ""), (8, "")])


def test_row_hash_is_sparks(spark):
    texts = ["", "a", "é" * 50, "x" * 1000, "word " * 7]
    runs = minhash.make_runs(table(spark, list(enumerate(texts))), "doc_id", "text")
    got = {r["key"]: r["row"] for r in runs.select("run", "data").mapInArrow(minhash._who, minhash.WHO_DDL).collect()}
    assert got == {r["doc_id"]: r["h"] for r in table(spark, list(enumerate(texts))).selectExpr("doc_id", "xxhash64(text) AS h").collect()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_copies_are_found(spark):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, [(1, PASSAGE), (2, PASSAGE + " more"), (3, "other words " * 9)])).collect()}
    assert got[2]["class_id"] == 1 and not got[2]["kept"] and got[3]["kept"]
    got = {r["doc_id"]: r for r in substring.remove_repeats(table(spark, ODD)).collect() if r["doc_id"] is not None}
    assert got[1]["n_removed"] == 0 and got[4]["n_removed"] == got[4]["n_words"]


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages(spark, sf_dir, place, rows):
    docs = table(spark, rows)
    out = corpus_pipeline.STAGES[place][1](spark, docs, sf_dir)
    got = out.collect()
    if place < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert bool(got) == bool(rows)


def test_secrets(spark):
    key = "q7Zx9Lp2Vt4Rk8Wm3Nb6Hs1Yd5"
    docs = table(spark, [(1, f"the api_key = {key} is here"), (2, "see commit da39a3ee5e6b4b0d3255bfef95601890afd80709 for this"), (3, None)])
    out = {r["doc_id"]: r["text"] for r in secrets.mask(docs).collect()}
    assert key not in out[1] and secrets.MASK in out[1] and "da39a3ee" in out[2] and out[3] is None


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (None, 1, "x", "y"), (2, None, None, "z")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.perspectives(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown")}
    assert got[1, "ann"]["mask"] == "010" and [m["role"] for m in got[1, "bob"]["messages"]] == ["system", "user", "assistant"]
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_topk_ties_and_nulls(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 2).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]


def test_chat_and_topk_on_empty_and_clashing_tables(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<double>, query_id long, score long, rank int")
    assert topk.top_k(v, v, 3).count() == 0
    some = spark.createDataFrame([(0, [1.0, 2.0], 9, 9, 9), (1, [2.0, 1.0], 9, 9, 9), (2, [], 9, 9, 9)], v.schema)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(some, some.where("vec_id = 0"), 3).collect())
    assert got == [(0, 1, 1, 4 * 64 * 64)]
    turns = spark.createDataFrame([(1, 0, "ann", "hi", "p", "m", 1), (1, 1, "bob", "you", "p", "m", 1)], "conv_id long, turn long, role string, text string, perspective string, messages string, mask int")
    assert {r["perspective"] for r in chat.perspectives(turns).collect()} == {"ann", "bob"}
    assert chat.perspectives(turns.limit(0)).count() == 0
