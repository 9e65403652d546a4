"""SentencePiece by distinct chunks against the library on whole texts."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tesserae.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n: int = 400) -> list[str | None]:
    rng = random.Random(5)
    letters = ["a", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "▁", "é", "ﬁ", "漢字", "‍", "👩", "\x00", "</s>", "<0x0A>", ".", "1", "　", " ", "x" * 300]
    return [None, "", " ", "\n", "▁", "\n\n", " \n ", *["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(n)], "word " * 50_000, "z" * 200_000, " " * 5000]


def test_segments(model):
    own = pieces.Pieces(PATH)
    for t in odd_texts():
        if t:
            found = [i for ids in own.segment(pieces.chunks_of(t)) for i in ids.tolist()]
            assert found == model.encode(t)
            assert b"".join(own.decode(ids) for ids in own.segment(pieces.chunks_of(t)))[1:].decode() == model.decode(found)


def test_small_blocks(spark, model, monkeypatch):
    """Several blocks and parts; repeated and null keys."""
    monkeypatch.setattr(pieces, "PART_BYTES", 500)
    monkeypatch.setattr(pieces.make_blocks, "__defaults__", (20_000,))
    texts = odd_texts(150) * 2
    docs = spark.createDataFrame([(None if i % 50 == 3 else i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = pieces.encode_documents(docs, PATH).collect()
    want = [(None if i % 50 == 3 else i // 2, [*model.encode(t or ""), model.eos_id()], model.decode([*model.encode(t or ""), model.eos_id()])) for i, t in enumerate(texts)]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0


def test_query(spark, sf_dir, model):
    import duckdb

    want = []
    for key, text in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet')").fetchall():
        ids = [*model.encode(text or ""), model.eos_id()]
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.op13_piece_bpe(spark, sf_dir).collect())) == sorted(want)


def test_texts_without_chunks(spark, model):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, pieces.encode_documents(docs, PATH).collect())) == [(1, [model.eos_id()], ""), (2, [model.eos_id()], "")]
