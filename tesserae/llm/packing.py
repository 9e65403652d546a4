"""Packing of documents into training sequences, in order, by dynamic programming over window cuts.

The documents of an input split form one stream of tokens, each document with an end token behind it, taken in
segments of about half a million tokens.  A window may end where a document ends (free), where a sentence ends or, only
inside sentences longer than a window, anywhere else in steps (at a penalty in tokens each, for truncation).  A window
of a power of two tokens needs no padding; others are padded to the full length.  The programme minimises
padding plus penalties:  best(j) = penalty(j) + min over i of best(i) + padding(j - i).  For padded windows that is
the minimum of best(i) + i over a sliding range of places, which a monotone queue gives; the windows of an exact power
of two are looked up, of each place.  Nothing is shuffled; a split's state is a segment, or its longest document.

Null text: empty, so just the end token.  Null and repeated keys: each row is a document of its own.  Other columns
are ignored.  The order is that of the input; a split that runs again gives the same windows.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import read, with_key
from tesserae.llm.runs import batches_of

WINDOW = 2048
SEGMENT = 1 << 19
SENTENCE_PENALTY = 2
HARD_PENALTY = 32
HARD_STEP = 256
END_ID = 1
LONG_SPACE = 20_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")

PIECE = pa.schema([("__key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("sequence_length", pa.int64())])
PIECE_DDL = "__key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_length long"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Ids of texts as the tokenizers library gives them.

    The file's vocabulary is byte-level BPE whose ids are the ranks of its merges, so that the same merges can be made
    by tiktoken's loop, which is several times faster; the tests hold both libraries against each other.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        kind, letters, vocab = found["pre_tokenizer"], _byte_letters(), found["model"]["vocab"]
        if kind["type"] != "ByteLevel" or kind["add_prefix_space"] or found["normalizer"]:
            raise ValueError("not a plain byte-level vocabulary")
        special = {x["content"]: x["id"] for x in found["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        plain = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)
        self.ordinary = plain.encode_ordinary
        self.path, self.slow = path, None
        #: By id: the penalty of a cut behind it, 0 where none is offered.
        self.costs = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            if token.endswith((b".", b"!", b"?", b"\n")):
                self.costs[i] = SENTENCE_PENALTY

    def plainly(self, text: str) -> list[int]:
        """By the tokenizers library: texts with special tokens, or with stretches of white space too long for the other's regular expressions."""
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Arrays of ids, the end token last."""
        out = []
        for t in texts:
            odd = any(x in t for x in self.special) or len(t) >= LONG_SPACE and _LONG_SPACE.search(t)
            ids = array("I", self.plainly(t) if odd else self.ordinary(t))
            ids.append(END_ID)
            out.append(np.frombuffer(ids, np.uint32))
        return out


def cut_places(costs: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Where windows may end, and each place's penalty.  costs: for each document, the penalty of a cut behind each token, or 0."""
    places, penalties, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for own in costs:
        n = len(own)
        inner = np.append(np.flatnonzero(own[:-1]) + 1, n)
        gaps = np.diff(inner, prepend=0)
        if gaps.max() > WINDOW:
            hard = np.concatenate([np.arange(b - g + HARD_STEP, b, HARD_STEP) for b, g in zip(inner.tolist(), gaps.tolist(), strict=True) if g > WINDOW])
            both = np.concatenate([inner, hard])
            cost = np.concatenate([own[inner - 1], np.full(len(hard), HARD_PENALTY)])
            order = np.argsort(both, kind="stable")
            inner, cost = both[order], cost[order]
        else:
            cost = own[inner - 1]
        cost[-1] = 0
        places.append(inner + first)
        penalties.append(cost)
        first += n
    return np.concatenate(places).tolist(), np.concatenate(penalties).tolist()


_POWERS = [1 << k for k in range(WINDOW.bit_length())]


def best_cuts(places: list[int], penalties: list[int]) -> list[int]:
    """The cheapest ends of windows, the last place among them."""
    places, penalties = [0, *places], [0, *penalties]
    best, came, at = [0] * len(places), [0] * len(places), {0: 0}
    queue = deque([0])  # indices of rising place and rising best + place
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0]] < p - WINDOW:
            queue.popleft()
        i = queue[0]
        cost = best[i] + places[i] - p + WINDOW
        for power in _POWERS:
            exact = at.get(p - power)
            if exact is not None and best[exact] < cost:
                i, cost = exact, best[exact]
        cost += penalties[j]
        best[j], came[j], at[p] = cost, i, j
        value = cost + p
        while queue and best[queue[-1]] + places[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = came[j]
    return cuts[::-1]


def pack_segment(keys: list, ids: list[np.ndarray], costs: np.ndarray, first_sequence: int) -> Iterator[tuple]:
    """The pieces of one segment."""
    lengths = [len(x) for x in ids]
    cuts = best_cuts(*cut_places([costs[x] for x in ids]))
    doc, used, begin = 0, 0, 0
    for number, end in enumerate(cuts):
        total, offset = end - begin, 0
        padded = total if total & (total - 1) == 0 else WINDOW
        while offset < total:
            take = min(lengths[doc] - used, total - offset)
            yield keys[doc], used, take, ids[doc][used : used + take].tobytes(), lengths[doc], first_sequence + number, offset, total, padded
            offset += take
            used += take
            if used == lengths[doc]:
                doc, used = doc + 1, 0
        begin = end


_LOADED: dict[str, Tokens] = {}


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: key, start, length, `ids` (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, and the sequence's tokens and padded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _LOADED.setdefault(tokenizer, None) or Tokens(tokenizer)
        _LOADED[tokenizer] = tokens

        def pieces():
            keys: list = []
            ids: list[np.ndarray] = []
            size, segment, base = 0, 0, TaskContext.get().partitionId() << 40
            for some_keys, texts in _some(batches):
                for k, x in zip(some_keys, tokens.encode(texts), strict=True):
                    keys.append(k)
                    ids.append(x)
                    size += len(x)
                    if size >= SEGMENT:
                        yield from pack_segment(keys, ids, tokens.costs, base + (segment << 20))
                        keys, ids, size, segment = [], [], 0, segment + 1
            if ids:
                yield from pack_segment(keys, ids, tokens.costs, base + (segment << 20))

        return batches_of(pieces(), PIECE, 8 << 20)

    return with_key(docs, key, text).mapInArrow(run, PIECE_DDL).withColumnRenamed("__key", key)


def _some(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts, about a megabyte of text at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        k_column, t_column = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            t = t_column[i].as_py() or ""
            keys.append(k_column[i].as_py())
            texts.append(t)
            size += len(t)
            if size >= most:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
