"""Removal of word sequences that also start in an earlier document, by fixed-block anchors.

Any window of 13 words holds a whole block of 7 words that starts at a multiple of 7 in its document.  So:

1. Every document's non-overlapping blocks are the index, and every rolling window of 7 words is a probe.  Both meet
   by hash; a run learns which of its own blocks are found in more than one document.
2. Windows of 13 words that hold such a block are candidates.  Each run sends every different candidate once, with
   the smallest document that has it there; the smallest overall comes back where it is another run's.
3. Hits grow to maximal repeats: all words of all windows that an earlier document has are removed.

Windows are compared by 96 bits of two independent hashes over 64-bit word hashes.  Hot passages cost one entry a run,
however many of its documents hold them.

Null text: no words (digest of the empty string).  Null key: the row is returned as it is, and is no source.  Rows with
equal keys don't remove each other's words.  Texts shorter than a window lose nothing.  Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import read
from tesserae.llm.runs import SENT, SENT_DDL, by_bucket, each_destination, each_run, make_runs, pack, plan, ranges_to_mask, unpack, unpack_texts, with_runs

WINDOW = 13
BLOCK = 7
_SHARED, _INDEXED = 1, 2

KEPT = pa.schema([("__key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("kept", pa.string())])
KEPT_DDL = "__key long, n_words long, n_removed long, starts array<long>, lengths array<long>, kept string"


class RunWords:
    """The words of a run, one after another: their hashes, documents and places in them."""

    def __init__(self, data: bytes):
        self.keys, self.words, counts = [], [], []
        for k, raw in unpack_texts(data):
            words = (raw or b"").split()  # at the six ASCII white-space bytes
            self.keys.append(k)
            self.words.append(words)
            counts.append(len(words))
        self.counts = np.array(counts, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        n = int(self.first[-1])
        digest = xxhash.xxh3_64_intdigest
        self.ids = np.fromiter((digest(w) for words in self.words for w in words), np.uint64, n)
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        self.place = np.arange(n) - self.first[self.doc]
        self.key = np.array([0 if k is None else k for k in self.keys], np.int64)
        self.known = np.array([k is not None for k in self.keys], bool)

    def windows(self, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a window of so many words of one keyed document starts, and its hash."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j, c in enumerate(np.random.default_rng(seed).integers(1, 1 << 63, width, np.uint64)):
            total += self.ids[j : j + n] * (c * np.uint64(2) + np.uint64(1))
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
        at = np.flatnonzero((self.doc[:n] == self.doc[width - 1 :]) & self.known[self.doc[:n]])
        return at, total[at]


def _candidates(words: RunWords, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (or those in `keep`): start, hash, second hash."""
    at, main = words.windows(WINDOW, 13)
    _, other = words.windows(WINDOW, 31)
    other >>= np.uint64(32)
    if keep is not None:
        chosen = keep[at]
        at, main, other = at[chosen], main[chosen], other[chosen]
    return at, main, other


def _send_blocks(buckets: int, bits: int):
    """Every rolling window of BLOCK words probes; those at multiples of BLOCK are marked as index blocks.  A false match of the exchanged bits only makes a window a candidate."""

    def send(run: int, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        words = RunWords(data)
        at, hashes = words.windows(BLOCK, 7)
        if not len(at):
            return
        hashes = hashes >> np.uint64(64 - bits)
        order = np.argsort(hashes, kind="stable")
        hashes, docs, indexed = hashes[order], words.key[words.doc[at[order]]], (words.place[at] % BLOCK == 0)[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        many = np.zeros(len(hashes), bool)
        many[1:] = ~new[1:] & (docs[1:] != docs[:-1])
        first = np.flatnonzero(new)
        marks = _SHARED * np.logical_or.reduceat(many, first) + _INDEXED * np.logical_or.reduceat(indexed, first)
        single = hashes[first]
        for b, part in by_bucket(single, bits, buckets):
            yield b, 0, struct.pack("<q", run) + pack(single[part], marks[part])

    return send


def _match_blocks(dest: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """Each run hears which of its index blocks are found in more than one document."""
    got = [(struct.unpack_from("<q", data)[0], *unpack(data[8:])) for _, data in sent]
    keys = np.sort(np.concatenate([x for _, x, _ in got]))
    found = np.unique(np.concatenate([keys[1:][keys[1:] == keys[:-1]], *(x[m & _SHARED > 0] for _, x, m in got)]))
    for run, own, marks in got:
        own = own[marks & _INDEXED > 0]
        if len(found):
            own = own[found[np.minimum(np.searchsorted(found, own), len(found) - 1)] == own]
            if len(own):
                yield run, 0, pack(own)


def _send_windows(buckets: int, bits: int):
    def receive(run: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        found: list[np.ndarray] = []
        for kind, data in sent:
            if kind == 0:
                found.append(unpack(data)[0])
            elif found:
                words = RunWords(data)
                at, hashes = words.windows(BLOCK, 7)
                own = words.place[at] % BLOCK == 0
                at, hashes = at[own], hashes[own] >> np.uint64(64 - bits)
                starts = at[np.isin(hashes, np.concatenate(found))]
                first = np.maximum(starts - (WINDOW - BLOCK), 0)
                n = len(words.ids)
                change = np.zeros(n + 1, np.int32)
                np.add.at(change, first, 1)
                np.add.at(change, starts + 1, -1)
                at, main, other = _candidates(words, np.cumsum(change[:-1]) > 0)
                docs = words.key[words.doc[at]]
                order = np.lexsort((docs, other, main))
                main, other, docs = main[order], other[order], docs[order]
                new = np.concatenate([[True], (main[1:] != main[:-1]) | (other[1:] != other[:-1])])[: len(main)]
                main, other, docs = main[new], other[new], docs[new]
                for b, part in by_bucket(main, 64, buckets):
                    yield b, 0, struct.pack("<q", run) + pack(main[part], other[part], docs[part])

    return receive


def _match_windows(dest: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """The smallest document of each window goes to the runs that have none as small."""
    runs, columns = [], []
    for _, data in sent:
        runs.append(struct.unpack_from("<q", data)[0])
        columns.append(unpack(data[8:]))
    main, other, docs = (np.concatenate([c[i] for c in columns]) for i in range(3))
    source = np.repeat(np.arange(len(runs)), [len(c[0]) for c in columns])
    order = np.lexsort((docs, other, main))
    main, other, docs, source = main[order], other[order], docs[order], source[order]
    new = np.concatenate([[True], (main[1:] != main[:-1]) | (other[1:] != other[:-1])])
    least = docs[new][np.cumsum(new) - 1]
    later = np.flatnonzero(docs > least)
    later = later[np.argsort(source[later], kind="stable")]
    edges = np.searchsorted(source[later], np.arange(len(runs) + 1))
    for i, run in enumerate(runs):
        part = later[edges[i] : edges[i + 1]]
        if len(part):
            yield run, 0, pack(main[part], other[part], least[part])


def _remove(run: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    told: list[list[np.ndarray]] = []
    for kind, data in sent:
        if kind == 0:
            told.append(unpack(data))
            continue
        words = RunWords(data)
        at, main, other = _candidates(words, None)
        docs = words.key[words.doc[at]]
        known = [np.concatenate(c) for c in zip(*told)] if told else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        # what other runs have, then what this one has; the smallest document first
        hashes, checks = np.concatenate([known[0], main]), np.concatenate([known[1], other.astype(np.int64)])
        keys = np.concatenate([known[2], docs])
        order = np.lexsort((keys, checks, hashes))
        hashes, checks, keys = hashes[order], checks[order], keys[order]
        removed = np.zeros(len(words.ids), bool)
        if len(order):
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
            later = order[keys > keys[new][np.cumsum(new) - 1]] - len(known[0])
            removed = ranges_to_mask(at[later[later >= 0]], WINDOW, len(words.ids)) if len(words.ids) else removed
        for i, (key, own) in enumerate(zip(words.keys, words.words, strict=True)):
            gone = removed[words.first[i] : words.first[i + 1]]
            n = int(gone.sum())
            if not n:
                yield key, len(own), 0, [], [], b" ".join(own).decode("utf-8", "surrogatepass")
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept = b" ".join([w for w, x in zip(own, gone.tolist(), strict=True) if not x])
            yield key, len(own), n, edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), kept.decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed, the removed spans (`starts` and `lengths`, in words) and `kept`, the other words joined by a space."""
    runs = make_runs(docs, key, text)
    buckets, parts, bits, _ = plan(runs)
    blocks = each_destination(each_run(runs, _send_blocks(buckets, bits)), _match_blocks, SENT, SENT_DDL, parts)
    windows = each_destination(with_runs(runs, blocks), _send_windows(buckets, bits), SENT, SENT_DDL, parts)
    told = each_destination(windows, _match_windows, SENT, SENT_DDL, parts)
    return each_destination(with_runs(runs, told), _remove, KEPT, KEPT_DDL, parts).withColumnRenamed("__key", key)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
