"""Runs of documents, and the exchange of packed numbers between them.

A run is a few megabytes of documents in one compressed row.  Runs are written once to the shared folder, so that a
run's number means the same rows in every later job, whatever executors are lost.  What jobs exchange about
positions in runs are sorted arrays, stored as differences in byte planes and compressed: a fraction of what a row
for each position would take.  Rows are dealt by a destination number; destinations are many more than partitions,
and what a destination gets is bounded by the positions whose hashes fall to it, where equal hashes of one run are
combined before they are sent.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, rows, shuffle_parts, with_key

RUN_BYTES = 3 << 20
#: What a row counts besides its text.
ROW_BYTES = 24
#: Destinations for each shuffle partition at least, and bytes of text for each destination at most.
SPREAD = 2
DESTINATION_BYTES = 12 << 20
#: Bits of an exchanged hash beyond those that count the bytes of all texts.
SPARE_BITS = 8

RUN = pa.schema([("run", pa.int64()), ("size", pa.int64()), ("known", pa.int64()), ("data", pa.binary())])
SENT = pa.schema([("dest", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SENT_DDL = "dest long, kind int, data binary"

_NULL_KEY = -(1 << 63)


def pack_texts(held: list[tuple[int | None, str | None]]) -> bytes:
    """Keys, and texts as UTF-8; a null text is marked by length -1, a null key by the smallest number."""
    raw = [None if t is None else t.encode("utf-8", "surrogatepass") for _, t in held]
    keys = np.array([_NULL_KEY if k is None else k for k, _ in held], np.int64)
    sizes = np.array([-1 if r is None else len(r) for r in raw], np.int64)
    return zstandard.compress(struct.pack("<q", len(held)) + keys.tobytes() + sizes.tobytes() + b"".join(r or b"" for r in raw), 6)


def unpack_texts(data: bytes) -> Iterator[tuple[int | None, bytes | None]]:
    raw = zstandard.decompress(data)
    n = struct.unpack_from("<q", raw)[0]
    keys, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    at = 8 + 16 * n
    for k, size in zip(keys.tolist(), sizes.tolist(), strict=True):
        yield (None if k == _NULL_KEY else k), (None if size < 0 else raw[at : at + size])
        at += max(0, size)


def make_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(run, size, known, data), written to the shared folder: the size of the texts, how many have a key, and both packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, n = (TaskContext.get().partitionId()) << 24, [], 0, 0

        def out():
            return pa.RecordBatch.from_pydict({"run": [first + n], "size": [size], "known": [sum(k is not None for k, _ in held)], "data": [pack_texts(held)]}, RUN)

        for k, t in rows(batches, "__key", "__text"):
            held.append((k, t))
            size += len(t or "") + ROW_BYTES
            if size >= run_bytes:
                yield out()
                held, size, n = [], 0, n + 1
        if held:
            yield out()

    return cut(with_key(docs, key, text).mapInArrow(run, "run long, size long, known long, data binary"))


def pack(*columns: np.ndarray) -> bytes:
    """Equally long arrays of numbers; the first is sorted and stored as differences, all in byte planes."""
    n = len(columns[0])
    out = [struct.pack("<qq", n, len(columns))]
    for i, c in enumerate(columns):
        c = np.diff(c.astype(np.uint64), prepend=np.uint64(0)) if i == 0 else c.astype(np.int64).view(np.uint64)
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(n, 8).T).tobytes())
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, k = struct.unpack_from("<qq", raw)
    out = []
    for i in range(k):
        c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 16 + 8 * n * i).reshape(8, n).T).view(np.uint64).reshape(n)
        out.append(np.cumsum(c, dtype=np.uint64) if i == 0 else c.view(np.int64))
    return out


class Plan(NamedTuple):
    """How positions are dealt: the number of destinations and of partitions, and the bits of a hash that are exchanged."""

    buckets: int
    parts: int
    bits: int
    #: Rows with a key.
    known: int


def plan(runs: DataFrame) -> Plan:
    """By the size of all texts: no destination grows with them, and few different positions share a hash by chance."""
    size, known = runs.agg(F.sum("size"), F.sum("known")).first()
    size = size or 0
    least = shuffle_parts(runs.sparkSession)
    buckets = max(SPREAD * least, -(-size // DESTINATION_BYTES))
    return Plan(buckets, max(least, -(-buckets // SPREAD)), min(62, max(24, size.bit_length()) + SPARE_BITS), known or 0)


def by_bucket(keys: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, slice]]:
    """Sorted keys of so many bits, cut into ranges of equal width."""
    edges = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    at = np.searchsorted(keys, edges, "left").tolist() + [len(keys)]
    for b in range(buckets):
        if at[b] < at[b + 1]:
            yield b, slice(at[b], at[b + 1])


def batches_of(found: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def each_run(runs: DataFrame, send: Callable[[int, bytes], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """`send(run, data)` gives (dest, kind, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of((x for r, d in rows(batches, "run", "data") for x in send(r, d)), SENT)

    return runs.mapInArrow(run, SENT_DDL)


def each_destination(sent: DataFrame, receive: Callable[[int, Iterator[tuple[int, bytes]]], Iterator[tuple]], schema: pa.Schema, ddl: str, parts: int) -> DataFrame:
    """Deal rows by destination; `receive(dest, ((kind, packed), ...))` gets them in the order of kind, the kinds one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = rows(batches, "dest", "kind", "data")
        return batches_of((x for dest, group in itertools.groupby(stream, lambda r: r[0]) for x in receive(dest, (r[1:] for r in group))), schema)

    return sent.repartition(parts, "dest").sortWithinPartitions("dest", "kind").mapInArrow(run, ddl)


def with_runs(runs: DataFrame, sent: DataFrame) -> DataFrame:
    """What is sent to runs (kind 0), then each run itself (kind 1), ready for `each_destination`."""
    return sent.unionByName(runs.select(F.col("run").alias("dest"), F.lit(1).cast("int").alias("kind"), "data"))


def ranges_to_mask(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie within `width` from one of the starts on."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0
