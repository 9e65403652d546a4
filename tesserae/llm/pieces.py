"""SentencePiece encoding and decoding by a table of distinct chunks.

The library turns spaces into markers, puts one more before the text, and merges characters into pieces.  Where no piece
holds a marker behind another character, and none holds a line feed, no merge crosses the place before a marked word or
around a line feed, so each word with its markers is segmented by itself, whatever stands beside it.

1. Documents gather in blocks of about BLOCK_BYTES.  A block is its different chunks, the most frequent first, and each
   text as numbers of them (its positions).  A chunk is a marked word, with all markers in a row before it, or a line
   feed with the rest of a word behind it.
2. The chunks of all blocks meet in the chunk table, dealt by hash.  There each different one is segmented once, with
   many others in one call of the library, parted by line feeds.
3. The ids go back to the blocks, one message for each part of the table, and are joined to the positions where these
   lie, in buckets.  A block decodes the ids of each of its chunks once.

What is sent of a chunk is one entry for each block that holds it, however often it occurs there, so a frequent word
costs no more than a rare one.  Ids end with the end id; decoded texts are those of the library's decode(ids).

Null text: the empty text, so just the end id.  Null and repeated keys: each row is a document of its own.  Very long
texts: whole, in a block of their own.  Texts that hold the marker character itself decode to spaces, as in the library.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import read, rows, shared_dir, shuffle_parts, with_key
from tesserae.llm.runs import SENT, SENT_DDL, batches_of, each_destination, pack, unpack

MARK = "▁"
BLOCK_BYTES = 24 << 20
#: Bytes of chunks of all blocks that a part of the chunk table gets.
PART_BYTES = 16 << 20
#: Characters that are segmented by one call.
CALL_CHARS = 1 << 16

BLOCK = pa.schema([("run", pa.int64()), ("size", pa.int64()), ("words", pa.binary()), ("data", pa.binary())])
BLOCK_DDL = "run long, size long, words binary, data binary"

_CHUNK = re.compile(r" *[^ \n]+| +|\n[^ \n]*")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text that isn't empty.  One that begins with a line feed has no marker; any other has one more than the spaces it begins with."""
    marked = " " + text.replace(MARK, " ")
    if "  " in marked:
        return [c[1:] if c[0] == " " else c for c in _CHUNK.findall(marked)]
    found = marked.replace("\n", " \n").split(" ")
    del found[0]
    return found


class Pieces:
    """Segments chunks by a model file; fails at once if its pieces cross the places where texts are cut."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n, model = len(self.model), self.model
        self.end = model.eos_id()
        self.texts: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.texts.append(bytes([int(piece[1:-1], 16)]))
                continue
            if not model.is_control(i) and not model.is_unknown(i) and ("\n" in piece or MARK in piece.lstrip(MARK)):
                raise ValueError(f"piece {i} crosses chunks")
            self.texts.append(b"" if model.is_control(i) else piece.replace(MARK, " ").encode())
        before = model.encode("\n")
        odd = "a  éﬁＡ  b\r\t"
        if len(before) != 2 or model.decode(model.encode(odd)) != odd:
            raise ValueError("the model changes texts")
        self.line_feed = before[1]

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk."""
        found: list[np.ndarray] = []
        held, size = [], 0
        for c in [*chunks, None]:
            if held and (c is None or size >= CALL_CHARS):
                ids = np.array(self.model.encode("".join(held)), np.uint32)
                at = np.flatnonzero(ids == self.line_feed)
                found += [ids[a if h[1:2] != " " else a + 1 : b] for h, a, b in zip(held, at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
                held, size = [], 0
            if c is not None:
                held.append(c if c[:1] == "\n" else "\n " + c)
                size += len(held[-1])
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """What the ids of a whole chunk stand for, its first marker a space."""
        return b"".join(map(self.texts.__getitem__, ids.tolist()))


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


class _Numbers(dict):
    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


def _planes(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 6)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _join(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def _part(data: bytes, n: int) -> list[bytes]:
    sizes, at, out = struct.unpack_from(f"<{n}q", data), 8 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def _pack_words(words: list[bytes]) -> bytes:
    return _join(_planes(np.array([len(w) for w in words])), zstandard.compress(b"".join(words), 6))


def _unpack_words(data: bytes) -> list[bytes]:
    sizes, raw = _part(data, 2)
    ends = np.cumsum(_from_planes(sizes), dtype=np.int64).tolist()
    raw = zstandard.decompress(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def make_blocks(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(run, size of the chunks, words, data), in buckets: a block's number means the same rows in every later job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 24, 0
        keys: list = []
        found: list[np.ndarray] = []
        numbers, size = _Numbers(), 0

        def out():
            every = np.concatenate(found)
            words = list(numbers)
            order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            raw = [words[i].encode() for i in order.tolist()]
            own = np.array([0 if k is None else k for k in keys], np.int64).tobytes() + bytes(k is None for k in keys)
            data = _join(zstandard.compress(own, 6), _planes(np.array([len(x) for x in found])), _planes(rank[every]))
            return pa.RecordBatch.from_pydict({"run": [first + n], "size": [sum(map(len, raw))], "words": [_pack_words(raw)], "data": [data]}, BLOCK)

        for k, t in rows(batches, "__key", "__text"):
            keys.append(k)
            found.append(np.array(list(map(numbers.__getitem__, chunks_of(t))) if t else [], np.uint32))
            size += len(t or "") + 24
            if size >= block_bytes:
                yield out()
                keys, found, numbers, size, n = [], [], _Numbers(), 0, n + 1
        if keys:
            yield out()

    return bucketed(with_key(docs, key, text).mapInArrow(run, BLOCK_DDL), "run")


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Written to the shared folder in buckets by `key`, so that joins on it leave these rows where they lie.  Nothing stays in the catalogue."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_parts(spark), key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def _ask(parts: int):
    """To each part of the table: a block, the numbers of its chunks that are dealt there, and these chunks."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for block, data in rows(batches, "run", "words"):
            words = _unpack_words(data)
            if not words:
                continue
            dealt = np.array([zlib.crc32(w) for w in words], np.uint32) % np.uint32(parts)
            order = np.argsort(dealt, kind="stable")
            present, first = np.unique(dealt[order], return_index=True)
            for part, at in zip(present.tolist(), np.split(order, first[1:]), strict=True):
                yield part, 0, _join(struct.pack("<q", block), pack(at), _pack_words([words[i] for i in at.tolist()]))

    return lambda batches: batches_of(found(batches), SENT)


def _table(model: str):
    """A part of the chunk table: every new chunk is segmented once, and each block gets the ids of its chunks."""

    def receive(part: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        pieces, known = _pieces(model), {}
        for _, data in sent:
            block, numbers, words = _part(data, 3)
            words = _unpack_words(words)
            new = [w for w in words if w not in known]
            known.update(zip(new, pieces.segment([w.decode() for w in new]), strict=True))
            own = [known[w] for w in words]
            sizes = np.array([len(ids) for ids in own])
            yield struct.unpack("<q", block)[0], 0, _join(pack(unpack(numbers)[0], sizes), zstandard.compress(np.concatenate(own).tobytes(), 6))

    return receive


class Block:
    """A block whose chunks' ids are known: by chunk number the ids; the documents' keys and their chunks' numbers."""

    def __init__(self, data: bytes, told: list[bytes]):
        self.ids: dict[int, np.ndarray] = {}
        for answer in told:
            numbers, ids = _part(answer, 2)
            numbers, sizes = unpack(numbers)
            ids = np.frombuffer(zstandard.decompress(ids), np.uint32)
            self.ids.update(zip(numbers.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
        keys, counts, every = _part(data, 3)
        counts, every = _from_planes(counts), _from_planes(every)
        raw = zstandard.decompress(keys)
        self.keys = [None if gone else k for k, gone in zip(np.frombuffer(raw, np.int64, len(counts)).tolist(), raw[8 * len(counts) :], strict=True)]
        self.positions = np.split(every, np.cumsum(counts, dtype=np.int64)[:-1])


def _each(docs: DataFrame, model: str, key: str, text: str, make: Callable[[Block, Pieces], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    blocks = make_blocks(docs, key, text)
    parts = max(shuffle_parts(blocks.sparkSession), -(-(blocks.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    told = each_destination(blocks.select("run", "words").mapInArrow(_ask(parts), SENT_DDL), _table(model), SENT, SENT_DDL, parts)
    told = told.groupBy(F.col("dest").alias("run")).agg(F.collect_list("data").alias("told"))  # one for each part of the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of((x for data, answers in rows(batches, "data", "told") for x in make(Block(data, answers or []), _pieces(model))), schema)

    return blocks.select("run", "data").join(told.hint("merge"), "run", "left").select("data", "told").mapInArrow(run, ddl)


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids (the end id last), and the text they decode to."""

    def make(block: Block, pieces: Pieces) -> Iterator[tuple]:
        decoded = {n: pieces.decode(ids) for n, ids in block.ids.items()}
        for k, own in zip(block.keys, block.positions, strict=True):
            numbers = own.tolist()
            ids = np.concatenate([*map(block.ids.__getitem__, numbers), [pieces.end]]).astype(np.int32)
            yield k, ids.tolist(), b"".join(map(decoded.__getitem__, numbers))[1:].decode()

    schema = pa.schema([("__key", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return _each(docs, model, key, text, make, schema, "__key long, ids array<int>, decoded string").withColumnRenamed("__key", key)


def digest_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, and digests of the decimal ids joined by spaces and of the text they decode to."""

    def make(block: Block, pieces: Pieces) -> Iterator[tuple]:
        decimal = [str(i) for i in range(len(pieces.texts))]
        n_ids, written, decoded = np.zeros(len(block.ids), np.int64), {}, {}
        for n, ids in block.ids.items():
            found = ids.tolist()
            n_ids[n], written[n], decoded[n] = len(found), " ".join(map(decimal.__getitem__, found)), b"".join(map(pieces.texts.__getitem__, found))
        for k, own in zip(block.keys, block.positions, strict=True):
            numbers = own.tolist()
            ids = " ".join([*map(written.__getitem__, numbers), decimal[pieces.end]])
            back = b"".join(map(decoded.__getitem__, numbers))[1:]
            yield k, int(n_ids[own].sum()) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    schema = pa.schema([("__key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _each(docs, model, key, text, make, schema, "__key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("__key", key)


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
