"""Removal of repeated chunks of lines.

A text's lines (cut at \\n) are grouped into chunks whose borders depend on the lines around them only: a chunk ends
behind a line where a rolling hash over that line's and the line before's hashes falls to a residue, at the earliest
after two lines; where none does in MOST_LINES lines, behind that of the least hash.  Inserted or deleted lines shift
no border further on.  Only chunks of two or more lines that aren't blank count.

Chunks are counted by hash first, without their bytes; counts are combined before they are sent.  The bytes of chunks
whose hash occurs twice are then grouped whole.  Of equal chunks the first stays, by key and place.

A repeated passage seldom begins and ends at borders, so a chunk that goes takes the lines around it along: those that
directly precede or follow it and equal, one by one, the lines at the same distance from the first such chunk, as far
as the neighbouring chunks of both reach (further on, an equal chunk goes by itself).  These lines are compared by
128 bits of hash.  Every removed line equals one at an earlier key and place, so one of each stays.

Null text: no lines; the text stays null.  Null key: the row is returned as it is, and its lines count nowhere.  Rows
that share a key are told apart by their text; equal rows with equal keys have equal fates.  Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import batched, bounded, cut, free_name, read, rows, with_key

LEAST_LINES = 2
MOST_LINES = 64
DIVISOR = 4
#: Rows of a class of equal chunks that meet its first one in one task at most.
CLASS_ROWS = 10_000
#: Bytes of a line's hash in `before` and `after`.
LINE_BYTES = 16

_MASK = (1 << 64) - 1
CHUNK = pa.schema([("__key", pa.int64()), ("__row", pa.int64()), ("place", pa.int64()), ("hash", pa.int64()), ("bytes", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])
CHUNK_DDL = "__key long, __row long, place long, hash long, bytes binary, before binary, after binary"


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, behind the last line) of each chunk."""
    hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    rolling, before = [], 0
    for h in hashes:
        rolling.append((((((before * 0x9E3779B97F4A7C15) & _MASK) ^ h) * 0xD6E8FEB86659FD93) & _MASK) >> 32)
        before = h
    out, first, n = [], 0, len(lines)
    while first < n:
        end = first + LEAST_LINES
        last = min(n, first + MOST_LINES)
        while end < last and rolling[end - 1] % DIVISOR:
            end += 1
        if end >= first + MOST_LINES and rolling[end - 1] % DIVISOR:
            # no border in so many lines: behind the one of least hash, which doesn't depend on where the chunk began
            places = range(first + LEAST_LINES, first + MOST_LINES + 1)
            end = min(places, key=lambda i: rolling[i - 1])
        end = min(end, n)
        out.append((first, end))
        first = end
    return out


def _counts(lines: list[str]) -> bool:
    """A chunk of several lines, at least LEAST_LINES of them not blank."""
    return sum(not x.isspace() and x != "" for x in lines) >= LEAST_LINES


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def row_id(text: str) -> int:
    """Tells rows of one key apart."""
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=5))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for key, text in rows(batches, "__key", "__text"):
            if text is None or key is None or "\n" not in text:
                continue
            lines, own = text.split("\n"), row_id(text)
            marks = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
            found = chunks(lines)
            for i, (a, b) in enumerate(found):
                if _counts(lines[a:b]):
                    body = "\n".join(lines[a:b]).encode("utf-8", "surrogatepass")
                    before = b"".join(reversed(marks[found[i - 1][0] : a])) if i else b""
                    after = b"".join(marks[b : found[i + 1][1]]) if i + 1 < len(found) else b""
                    yield key, own, a, _signed(xxhash.xxh3_64_intdigest(body, seed=4)), body, before, after

    return batched(found(), CHUNK, 20_000)


def _alike(a: str, b: str) -> str:
    """SQL: how many lines two columns of line hashes have in common from their start on."""
    n = f"CAST(least(length({a}), length({b})) / {LINE_BYTES} AS INT)"
    same = f"transform(sequence(0, {n} - 1), i -> substring({a}, i * {LINE_BYTES} + 1, {LINE_BYTES}) = substring({b}, i * {LINE_BYTES} + 1, {LINE_BYTES}))"
    return f"CASE WHEN {n} = 0 THEN 0 ELSE coalesce(nullif(CAST(array_position({same}, false) AS INT), 0) - 1, {n}) END"


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(__key, __row, gone): the first line of each chunk to remove, and how many lines before and behind it go too.  `docs` has __key and __text."""
    hashed = cut(docs.mapInArrow(_hashed, CHUNK_DDL))
    twice = bounded(hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    bodies = hashed.join(twice, "hash").withColumn("parts", F.ceil(F.col("n") / CLASS_ROWS).cast("int")).withColumn("tag", F.xxhash64("bytes"))
    one = F.struct("__key", "__row", "place", "hash", "tag", "parts", "before", "after")
    first = cut(bodies.groupBy("bytes").agg(F.min(one).alias("first")).select("first.*"))
    # all but the first of equal chunks go; the first ones are told apart by place, so that no hot chunk is a join's key
    gone = bodies.drop("bytes").join(first.select("__key", "__row", "place"), ["__key", "__row", "place"], "left_anti")
    # each meets its first one for the lines around; large classes are dealt to several copies of it
    gone = gone.withColumn("part", F.pmod(F.xxhash64("__key", "__row", "place"), F.col("parts")).cast("int"))
    ahead = first.select("hash", "tag", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("before").alias("before_first"), F.col("after").alias("after_first"))
    sides = gone.join(ahead, ["hash", "tag", "part"]).select("__key", "__row", F.struct("place", F.expr(_alike("before", "before_first")).alias("before"), F.expr(_alike("after", "after_first")).alias("after")).alias("chunk"))
    return sides.groupBy("__key", "__row").agg(F.sort_array(F.collect_set("chunk")).alias("gone"))


def kept_text(text: str, gone: dict[int, tuple[int, int]]) -> tuple[str, int]:
    """The text without the chunks at the places in `gone` and so many lines before and behind each, and how many lines that are."""
    lines = text.split("\n")
    out = bytearray(len(lines))
    for a, b in chunks(lines):
        if a in gone:
            before, after = gone[a]
            out[a - before : b + after] = b"\1" * (before + b - a + after)
    return "\n".join(x for x, o in zip(lines, out, strict=True) if not o), sum(out)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """All rows and columns, the repeated chunks cut from the text; `removed` names a column for the number of lines cut."""
    names, told_name, key_name = docs.columns, free_name(docs, "__gone"), free_name(docs, "__key")
    gone = repeated_chunks(with_key(docs, key, text)).groupBy("__key").agg(F.collect_list(F.struct("__row", "gone")).alias(told_name)).withColumnRenamed("__key", key_name)
    joined = docs.withColumn(key_name, F.col(key).cast("long")).join(gone, key_name, "left").drop(key_name)
    schema = docs.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            told = batch.column(batch.schema.get_field_index(told_name))
            texts, counts = batch.column(at).to_pylist(), []
            for i, t in enumerate(texts):
                n, found = 0, told[i].as_py() if t is not None else None
                if found:
                    own = row_id(t)
                    places = {c["place"]: (c["before"], c["after"]) for x in found if x["__row"] == own for c in x["gone"]}
                    if places:
                        texts[i], n = kept_text(t, places)
                counts.append(n)
            columns = [batch.column(batch.schema.get_field_index(c)) if c != text else pa.array(texts, batch.schema.field(at).type) for c in schema]
            out = schema + ([removed] if removed else [])
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(counts, pa.int64())] if removed else []), names=out)

    result = docs.schema
    if removed:
        from pyspark.sql.types import LongType, StructType

        result = StructType([*docs.schema.fields]).add(removed, LongType())
    return joined.select(*names, told_name).mapInArrow(run, result)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, removed="n_removed_lines").select("doc_id", "n_removed_lines", F.length("text").cast("long").alias("n_kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))
