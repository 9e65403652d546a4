"""Vector codes by product quantisation, with a vector-approximation filter for the nearest codebook entries.

Vectors are cut into PARTS equal consecutive parts of integers.  Each part position has a codebook of at most ENTRIES
entries, refined in rounds: every part goes to its nearest entry, then each entry becomes the floored mean of its parts.

Nearest entries are found through a filter: each coordinate of an entry is quantised to one of CELLS cells between the
least and the greatest value of its dimension.  A part's lookup tables hold, for each dimension and cell, the least and
the greatest squared distance that a value in the cell can have; added along an entry's cells they bound its distance
from below and above.  Entries whose lower bound is above the least upper bound are out; only the rest are compared by
integer distances.  All bounds are integers too, so no entry that ties for the nearest is lost; ties go to the lower
index.

A round is one pass over the vectors.  Tasks return sums and counts by entry, which Spark adds; the codebooks, ENTRIES
rows of a vector's length, are all that passes through the driver.  Vectors are written once as integers.

Null vectors and vectors with null or non-finite components take no part; neither do those whose length can't be cut
into equal parts.  Vectors of different lengths have codebooks of their own.  A null id is an ordinary row, behind all
others where the first entries are chosen; of rows with one id, those of smaller components come first.  Other columns
are ignored.  Squared distances that 64 bits can't hold fail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_KEYS, cut, free_name, read

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CELLS = 16
#: Parts that are compared with a codebook at a time.
BATCH = 512

Codebooks = dict[int, list[np.ndarray]]


class Filter:
    """The entries of one codebook, with their cells."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        low, high = entries.min(axis=0), entries.max(axis=0)
        width = (high - low) // CELLS + 1
        self.cells = (entries - low) // width
        #: By dimension and cell, its least and greatest value.
        self.least = low[:, None] + width[:, None] * np.arange(CELLS)
        self.most = self.least + width[:, None] - 1

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part the index of its nearest entry and their squared distance; and how many distances were computed."""
        index, error, refined = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64), 0
        for first in range(0, len(parts), BATCH):
            own = parts[first : first + BATCH]
            low, high = np.zeros((len(own), len(self.entries)), np.int64), np.zeros((len(own), len(self.entries)), np.int64)
            for d in range(own.shape[1]):
                under, over = self.least[d] - own[:, d, None], own[:, d, None] - self.most[d]
                outside = np.maximum(np.maximum(under, over), 0)
                farthest = np.maximum(np.abs(under), np.abs(over))
                low += (outside * outside)[:, self.cells[:, d]]
                high += (farthest * farthest)[:, self.cells[:, d]]
            row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))
            distance = np.square(own[row] - self.entries[entry]).sum(axis=1)
            refined += len(row)
            starts = np.searchsorted(row, np.arange(len(own)))
            least = np.minimum.reduceat(distance, starts)
            hits = np.flatnonzero(distance == least[row])
            chosen = hits[np.searchsorted(row[hits], np.arange(len(own)))]  # entries of a row are in rising order
            index[first : first + BATCH], error[first : first + BATCH] = entry[chosen], least
        return index, error, refined


def _check(values: np.ndarray, entries: np.ndarray) -> None:
    span = max(int(np.abs(values).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if max(1, entries.shape[1]) * (4 * span + 2) ** 2 >= 1 << 63:
        raise OverflowError("squared distances need more than 64 bits")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values): the rows of a batch whose vectors have one length."""
    column = batch.column(batch.schema.get_field_index("values"))
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        yield places, flat[starts[places, None] + np.arange(n)].astype(np.int64)


def integers(vectors: DataFrame, key: str, vector: str, label: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(id, label, values): floor(scale * x) of each component, only of whole, finite vectors that can be cut; written."""
    values = F.col(vector).cast("array<double>")
    whole = values.isNotNull() & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(values) % parts == 0)
    return cut(vectors.where(whole).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("values")))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """By length: the parts of the vectors of smallest ids."""
    w = Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "values")
    chosen = vectors.select(F.size("values").alias("dim"), "id", "values").withColumn("place", F.row_number().over(w)).where(F.col("place") <= entries)
    found: dict[int, list[tuple]] = {}
    for dim, place, values in chosen.select("dim", "place", "values").collect():
        found.setdefault(dim, []).append((place, values))
    return {dim: np.split(np.array([v for _, v in sorted(held)], np.int64).reshape(len(held), dim), parts, axis=1) for dim, held in found.items()}


def _nearest(values: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: the parts, their nearest entries and squared distances."""
    for entries, part in zip(own, np.split(values, len(own), axis=1), strict=True):
        _check(part, entries)
        yield part, *Filter(entries).nearest(part)[:2]


def refined(vectors: DataFrame, codebooks: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts that are nearest to it; entries without parts stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums = {dim: [np.zeros(e.shape, np.int64) for e in own] for dim, own in books.items()}
        counts = {dim: [np.zeros(len(e), np.int64) for e in own] for dim, own in books.items()}
        for batch in batches:
            for _, values in _by_length(batch):
                dim = values.shape[1]
                for p, (part, index, _) in enumerate(_nearest(values, books[dim])):
                    np.add.at(sums[dim][p], index, part)
                    counts[dim][p] += np.bincount(index, minlength=len(counts[dim][p]))
        found = [(dim, p, int(e), [int(counts[dim][p][e]), *sums[dim][p][e].tolist()]) for dim, own in books.items() for p in range(len(own)) for e in np.flatnonzero(counts[dim][p])]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=["dim", "part", "entry", "sums"])

    told = vectors.select("values").mapInArrow(run, "dim int, part int, entry int, sums array<long>")
    total = told.select("dim", "part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("dim", "part", "entry", "at").agg(F.sum("x").alias("x"))
    added = {tuple(r[:4]): r[4] for r in total.collect()}
    out = {dim: [e.copy() for e in own] for dim, own in codebooks.items()}
    for (dim, p, e, at), x in added.items():
        if at:  # the first of the sums is the count
            out[dim][p][e, at - 1] = x // added[dim, p, e, 0]
    return out


def codebooks_digest(own: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for entries in own for x in entries.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks]:
    """(key, label, code as one byte a part, error), and the codebooks by length of the vectors."""
    spark = vectors.sparkSession
    whole = integers(vectors, key, vector, label, parts=parts)
    books = first_codebooks(whole, parts, entries)
    for _ in range(rounds):
        books = refined(whole, books)
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, dims = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for places, values in _by_length(batch):
                dims[places] = values.shape[1]
                for p, (_, index, error) in enumerate(_nearest(values, shared.value[values.shape[1]])):
                    codes[places, p] = index
                    errors[places] += error
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(errors), pa.array(dims)], names=["id", "label", "code", "error", "dim"])

    kind = whole.schema["label"].dataType.simpleString()
    found = whole.mapInArrow(run, f"id long, label {kind}, code binary, error long, dim int")
    return found.withColumnRenamed("id", key), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of errors over equal labels, nulls together.  Sums are by label; a label's rows don't meet."""
    total = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"))
    small = F.broadcast(total) if total.count() <= BROADCAST_KEYS else total
    return coded.join(small, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(read(spark, sf_dir, "embeddings"))
    digest = F.create_map(*[F.lit(x) for dim, own in books.items() for x in (dim, codebooks_digest(own))]) if books else F.lit(None).cast("map<int,string>")
    return with_label_error(cut(coded)).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest[F.col("dim")].alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds in SQL; distances by inner products of doubles, exact below 2**53."""
    dist = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)"
    out = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS v FROM v, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM v) USING (r) WHERE e < {ENTRIES}),"""
    for k in range(ROUNDS + 1):
        out += f"""
a{k} AS MATERIALIZED (SELECT p.r, p.p, min({{'d': {dist}, 'e': c.e}}) AS best FROM parts p JOIN c{k} c ON p.p = c.p GROUP BY ALL),"""
        if k < ROUNDS:
            out += f"""
m{k} AS (SELECT p, e, list(x ORDER BY i) AS v FROM (SELECT a.p, a.best.e AS e, i, floor(sum(x) / count(*)) AS x
  FROM (SELECT r, p, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM parts) s JOIN a{k} a USING (r, p) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e),"""
    return out + f"""
books AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}),
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), books
"""


ORACLE_SQL = _sql()
