"""Exact top-k search by inner product: tiles of query blocks and shards, partial selection in each, lists merged in a tree.

Vectors become packed tiles of a bounded number of rows; a shard tile meets every query block (a stated query set in
blocks of bounded size).  A tile's product is a matrix product for some of the queries at a time; of each query only
the k best of a tile leave it.  Lists are merged FAN_IN tiles at a time, then FAN_IN of those results, and so on, by
windows that select before they shuffle.  No step holds more than two tiles or FAN_IN lists of a query.

Integers are exact: products go through doubles while sums stay under 2**53, and through 64-bit integers beyond; a sum
that even these can't hold fails.  Ties go to the smaller id.  A vector that is null, or that holds null or non-finite
components, takes no part, neither does a null id.  Of rows that share an id, each is a candidate of the others' queries
but none of its own id's.  Vectors are compared with those of equal length only.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, read, rows, shuffle_parts
from tesserae.llm.runs import batches_of

TILE_ROWS = 4096
#: Tiles whose lists are merged at a time.
FAN_IN = 16

_TILE = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])
_TILE_DDL = "dim int, tile long, n int, ids binary, values binary"
_LIST = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("tile", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LIST_DDL = "query_id long, query_row long, tile long, vec_id long, score long"


def scaled(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, values): floor(scale * x) of each component; only of whole, finite vectors."""
    values = F.col(vector).cast("array<double>")
    whole = F.col(key).isNotNull() & values.isNotNull() & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(whole).select(F.col(key).cast("long").alias("id"), F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("values"))


def tiles(vectors: DataFrame) -> DataFrame:
    """Packed tiles of vectors of one length."""

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            from pyspark import TaskContext

            first, n, held = TaskContext.get().partitionId() << 24, 0, {}
            for i, values in rows(batches, "id", "values"):
                own = held.setdefault(len(values), ([], []))
                own[0].append(i)
                own[1].append(np.array(values, np.int64))
                if len(own[0]) == TILE_ROWS:
                    yield len(values), first + n, TILE_ROWS, np.array(own[0], np.int64).tobytes(), np.concatenate(own[1]).tobytes()
                    n += 1
                    del held[len(values)]
            for dim, (ids, data) in held.items():
                yield dim, first + n, len(ids), np.array(ids, np.int64).tobytes(), np.concatenate(data).tobytes()
                n += 1

        return batches_of(found(), _TILE)

    return vectors.mapInArrow(pack_partition, _TILE_DDL)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    largest = max(1, q.shape[1]) * max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(c).max(initial=0)))
    if largest < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 63:
        return q @ c.T
    raise OverflowError("scores need more than 64 bits")


def best_of_tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of a tile, in any order: query index, id, score.  Candidates are in the order of their ids, so that equal scores are taken in it."""
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    chosen_q, chosen_c, chosen_s = [], [], []
    for first in range(0, len(q), 256):
        part = _product(q[first : first + 256], c)
        own = ids[None, :] == query_ids[first : first + 256, None]
        part = np.where(own, np.iinfo(np.int64).min, part)
        if part.shape[1] > k:
            bound = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k, None]
            above, equal = part > bound, part == bound
            need = k - above.sum(axis=1, keepdims=True)
            take = above | equal & (np.cumsum(equal, axis=1) <= need)
        else:
            take = np.ones(part.shape, bool)
        r, col = np.nonzero(take & ~own)
        chosen_q.append(r + first)
        chosen_c.append(col)
        chosen_s.append(part[r, col])
    return np.concatenate(chosen_q), ids[np.concatenate(chosen_c)], np.concatenate(chosen_s)


def _met(shards: DataFrame, blocks: DataFrame, size: int, parts: int) -> DataFrame:
    """Each shard tile beside each query block of its length.

    Blocks that are small together are broadcast, and shard tiles stay where they are.  Else both are dealt on a grid:
    blocks into groups of about BROADCAST_BYTES, shard tiles into slices; a shard tile is sent once for each group, a
    block once for each slice, and no cell holds more than its share of either.
    """
    if size <= BROADCAST_BYTES:
        return shards.join(F.broadcast(blocks), "dim")
    groups = -(-size // BROADCAST_BYTES)
    slices = max(1, parts // groups)
    own = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group")
    dealt = blocks.select("*", own, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    sent = shards.select("*", F.pmod(F.xxhash64("tile"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    return sent.join(dealt, ["dim", "group", "slice"]).drop("group", "slice")


def _merged(lists: DataFrame, n_tiles: int, k: int) -> DataFrame:
    """The k best of each query: lists of FAN_IN tiles are merged, then FAN_IN of those, until one is left.  Windows select before they shuffle."""
    width = FAN_IN
    while width < n_tiles:
        width *= FAN_IN
    lists = lists.withColumn("slot", F.pmod(F.xxhash64("tile"), F.lit(width)))
    while width > 1:
        width //= FAN_IN
        lists = lists.withColumn("slot", F.floor(F.col("slot") / FAN_IN))
        w = Window.partitionBy("query_id", "query_row", "slot").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `queries` against all rows of `vectors`, which has the same columns."""
    parts = shuffle_parts(vectors.sparkSession)
    blocks = cut(tiles(scaled(queries, key, vector, scale).coalesce(max(1, parts // 4))))
    size = blocks.agg(F.sum(F.length("ids") + F.length("values"))).first()[0] or 0
    blocks = blocks.select("dim", F.col("tile").alias("block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    shards = tiles(scaled(vectors, key, vector, scale))
    met = _met(shards, blocks, size, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, tile, n, ids, values, block, q_n, q_ids, q_values in rows(batches, "dim", "tile", "n", "ids", "values", "block", "q_n", "q_ids", "q_values"):
            query_ids = np.frombuffer(q_ids, np.int64)
            r, found, score = best_of_tile(query_ids, np.frombuffer(q_values, np.int64).reshape(q_n, dim), np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64).reshape(n, dim), k)
            for first in range(0, len(r), 50_000):
                s = slice(first, first + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_ids[r[s]], block * TILE_ROWS + r[s], np.full(len(r[s]), tile), found[s], score[s])], schema=_LIST)

    return _merged(met.mapInArrow(run, _LIST_DDL), vectors.count() // TILE_ROWS + parts, k)


#: Query blocks are broadcast while they are at most so large together.
BROADCAST_BYTES = 32 << 20


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
