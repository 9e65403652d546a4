"""Ranked lexical search by a threshold-seeded join of items and postings.

Items come in blocks of about BLOCK_CHARS of text, one after another; all documents meet each block.

1. Each document becomes its postings for the terms of the block, packed in tiles of bounded size, with its length n.
   N, L and the document frequencies are sums over all tiles.
2. A document's score is a sum of impacts, one for each term.  Of each term the K highest impacts of all documents are
   found, tile by tile and merged in a tree.  The kth of them is stored with the term: as many documents reach it by
   this term alone, so it is a lower bound of the kth score of every item with that term.  An item's threshold starts
   from its highest stored one.
3. Items and postings are joined term by term within a tile, an item's terms in falling order of the most that they give
   in the tile.  Where the sum of what the rest can give (the suffix bound) is below the threshold, no further term
   brings candidates.  Candidates whose sum so far and the suffix bound reach the threshold are rescored exactly; the
   K best of a task raise its threshold for the tiles that follow.
4. The lists of all tasks are merged in a tree.

Bounds drop only documents that K others beat, so results are exact.  No step holds more than a tile, a block of items
and K results of each; a term that every document holds is a posting list in each tile, never a group.

Null or empty texts have no terms; they count neither in N nor in L, and such items get no rows.  Repeated documents are
ranked each, repeated items get a list each.  A null doc_id comes last among equal scores.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, read, rows, shuffle_parts, with_key
from tesserae.llm.runs import batches_of
from tesserae.llm.topk import FAN_IN

K = 20
BLOCK_CHARS = 4 << 20
TILE_DOCS = 4096
TILE_POSTINGS = 1 << 20

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Stands for a null key, behind all others.
_LAST = (1 << 63) - 1

_TILE = pa.schema([("tile", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64()), *[(c, pa.binary()) for c in ("keys", "lengths", "starts", "doc", "tf", "term")]])
_TILE_DDL = "tile long, docs long, terms long, keys binary, lengths binary, starts binary, doc binary, tf binary, term binary"
_SCORE = pa.schema([("of", pa.int64()), ("tile", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_SCORE_DDL = "of long, tile long, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(text.translate(_LOWER)) if text else []


class Tile:
    """Postings by term: `doc` and `tf` from starts[i] to starts[i + 1] belong to term[i]; `keys` and `lengths` are the documents'."""

    def __init__(self, keys: bytes, lengths: bytes, starts: bytes, doc: bytes, tf: bytes, term: bytes):
        self.keys, self.lengths, self.starts, self.doc, self.tf, self.term = (np.frombuffer(x, np.int64) for x in (keys, lengths, starts, doc, tf, term))

    @staticmethod
    def columns(keys: list[int], lengths: list[int], terms: list[int], docs: list[int], tfs: list[int]) -> tuple[bytes, ...]:
        term, doc, tf = np.array(terms, np.int64), np.array(docs, np.int64), np.array(tfs, np.int64)
        order = np.argsort(term, kind="stable")
        present, first = np.unique(term[order], return_index=True)
        return tuple(np.asarray(x, np.int64).tobytes() for x in (keys, lengths, np.append(first, len(term)), doc[order], tf[order], present))

    def impacts(self, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        """What each posting adds to a score."""
        m = 75 + 25 * self.lengths * n_docs // n_terms
        return np.repeat(weight[self.term], np.diff(self.starts)) * (1_000_000_000 * self.tf // (1000 * self.tf + 12 * m[self.doc]))


def make_tiles(docs: DataFrame, vocabulary: dict[str, int], key: str, text: str) -> DataFrame:
    """Packed postings of all documents that have a term, written; documents without a term of the vocabulary count in `docs` and `terms` only."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, number = shared.value, TaskContext.get().partitionId() << 24, 0
        empty = lambda: (0, 0, [], [], [], [], [])
        n, total, keys, lengths, terms, at, tfs = empty()

        def found():
            nonlocal n, total, keys, lengths, terms, at, tfs, number
            for k, t in rows(batches, "__key", "__text"):
                every = terms_of(t)
                if not every:
                    continue
                n, total = n + 1, total + len(every)
                own = Counter(map(known.get, every))
                own.pop(None, None)
                if own:
                    terms += own.keys()
                    tfs += own.values()
                    at += [len(keys)] * len(own)
                    keys.append(_LAST if k is None else k)
                    lengths.append(len(every))
                if len(keys) >= TILE_DOCS or len(terms) >= TILE_POSTINGS:
                    yield first + number, n, total, *Tile.columns(keys, lengths, terms, at, tfs)
                    number += 1
                    n, total, keys, lengths, terms, at, tfs = empty()
            if n:
                yield first + number, n, total, *Tile.columns(keys, lengths, terms, at, tfs)

        return batches_of(found(), _TILE)

    return cut(with_key(docs, key, text).mapInArrow(run, _TILE_DDL))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tile]]:
    for tile, *columns in rows(batches, "tile", "keys", "lengths", "starts", "doc", "tf", "term"):
        yield tile, Tile(*columns)


def document_frequencies(tiles: DataFrame, n: int) -> np.ndarray:
    """Of each of n terms; as many numbers as the block's vocabulary has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for _, tile in _tiles(batches):
            total[tile.term] += np.diff(tile.starts)
        present = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(total[present])], names=["term", "df"])

    out = np.zeros(n, np.int64)
    for term, df in tiles.select("tile", "keys", "lengths", "starts", "doc", "tf", "term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _best(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by key."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= bound)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((keys[places], -scores[places]))[:k]]


def merged(lists: DataFrame, n_lists: int, k: int) -> DataFrame:
    """(of, rank, doc_id, score): the k best of each `of`, FAN_IN lists at a time.  Windows select before they shuffle."""
    width = FAN_IN
    while width < n_lists:
        width *= FAN_IN
    lists = lists.withColumn("slot", F.pmod(F.xxhash64("tile"), F.lit(width)))
    while width > 1:
        width //= FAN_IN
        lists = lists.withColumn("slot", F.floor(F.col("slot") / FAN_IN))
        w = Window.partitionBy("of", "slot").orderBy(F.desc("score"), "doc_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return lists.select("of", "rank", "doc_id", "score")


def kth_impacts(tiles: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int, n_lists: int, k: int) -> np.ndarray:
    """Of each term the kth highest impact over all documents, 0 where fewer hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for number, tile in _tiles(batches):
                impacts = tile.impacts(weight, n_docs, n_terms)
                for term, a, b in zip(tile.term.tolist(), tile.starts[:-1].tolist(), tile.starts[1:].tolist(), strict=True):
                    keys, own = tile.keys[tile.doc[a:b]], impacts[a:b]
                    for i in _best(keys, own, k).tolist():
                        yield term, number, int(keys[i]), int(own[i])

        return batches_of(found(), _SCORE)

    out = np.zeros(len(weight), np.int64)
    for row in merged(tiles.mapInArrow(run, _SCORE_DDL), n_lists, k).where(F.col("rank") == k).collect():
        out[row["of"]] = row["score"]
    return out


class Scorer:
    """The K best of each item over the tiles it has seen, and thresholds that only rise."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], seeds: np.ndarray, k: int):
        self.items, self.k = items, k
        #: A document below its item's threshold is not among the k best of all.
        self.thresholds = [max(1, int((counts * seeds[terms]).max(initial=0))) for terms, counts in items]
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        #: (item, document) pairs that were rescored.
        self.rescored = 0

    def see(self, tile: Tile, impacts: np.ndarray) -> None:
        if not len(tile.term):
            return
        most = np.maximum.reduceat(impacts, tile.starts[:-1])
        sums = np.zeros(len(tile.keys), np.int64)
        for number, (terms, counts) in enumerate(self.items):
            at = np.minimum(np.searchsorted(tile.term, terms), len(tile.term) - 1)
            here = tile.term[at] == terms
            at, times = at[here], counts[here]
            bound = times * most[at]
            order = np.argsort(-bound, kind="stable")
            at, times = at[order].tolist(), times[order].tolist()
            suffix = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from a place on can give together
            threshold = self.thresholds[number]
            leading = int(np.searchsorted(-suffix, -threshold, "right"))  # terms from which candidates come
            leading = min(leading, len(at))
            if not leading:
                continue
            touched = []
            for i, n in zip(at[:leading], times, strict=False):
                a, b = tile.starts[i], tile.starts[i + 1]
                sums[tile.doc[a:b]] += n * impacts[a:b]
                touched.append(tile.doc[a:b])
            docs = np.flatnonzero(sums >= max(1, threshold - int(suffix[leading])))
            self.rescored += len(docs)
            scores = sums[docs]
            for d in touched:
                sums[d] = 0
            for i, n in zip(at[leading:], times[leading:], strict=True):
                a, b = tile.starts[i], tile.starts[i + 1]
                own = tile.doc[a:b]
                j = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                scores = scores + np.where(own[j] == docs, n * impacts[a:b][j], 0)
            chosen = scores >= threshold
            if chosen.any():
                self._add(number, tile.keys[docs[chosen]], scores[chosen])

    def _add(self, number: int, keys: np.ndarray, scores: np.ndarray) -> None:
        keys, scores = (np.concatenate(c) for c in zip(self.best[number], (keys, scores), strict=True))
        places = _best(keys, scores, self.k)
        self.best[number] = keys[places], scores[places]
        if len(places) == self.k:
            self.thresholds[number] = max(self.thresholds[number], int(scores[places[-1]]))


def _search_block(docs: DataFrame, items: list[tuple], key: str, text: str, k: int) -> DataFrame:
    """(of, rank, doc_id, score) for items (number, text)."""
    spark = docs.sparkSession
    counted = [(number, Counter(terms_of(t))) for number, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in counted))))}
    tiles = make_tiles(docs, vocabulary, key, text)
    n_docs, n_terms, n_tiles = (x or 0 for x in tiles.agg(F.sum("docs"), F.sum("terms"), F.count("*")).first())
    df = document_frequencies(tiles, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    seeds = kth_impacts(tiles, weight, n_docs, max(1, n_terms), n_tiles, k)
    plan = []
    for _, own in counted:
        pairs = sorted((vocabulary[t], n) for t, n in own.items())
        plan.append((np.array([t for t, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int64)))
    shared = spark.sparkContext.broadcast((plan, weight, seeds))
    numbers = [number for number, _ in counted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, seeds = shared.value
        scorer, last = Scorer(items, seeds, k), -1
        for last, tile in _tiles(batches):  # noqa: B007
            scorer.see(tile, tile.impacts(weight, n_docs, max(1, n_terms)))
        found = ((numbers[i], last, int(d), int(s)) for i, (keys, scores) in enumerate(scorer.best) for d, s in zip(keys, scores, strict=True))
        yield from batches_of(found, _SCORE)

    return merged(tiles.mapInArrow(run, _SCORE_DDL), n_tiles, k)


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item key, rank, document key, score): the k highest-scoring documents of each item."""
    spark = docs.sparkSession
    numbered = cut(with_key(items, item_key, item_text).select(F.monotonically_increasing_id().alias("of"), "__key", "__text"))
    size = numbered.agg(F.sum(F.length("__text"))).first()[0] or 0
    n_blocks = 1 + 2 * (size // BLOCK_CHARS)
    found = spark.createDataFrame([], "of long, rank int, doc_id long, score long")
    for block in range(n_blocks):  # a stated query set, in blocks of bounded size
        some = numbered.where(F.pmod(F.xxhash64("of"), F.lit(n_blocks)) == block).select("of", "__text").collect()
        if some:
            found = found.unionByName(cut(_search_block(docs, [tuple(r) for r in some], key, text, k)))
    doc_key = F.when(F.col("doc_id") != _LAST, F.col("doc_id"))
    return numbered.join(found, "of").select(F.col("__key").alias(item_key), "rank", doc_key.alias(key), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT row_id, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
i AS (SELECT row_number() OVER () AS item_row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
items AS (SELECT item_row, item_id, term, count(*) AS times FROM i GROUP BY ALL),
words AS (SELECT row_id, doc_id, n, unnest(terms) AS term FROM docs),
postings AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY term),
impacts AS (SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS impact FROM postings JOIN weights USING (term), totals),
scores AS (SELECT item_row, item_id, row_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY ALL HAVING sum(times * impact) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
