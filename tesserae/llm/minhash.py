"""Near duplicates by consistent weighted sampling of TF-IDF shingles, in bands, verified by weighted Jaccard similarity.

A shingle is five words in a row (all words of a shorter text).  Its weight is its count in the text times
1 + IDF_SHARE * ln((1 + N) / (1 + df)) / ln(1 + N): rarer shingles weigh more, by half at most, so that few rare words
don't part copies in a corpus with many of them.  df counts all documents; runs exchange it by hash.

1. A text of which shingles with df >= 2 hold less than 0.8 of the weight is similar to no other; the rest go on.
2. Texts with equal shingle counts are one class at once; its smallest key stands for it.
3. Improved consistent weighted sampling gives BANDS * ROWS samples; each weighted pair agrees in a sample with
   probability of its similarity, so a pair of 0.8 shares a band with probability 1 - (1 - 0.8**3)**14 > 0.9999.
4. Within each band's buckets, members are compared with the smallest one, by exact weighted Jaccard similarity from
   the shingles.  Links become classes, so that a group of n copies costs a small multiple of n comparisons.
5. Members of buckets that still hold several classes meet again by a prefix filter, which loses none: with shingles in
   one order for all texts, rarest first, two similar texts share a shingle before which neither has more than 1 - 0.8
   of its weight.  First, members outside a shingle's largest class meet one member of that class, which joins most
   of a large group's stragglers to it.  Then all members of classes that are still different, with such a shingle in
   common whose weight from there on allows 0.8, are compared.  Shingles of many members are dealt into cells of CELL
   by CELL members.
6. Links become classes by alternating stars.

The number of jobs is fixed but for the rounds of the stars.  What is lost: a pair of 0.8 or more that shares no band,
with probability (1 - s**3)**14 for a similarity s (below 0.0001 at 0.8), unless other links put it into one class.
Pairs inside one class are not all compared, so n_links counts the links found, not all there are.

Rows are told apart by their number (their run and place in it), not by key: each input row gives one row, and of each
class exactly one row is kept, that of the smallest key, of equal keys that of the smallest text hash, of equal rows any.
Null text or null key: a class of its own (null for a null key), kept.  Texts without a word are all equal: one class.
Very long texts are one vector in one row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import batched, bounded, cut, free_name, read, rows
from tesserae.llm.components import components
from tesserae.llm.runs import ROW_BYTES, RUN_BYTES, SENT, SENT_DDL, batches_of, by_bucket, each_destination, each_run, make_runs, pack, plan, unpack, unpack_texts, with_runs
from tesserae.llm.substring import RunWords

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 3
IDF_SHARE = 0.5
CELL = 256
#: Of Spark's xxhash64.
SEED = 42
#: Bits of a shingle's hash beyond those that a mere filter would need.
MORE_BITS = 12

#: Bits of a row's number that say its place in its run.
PLACE_BITS = 17
assert RUN_BYTES // ROW_BYTES <= 1 << PLACE_BITS

WHO = pa.schema([("node", pa.int64()), ("key", pa.int64()), ("row", pa.int64()), ("blank", pa.bool_())])
WHO_DDL = "node long, key long, row long, blank boolean"
VECTOR = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("vector", pa.binary()), ("prefix", pa.binary())])
VECTOR_DDL = "key long, digest binary, bands array<long>, vector binary, prefix binary"
ENTRY = pa.schema([("key", pa.int64()), ("component", pa.int64()), ("shingle", pa.int64()), ("before", pa.float64()), ("total", pa.float64())])
ENTRY_DDL = "key long, component long, shingle long, before double, total double"

_RNG = np.random.default_rng(14)
_R = _RNG.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_RNG.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_BETA = _RNG.random(1 << 16, np.float32)
_SEEDS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_U16, _U32 = np.uint64(0xFFFF), np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> _U32
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Shingles:
    """Of a run: for each document (by number) its different shingles, sorted, and their counts."""

    def __init__(self, data: bytes, bits: int):
        words = RunWords(data)
        self.keys = words.keys
        at, hashes = words.windows(SHINGLE, 5)
        docs = words.doc[at]
        short = [i for i, k in enumerate(words.keys) if k is not None and 0 < words.counts[i] < SHINGLE]
        if short:
            whole = [struct.unpack("<Q", hashlib.blake2b(b" ".join(words.words[i]), digest_size=8).digest())[0] for i in short]
            docs, hashes = np.concatenate([docs, short]), np.concatenate([hashes, np.array(whole, np.uint64)])
        hashes = hashes >> np.uint64(64 - bits)
        order = np.lexsort((hashes, docs))
        docs, hashes = docs[order], hashes[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        first = np.flatnonzero(new)
        self.docs, self.hashes = docs[first], hashes[first]
        self.counts = np.diff(np.append(first, len(docs)))


def _send_counts(buckets: int, bits: int):
    def send(run: int, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        found, n = np.unique(Shingles(data, bits).hashes, return_counts=True)
        for b, part in by_bucket(found, bits, buckets):
            yield b, 0, struct.pack("<q", run) + pack(found[part], n[part])

    return send


def _add_counts(dest: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """Each run hears the df of its shingles that more than one document has."""
    got = [(struct.unpack_from("<q", data)[0], *unpack(data[8:])) for _, data in sent]
    keys, n = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, n = keys[first], np.add.reduceat(n, first)
    keys, n = keys[n > 1], n[n > 1]
    for run, own, _ in got:
        if len(keys):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            same = keys[at] == own
            if same.any():
                yield run, 0, pack(own[same], n[at[same]])


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return 1.0 + IDF_SHARE * np.log((1.0 + n_docs) / (1.0 + df)) / np.log(1.0 + max(n_docs, 1))


def samples(hashes: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Improved consistent weighted sampling: one row of samples for each vector; vectors start at `first`.

    The variates of a shingle come from tables, by bits of its hash.  Per sample the least ln(a) wins and gives its
    shingle and t; both are packed so that one minimum finds them.
    """
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(first), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        z = _mixed(hashes ^ seed)
        r, beta = _R[(z & _U16).astype(np.int64)], _BETA[(z >> np.uint64(16) & _U16).astype(np.int64)]
        t = np.floor(log_w / r + beta)
        log_a = _LOG_C[(z >> _U32 & _U16).astype(np.int64)] - r * (t - beta) - r
        bits = log_a.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        what = _mixed(z + t.astype(np.int64).view(np.uint64)) >> _U32
        out[:, k] = np.minimum.reduceat(ordered << _U32 | what, first) & np.uint64(0xFFFFFFFF)
    return out


def band_hashes(found: np.ndarray) -> np.ndarray:
    out = np.zeros((len(found), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(found), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = _mixed(h ^ found[:, k] + _MIX)
        out[:, b] = h
    return out.view(np.int64)


def numbered(run: int, place: int) -> int:
    if run >> 63 - PLACE_BITS:
        raise OverflowError("too many runs to number their rows")
    return run << PLACE_BITS | place


def _who(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number, key, hash of its text (null for a null text) and whether it has no word (null for a null text)."""

    def found():
        for run, data in rows(batches, "run", "data"):
            for place, (k, raw) in enumerate(unpack_texts(data)):
                known = raw is not None
                yield numbered(run, place), k, struct.unpack("<q", xxhash.xxh64_digest(raw, SEED)[::-1])[0] if known else None, not raw.strip() if known else None

    return batched(found(), WHO, 50_000)


def _vectors(n_docs: int, bits: int):
    """A document that may have a partner: its number, digest, band hashes, the vector (its shared shingles, their weights, the whole weight), and its prefix."""

    def receive(run: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        told: list[list[np.ndarray]] = []
        for kind, data in sent:
            if kind == 0:
                told.append(unpack(data))
                continue
            if not told:
                continue
            own = Shingles(data, bits)
            keys, n = (np.concatenate(c) for c in zip(*told))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.minimum(np.searchsorted(keys, own.hashes), len(keys) - 1)
            df = np.where(keys[at] == own.hashes, n[at], 1)
            weight = own.counts * weights(df, n_docs)
            first = np.flatnonzero(np.concatenate([[True], own.docs[1:] != own.docs[:-1]]))
            total = np.add.reduceat(weight, first)
            shared = np.add.reduceat(np.where(df > 1, weight, 0.0), first)
            chosen = shared >= (THRESHOLD - 1e-9) * total
            if not chosen.any():
                continue
            size = np.diff(np.append(first, len(weight)))
            keep = np.repeat(chosen, size)
            hashes, weight, df = own.hashes[keep], weight[keep], df[keep]
            starts = np.concatenate([[0], np.cumsum(size[chosen])])
            found = band_hashes(samples(hashes, weight, starts[:-1]))
            for i, doc in enumerate(own.docs[first[chosen]].tolist()):
                part = slice(starts[i], starts[i + 1])
                digest = hashlib.blake2b(hashes[part].tobytes() + weight[part].tobytes(), digest_size=16).digest()
                both = df[part] > 1
                vector = struct.pack("<d", float(total[chosen][i])) + pack(hashes[part][both], weight[part][both].astype(np.float64).view(np.int64))
                yield numbered(run, doc), digest, found[i].tolist(), vector, prefix(hashes[part], weight[part], df[part])

    return receive


def prefix(hashes: np.ndarray, weight: np.ndarray, df: np.ndarray) -> bytes:
    """The whole weight, then the shared shingles, rarest first, that less than 1 - THRESHOLD of it stands before, and that weight before each."""
    order = np.lexsort((hashes, df))
    before, total = np.cumsum(weight[order]) - weight[order], float(weight.sum())
    chosen = (before <= (1 - THRESHOLD + 1e-9) * total) & (df[order] > 1)
    return struct.pack("<d", total) + hashes[order][chosen].astype(np.int64).tobytes() + before[chosen].astype(np.float64).tobytes()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for key, component, data in rows(batches, "key", "component", "prefix"):
            total, n = struct.unpack_from("<d", data)[0], (len(data) - 8) // 16
            for shingle, before in zip(np.frombuffer(data, np.int64, n, 8).tolist(), np.frombuffer(data, np.float64, n, 8 + 8 * n).tolist(), strict=True):
                yield key, component, shingle, before, total

    return batched(found(), ENTRY, 20_000)


def similarity(x: bytes, y: bytes) -> float:
    """Weighted Jaccard similarity of two packed vectors."""
    a, b = unpack(x[8:]), unpack(y[8:])
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inner = float(np.minimum(a[1][i].view(np.float64), b[1][j].view(np.float64)).sum()) if len(both) else 0.0
    return inner / (struct.unpack_from("<d", x)[0] + struct.unpack_from("<d", y)[0] - inner)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    return batches_of(((a, b, similarity(x, y)) for a, b, x, y in rows(batches, "a", "b", "x", "y")), schema)


def _compared(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b), written."""
    withx = pairs.join(vectors.select(F.col("key").alias("a"), F.col("vector").alias("x")), "a")
    withy = withx.join(vectors.select(F.col("key").alias("b"), F.col("vector").alias("y")), "b")
    return cut(withy.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long, similarity double"))


def _with_component(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    return keyed.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def _left_entries(bucket: DataFrame, classes: DataFrame, vectors: DataFrame) -> DataFrame:
    """The prefix entries, with their classes, of the members of buckets that still hold several classes; written."""
    member = cut(_with_component(bucket.select("key", "band", "hash"), classes))
    several = member.groupBy("band", "hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "hash")
    chosen = member.join(bounded(several), ["band", "hash"], "left_semi").select("key", "component").distinct()
    return cut(chosen.join(vectors.select("key", "prefix"), "key").mapInArrow(_entries, ENTRY_DDL))


def _met(entry: DataFrame) -> DataFrame:
    """The entries of shingles that several classes have, with the shingle's largest class (`main`) and the cells that it is dealt into; written."""
    size = entry.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    size = size.where("main.n < n").select("shingle", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / CELL).alias("na"), F.ceil(F.col("n") / CELL).alias("nb"))
    return cut(entry.join(bounded(size), "shingle"))


def _may() -> Column:
    """Whether two entries' weights from the shingle on allow THRESHOLD."""
    inner = F.least(F.col("total") - F.col("before"), F.col("total_y") - F.col("before_y"))
    return inner >= (THRESHOLD - 1e-9) * (F.col("total") + F.col("total_y") - inner)


def _main_pairs(met: DataFrame) -> DataFrame:
    """(a, b): each member outside a shingle's largest class, and one of that class: as many as there are entries."""
    least = met.where("component = main").groupBy("shingle").agg(F.min(F.struct("before", "key", "total")).alias("y"))
    pairs = met.where("component <> main").join(bounded(least), "shingle").select("key", "before", "total", F.col("y.key").alias("key_y"), F.col("y.before").alias("before_y"), F.col("y.total").alias("total_y"))
    return pairs.where(_may()).select(F.greatest("key", "key_y").alias("a"), F.least("key", "key_y").alias("b")).distinct()


def _left_pairs(met: DataFrame) -> DataFrame:
    """(a, b), a above b: all pairs of different classes that share an entry's shingle and may be similar; see step 5 above."""
    # members of a shingle's largest class need not meet one another: every other member meets all
    x = met.where("component <> main").select("shingle", "key", "component", "before", "total", F.pmod(F.xxhash64("key"), "na").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("j"))
    y = met.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)).alias("i"), F.pmod(F.xxhash64("key"), "nb").alias("j"), *[F.col(c).alias(f"{c}_y") for c in ("key", "component", "before", "total", "main")])
    once = (F.col("component_y") == F.col("main_y")) | (F.col("key") > F.col("key_y"))
    pairs = x.alias("x").join(y, ["shingle", "i", "j"]).where((F.col("component") != F.col("component_y")) & once & _may())
    return pairs.select(F.greatest("key", "key_y").alias("a"), F.least("key", "key_y").alias("b")).distinct()


def _links(vectors: DataFrame) -> DataFrame:
    """(a, b, similarity), a above b, of class representatives that are similar; see steps 4 and 5 above."""
    every = vectors.select("key", F.posexplode("bands").alias("band", "hash"))
    size = every.groupBy("band", "hash").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1")
    bucket = cut(every.join(bounded(size.drop("n")), ["band", "hash"]))
    similar = F.col("similarity") >= THRESHOLD
    found = _compared(bucket.where("key <> b").select(F.col("key").alias("a"), "b").distinct(), vectors)
    entry = _left_entries(bucket, components(found.where(similar)), vectors)
    if entry.isEmpty():
        return found.where(similar)
    found = cut(found.unionByName(_compared(_main_pairs(_met(entry)).join(found, ["a", "b"], "left_anti"), vectors)))
    entry = _with_component(entry.drop("component"), components(found.where(similar)))
    pairs = _left_pairs(_met(entry)).join(found, ["a", "b"], "left_anti")
    return found.unionByName(_compared(pairs, vectors)).where(similar)


def _classified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, class_id, n_links, kept) of each input row; `row` is the hash of its text by Spark's xxhash64.  Written."""
    runs = make_runs(docs, key, text)
    buckets, parts, bits, n_docs = plan(runs)
    bits = min(62, bits + MORE_BITS)
    counts = each_destination(each_run(runs, _send_counts(buckets, bits)), _add_counts, SENT, SENT_DDL, parts)
    vectors = cut(each_destination(with_runs(runs, counts), _vectors(n_docs, bits), VECTOR, VECTOR_DDL, parts))
    equal = vectors.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = vectors.select("key", "digest").join(bounded(equal), "digest", "left")
    member = cut(member.select("key", F.coalesce("least", "key").alias("least")))
    links = cut(_links(cut(vectors.join(member.where("key = least").select("key"), "key", "left_semi"))))
    group = components(links)
    n_links = links.select(F.explode(F.array("a", "b")).alias("least")).groupBy("least").agg(F.count("*").alias("n_links"))
    classes = member.join(group.withColumnRenamed("node", "least"), "least", "left").join(n_links, "least", "left")
    classes = classes.select(F.col("key").alias("node"), F.coalesce("component", "least").alias("group"), "n_links")
    # texts without a word are one group, of a number that no row has; rows without a vector are groups of one
    keyed = F.col("blank") & F.col("key").isNotNull()
    who = cut(runs.select("run", "data").mapInArrow(_who, WHO_DDL).join(classes, "node", "left").withColumn("group", F.when(keyed, F.lit(-1)).otherwise(F.coalesce("group", "node"))))
    first = who.groupBy("group").agg(F.min(F.struct("key", "row", "node")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = who.join(bounded(first), "group", "left")
    return cut(found.select("key", "row", F.coalesce("first.key", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("first.node") == F.col("node"), F.lit(True)).alias("kept")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, class_id (the smallest key of its class), n_links (links found to or from its text's representative), kept."""
    return _classified(docs, key, text).drop("row").withColumnRenamed("key", key)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are the first of their class, with all their columns; of rows of equal key and text at most one."""
    fates = cut(_classified(docs, key, text).groupBy("key", "row").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("n_kept")).where("n > n_kept"))
    own, row = free_name(docs, "__key"), free_name(docs, "__row")
    marked = docs.withColumn(own, F.col(key).cast("long")).withColumn(row, F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text).cast("string"))))
    fates = fates.select(F.col("key").alias("__fate_key"), F.col("row").alias("__fate_row"), (F.col("n_kept") > 0).alias("__once"))
    gone = F.col(own).eqNullSafe(F.col("__fate_key")) & F.col(row).eqNullSafe(F.col("__fate_row"))
    rest = marked.join(bounded(fates.drop("__once")), gone, "left_anti").drop(own, row)
    once = marked.join(bounded(fates.where("__once").drop("__once")), gone, "left_semi").dropDuplicates([own, row]).drop(own, row)
    return rest.unionByName(once)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
