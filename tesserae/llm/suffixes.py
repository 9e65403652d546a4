"""Removal of byte strings that also start in an earlier document, by a distributed merge sort of suffixes.

Two equal strings of 50 bytes choose the same one of their 27 substrings of 24 bytes, the one of smallest hash; it is
an anchor, about 7 places in 100 are.  So only suffixes that start at anchors need sorting, and of these only the ones
whose anchor occurs in more than one document:

1. Runs exchange the hashes of their anchors and learn which are shared.
2. Each run sorts the suffixes at shared anchors and sends them front-coded: for each, how many bytes it has in
   common with the one before, and the rest.  A destination merges the runs by a loser tree, whose nodes hold the
   length of the prefix in common with the last suffix put out, so that no byte known to be equal is compared again.
   Suffixes that agree on the anchor are then neighbours; their 50-byte strings, up to 26 bytes further left, are
   compared, and each run hears which of its strings an earlier document has.
3. All bytes of those strings are removed.

Within a run, only the earliest document's suffixes are sent for each different surrounding of an anchor: the later
ones' strings are all in it.  A hot passage thus costs an entry a run.

Null text: empty (digest of the empty string).  Null key: the row is returned as it is, and is no source.  Rows with
equal keys don't remove each other's bytes.  Texts under 50 bytes lose nothing.  Texts of any length are hashed slice
by slice.  Removal may cut a character; the digest is that of the remaining bytes.  Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import read
from tesserae.llm.runs import SENT, SENT_DDL, by_bucket, each_destination, each_run, make_runs, pack, plan, ranges_to_mask, unpack, unpack_texts, with_runs

LENGTH = 50
GRAM = 24
LEFT = LENGTH - GRAM  # bytes left of an anchor that a string may reach
WIDTH = LEFT + LENGTH  # an anchor's surroundings: LEFT bytes before it, LENGTH from it on
SLICE = 1 << 18

KEPT = pa.schema([("__key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("kept", pa.binary())])
KEPT_DDL = "__key long, n_bytes long, n_removed long, starts array<long>, lengths array<long>, kept binary"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(50).integers(1, 1 << 62, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _hashes(x: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of this length along the last axis, by doubling."""
    whole, covered = None, 0
    power, size = (x.astype(np.uint64) + np.uint64(1)) * _STEPS[0], 1
    for step in range(1, length.bit_length() + 1):
        if length & size:
            n = x.shape[-1] - covered - size + 1
            if n <= 0:
                return np.zeros((*x.shape[:-1], 0), np.uint64)
            whole = power[..., :n].copy() if whole is None else _mixed(whole[..., :n] * _STEPS[step + 20] + power[..., covered : covered + n])
            covered += size
        if covered == length:
            break
        power = _mixed(power[..., : power.shape[-1] - size] * _STEPS[step] + power[..., size:])
        size *= 2
    return whole


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the anchors of one text start, and their hashes.  Slices overlap so that each string is seen whole."""
    n = len(text) - LENGTH + 1
    places, found = [], []
    for first in range(0, max(n, 0), SLICE):
        part = text[first : first + SLICE + LENGTH - 1]
        grams = _hashes(part, GRAM)
        least = _sliding(grams, LEFT + 1, np.minimum)  # by string
        padded = np.concatenate([np.zeros(LEFT, np.uint64), least, np.zeros(LEFT, np.uint64)])
        at = np.flatnonzero(_sliding(padded, LEFT + 1, np.maximum) == grams)
        places.append(at + first)
        found.append(_mixed(grams[at]))  # the least of many crowd the low end; mixed, they are dealt evenly
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, keys = np.concatenate(places), np.concatenate(found)
    if len(places) > 1:
        at, once = np.unique(at, return_index=True)
        keys = keys[once]
    return at, keys


class _Bytes:
    """The texts of a run, one after another."""

    def __init__(self, data: bytes):
        texts = list(unpack_texts(data))
        self.keys = [k for k, _ in texts]
        self.first = np.concatenate([[0], np.cumsum([len(t or b"") for _, t in texts])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(t or b"" for _, t in texts), np.uint8)
        self.key = np.array([0 if k is None else k for k in self.keys], np.int64)

    def text(self, i: int) -> np.ndarray:
        return self.raw[self.first[i] : self.first[i + 1]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All anchors of keyed documents: document, place in the run, hash.  Short texts are hashed together; what crosses a border is dropped."""
        docs, places, hashes = [], [], []
        known = [i for i, k in enumerate(self.keys) if k is not None and self.first[i + 1] - self.first[i] >= LENGTH]
        for i in known:
            at, keys = anchors(self.text(i))
            docs.append(np.full(len(at), i, np.int64))
            places.append(at + self.first[i])
            hashes.append(keys)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *docs]), np.concatenate([none, *places]), np.concatenate([none.astype(np.uint64), *hashes])


def _send_anchors(buckets: int, bits: int):
    def send(run: int, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        texts = _Bytes(data)
        docs, _, hashes = texts.anchors()
        if not len(docs):
            return
        hashes = hashes >> np.uint64(64 - bits)
        order = np.argsort(hashes, kind="stable")
        hashes, docs = hashes[order], texts.key[docs[order]]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        many = np.zeros(len(hashes), bool)
        many[1:] = ~new[1:] & (docs[1:] != docs[:-1])
        shared = np.zeros(int(new.sum()), bool)
        shared[(np.cumsum(new) - 1)[many]] = True
        hashes = hashes[new]
        for kind, keys in ((0, hashes[~shared]), (1, hashes[shared])):
            for b, part in by_bucket(keys, bits, buckets):
                yield b, kind, struct.pack("<q", run) + pack(keys[part])

    return send


def _match_anchors(dest: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    got = [(kind, struct.unpack_from("<q", data)[0], unpack(data[8:])[0]) for kind, data in sent]
    keys = np.sort(np.concatenate([x for _, _, x in got]))
    found = np.unique(np.concatenate([keys[1:][keys[1:] == keys[:-1]], *(x for kind, _, x in got if kind)]))
    for _, run, keys in got:
        if len(found):
            keys = keys[found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys]
            if len(keys):
                yield run, 0, pack(keys)


def _surroundings(texts: _Bytes, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """WIDTH bytes around each anchor, zero outside its document, and how many of the left and right ones are inside."""
    left = np.minimum(at - texts.first[docs], LEFT)
    right = np.minimum(texts.first[docs + 1] - at, LENGTH)
    offsets = np.arange(-LEFT, LENGTH)
    inside = (offsets >= -left[:, None]) & (offsets < right[:, None])
    return np.where(inside, texts.raw[np.clip(at[:, None] + offsets, 0, len(texts.raw) - 1)], 0).astype(np.uint8), left, right


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian numbers, eight bytes each: their order is that of the bytes."""
    pad = -rows.shape[1] % 8
    rows = np.pad(rows, ((0, 0), (0, pad))) if pad else np.ascontiguousarray(rows)
    return list(rows.view(">u8").astype(np.uint64).T)


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted rows: the length of the prefix in common with the row before, and all other bytes."""
    same = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        same[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return same, rows[np.arange(rows.shape[1]) >= same[:, None]].tobytes()


def front_decode(same: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, last, at = [], b"", 0
    for n in same.tolist():
        last = last[:n] + rest[at : at + width - n]
        at += width - n
        out.append(last)
    return out


def merge_runs(runs: list[list[list[int]]], common: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs by a loser tree.  An item is a list of big-endian words of eight bytes, all equally long;
    common[r][i]: how many bytes item i of run r shares with the one before it.

    Returns which run each item comes from, in order, and the prefix it shares with the item before.  Each node keeps a
    losing run and the prefix its head shares with the item that won there, the last one put out; heads with a longer
    such prefix come first without a comparison, and equal ones are compared from that word on only.  Items equal to
    the last one put out follow it at once, without a way through the tree.
    """
    whole = 8 * next(len(r[0]) for r in runs if r)
    n = 1
    while n < len(runs):
        n *= 2
    heads: list[list[int] | None] = [r[0] if r else None for r in runs] + [None] * (n - len(runs))
    places = [0] * n
    loser, shared = [0] * n, [0] * n

    def beats(a: int, b: int) -> tuple[bool, int]:
        """Whether the head of a comes before that of b, and how many bytes they share."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None, -1
        for w, (p, q) in enumerate(zip(x, y, strict=True)):
            if p != q:
                return p < q, 8 * w + 8 - (((p ^ q).bit_length() + 7) >> 3)
        return a < b, whole

    level, at = list(range(n)), n
    while len(level) > 1:
        at //= 2
        up = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            first, k = beats(a, b)
            loser[at + i // 2], shared[at + i // 2] = (b, k) if first else (a, k)
            up.append(a if first else b)
        level = up
    best = level[0]
    source: list[int] = []
    prefix: list[int] = []
    h = 0
    while heads[best] is not None:
        run, own, i = runs[best], common[best], places[best]
        source.append(best)
        prefix.append(h)
        i += 1
        last = len(run)
        while i < last and own[i] >= whole:
            source.append(best)
            prefix.append(whole)
            i += 1
        places[best] = i
        start = best
        if i < last:
            heads[best] = run[i]
            h = own[i]
        else:
            heads[best] = None
            h = -1
        node = (start + n) >> 1
        while node:
            k = shared[node]
            if k > h:
                best, loser[node] = loser[node], best
                h, shared[node] = k, h
            elif k == h and k >= 0:
                if h < whole:
                    other = loser[node]
                    x, y = heads[best], heads[other]
                    w = k >> 3
                    p, q = x[w], y[w]
                    while p == q:
                        w += 1
                        if w == len(x):
                            break
                        p, q = x[w], y[w]
                    if p == q:
                        shared[node] = whole
                    else:
                        shared[node] = 8 * w + 8 - (((p ^ q).bit_length() + 7) >> 3)
                        if p > q:
                            loser[node] = best
                            best = other
            node >>= 1
    return source, prefix


def _send_suffixes(buckets: int, bits: int):
    def receive(run: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        found: list[np.ndarray] = []
        for kind, data in sent:
            if kind == 0:
                found.append(unpack(data)[0])
                continue
            if not found:
                continue
            texts = _Bytes(data)
            docs, at, hashes = texts.anchors()
            chosen = np.isin(hashes >> np.uint64(64 - bits), np.concatenate(found))
            docs, at, hashes = docs[chosen], at[chosen], hashes[chosen]
            around, left, right = _surroundings(texts, docs, at)
            keys = texts.key[docs]
            bucket = ((hashes >> np.uint64(34)) * np.uint64(buckets) >> np.uint64(30)).astype(np.int64)
            before = _words(around[:, :LEFT])
            suffix = _words(around[:, LEFT:])
            order = np.lexsort((keys, right, left, *before[::-1], *suffix[::-1], bucket))
            docs, at, around, left, right, keys, bucket = (x[order] for x in (docs, at, around, left, right, keys, bucket))
            new = np.ones(len(order), bool)
            new[1:] = (around[1:] != around[:-1]).any(axis=1) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            least = keys[new][np.cumsum(new) - 1]
            first = keys == least
            # the later documents' strings around the same bytes are all in the first one
            later = ~first
            if later.any():
                starts = np.unique(np.concatenate([(at[later] - j)[(left[later] >= j) & (right[later] >= LENGTH - j)] for j in range(LEFT + 1)]))
                if len(starts):
                    yield run % buckets, 1, struct.pack("<q", run) + pack(starts)
            docs, at, around, left, right, keys, bucket = (x[first] for x in (docs, at, around, left, right, keys, bucket))
            edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    part = slice(edges[b], edges[b + 1])
                    same, rest = front_code(around[part, LEFT:])
                    head = pack(np.arange(edges[b + 1] - edges[b]), same, left[part], right[part], keys[part], at[part])
                    tail = zstandard.compress(rest + np.ascontiguousarray(around[part, :LEFT].T).tobytes(), 1)
                    yield b, 0, struct.pack("<qqq", run, len(head), len(rest)) + head + tail

    return receive


def _merge_suffixes(dest: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    runs, suffixes, common, columns, lefts, bodies = [], [], [], [], [], []
    for kind, data in sent:
        run = struct.unpack_from("<q", data)[0]
        if kind == 1:
            yield run, 0, data[8:]
            continue
        n_head, n_rest = struct.unpack_from("<qq", data, 8)
        _, same, left, right, keys, at = unpack(data[24 : 24 + n_head])
        raw = zstandard.decompress(data[24 + n_head :])
        runs.append(run)
        own = np.frombuffer(b"".join(front_decode(same, raw[:n_rest], LENGTH)), np.uint8).reshape(len(same), LENGTH)
        bodies.append(own)
        suffixes.append(np.stack(_words(own), axis=1).tolist())
        common.append(np.where(same >= LENGTH, 8 * len(suffixes[-1][0]), same).tolist())
        columns.append((left, right, keys, at))
        lefts.append(np.frombuffer(raw, np.uint8, len(same) * LEFT, n_rest).reshape(LEFT, len(same)).T)
    if not runs:
        return
    source, prefix = (np.array(x, np.int64) for x in merge_runs(suffixes, common))
    # neighbours that agree on the anchor are a group; groups of a single entry have no partner
    ranks = np.argsort(source, kind="stable")  # entry i of all runs' entries, one run after another, is item ranks[i] of the merge
    group, suffix = np.cumsum(prefix < GRAM)[ranks], np.cumsum(prefix < LENGTH)[ranks]
    kept = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(kept):
        return
    left, right, keys, at = (np.concatenate([c[i] for c in columns]) for i in range(4))
    origin = np.repeat(np.arange(len(runs)), [len(c[0]) for c in columns])
    suffixes.clear()
    bodies, before = np.concatenate(bodies), np.concatenate(lefts)
    # of entries with equal surroundings only the earliest document's are compared; all strings of the later ones are in it
    sorts = [keys[kept], right[kept], left[kept], *_words(before[kept])[::-1], suffix[kept]]
    by = np.lexsort(sorts)
    kept, new = kept[by], np.ones(len(kept), bool)
    new[1:] = np.logical_or.reduce([x[by][1:] != x[by][:-1] for x in sorts[1:]])
    earliest = keys[kept] == keys[kept][new][np.cumsum(new) - 1]
    late, order = kept[~earliest], kept[earliest]
    entries, starts = [], []
    for j in range(LEFT + 1):
        whole = late[(left[late] >= j) & (right[late] >= LENGTH - j)]
        entries.append(origin[whole])
        starts.append(at[whole] - j)
    order = order[np.bincount(group[order])[group[order]] > 1]
    edges = np.flatnonzero(np.diff(group[order])) + 1
    for part in _blocks(order, edges, 20_000):
        around = np.concatenate([before[part], bodies[part]], axis=1)
        strings = _hashes(around, LENGTH)  # one for each number of bytes left of the anchor, LEFT first
        reach = np.arange(LEFT, -1, -1)
        row, column = np.nonzero((left[part][:, None] >= reach) & (right[part][:, None] >= LENGTH - reach))
        key, doc = strings[row, column], keys[part][row]
        by = np.lexsort((doc, key))
        row, column, key, doc = row[by], column[by], key[by], doc[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero(doc > doc[head])
        strings = np.lib.stride_tricks.sliding_window_view(around, LENGTH, axis=1)
        for some in np.array_split(later, max(1, len(later) >> 16)):
            equal = (strings[row[some], column[some]] == strings[row[head[some]], column[head[some]]]).all(axis=1)
            entry = part[row[some[equal]]]
            entries.append(origin[entry])
            starts.append(at[entry] - LEFT + column[some[equal]])
    whose, starts = np.concatenate(entries), np.concatenate(starts)
    order = np.lexsort((starts, whose))
    whose, starts = whose[order], starts[order]
    new = np.ones(len(order), bool)
    new[1:] = (whose[1:] != whose[:-1]) | (starts[1:] != starts[:-1])
    whose, starts = whose[new], starts[new]
    edges = np.searchsorted(whose, np.arange(len(runs) + 1)).tolist()
    for i, run in enumerate(runs):
        if edges[i] < edges[i + 1]:
            yield run, 0, pack(starts[edges[i] : edges[i + 1]])


def _blocks(order: np.ndarray, edges: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Whole groups, about `size` entries at a time."""
    at, last = 0, len(order)
    while at < last:
        k = int(np.searchsorted(edges, at + size))
        end = int(edges[k]) if k < len(edges) else last
        yield order[at:end]
        at = end


def _remove(run: int, sent: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    told: list[np.ndarray] = []
    for kind, data in sent:
        if kind == 0:
            told.append(unpack(data)[0].astype(np.int64))
            continue
        texts = _Bytes(data)
        gone = ranges_to_mask(np.concatenate(told), LENGTH, len(texts.raw)) if told else None
        for i, key in enumerate(texts.keys):
            own = texts.text(i)
            cut = gone[texts.first[i] : texts.first[i + 1]] if gone is not None else None
            if cut is None or not cut.any():
                yield key, len(own), 0, [], [], own.tobytes()
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
            yield key, len(own), int(cut.sum()), edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), own[~cut].tobytes()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, the removed spans (`starts` and `lengths`, in bytes) and `kept`, the other bytes."""
    runs = make_runs(docs, key, text)
    buckets, parts, bits, _ = plan(runs)
    shared = each_destination(each_run(runs, _send_anchors(buckets, bits)), _match_anchors, SENT, SENT_DDL, parts)
    suffixes = each_destination(with_runs(runs, shared), _send_suffixes(buckets, bits), SENT, SENT_DDL, parts)
    told = each_destination(suffixes, _merge_suffixes, SENT, SENT_DDL, parts)
    return each_destination(with_runs(runs, told), _remove, KEPT, KEPT_DDL, parts).withColumnRenamed("__key", key)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
