"""The queries against brute force on the test tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tesserae.llm import registry
from tests.comparing import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def sf_dir(request):
    return f"/root/testdata/{request.param}"


@pytest.fixture(scope="module")
def documents(sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]


def rows(spark, sf_dir, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, sf_dir).collect()]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), sf_dir, registry.ORACLE_SQL[name])


def test_bpe(spark, sf_dir, documents):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for k, t in documents:
        ids = encoding.encode_ordinary(t)
        want[k] = len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())
    got = rows(spark, sf_dir, "op1_bpe")
    assert len(got) == len(documents)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_quality_counts(spark, sf_dir, documents):
    want = {}
    for k, t in documents:
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered.update(range(i, i + 5))
        want[k] = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)
    got = rows(spark, sf_dir, "op2_quality_rules")
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got} == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_substrings(spark, sf_dir, documents):
    first: dict[tuple, int] = {}
    for k, t in documents:
        w = WORD.findall(t)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, k), k)
    want = {}
    for k, t in documents:
        w = WORD.findall(t)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone.update(range(i, i + 13))
        want[k] = len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())
    got = rows(spark, sf_dir, "op5_substring_dedup")
    assert len(got) == len(documents)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_suffixes(spark, sf_dir, documents):
    first: dict[bytes, int] = {}
    for k, t in documents:
        b = t.encode()
        for i in range(len(b) - 49):
            g = b[i : i + 50]
            if first.get(g, k) >= k:
                first[g] = k
    want = {}
    for k, t in documents:
        b = np.frombuffer(t.encode(), np.uint8)
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50].tobytes()] < k:
                gone[i : i + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1))
        want[k] = len(b), int(gone.sum()), spans, sha(b[~gone].tobytes())
    got = rows(spark, sf_dir, "op8_suffix_dedup")
    assert len(got) == len(documents)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def check_packing(got, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in documents}
    pieces: dict[int, list] = {}
    sequences: dict[int, list] = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own)
    assert pieces.keys() == ids.keys()
    for k, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[k])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / total


def test_packing(spark, sf_dir, documents):
    assert check_packing(rows(spark, sf_dir, "op6_packing"), documents) < 0.02


def test_topk(spark, sf_dir):
    table = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist() if r["embedding"] is not None]
    ids = np.array([k for k, _ in table])
    vectors = np.floor(64 * np.array([v for _, v in table], np.float64)).astype(np.int64)
    want = set()
    for k, v in zip(ids, vectors, strict=True):
        if k % 20 == 0:
            scores = vectors @ v
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != k][:20]
            want.update((int(k), n + 1, int(ids[i]), int(scores[i])) for n, i in enumerate(order))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(spark, sf_dir, "op10_topk")} == want


def shingle_weights(documents):
    sets = {k: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, t in documents if (w := WORD.findall(t))}
    df = Counter(s for c in sets.values() for s in c)
    n = len(documents)
    return {k: {s: c * (1 + 0.5 * np.log((1 + n) / (1 + df[s])) / np.log(1 + n)) for s, c in own.items()} for k, own in sets.items()}


def weighted_jaccard(a, b):
    if len(b) < len(a):
        a, b = b, a
    inner = sum(min(x, b[s]) for s, x in a.items() if s in b)
    return inner / (sum(a.values()) + sum(b.values()) - inner)


def test_minhash(spark, sf_dir, documents):
    vectors = shingle_weights(documents)
    by_shingle: dict[tuple, list[int]] = {}
    for k, own in vectors.items():
        for s in own:
            by_shingle.setdefault(s, []).append(k)
    parent = {k: k for k, _ in documents}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in {(a, b) for ks in by_shingle.values() for a in ks for b in ks if a < b}:
        if weighted_jaccard(vectors[a], vectors[b]) >= 0.8:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = rows(spark, sf_dir, "op3_minhash")
    assert {r["doc_id"]: r["class_id"] for r in got} == {k: top(k) for k in parent}
    assert all(r["kept"] == (r["class_id"] == r["doc_id"]) for r in got)


def chunked(t):
    """Chunks by the rule as written, line by line, without the operator's code."""
    import xxhash

    lines, values, before = t.split("\n"), [], 0
    for x in lines:
        h = xxhash.xxh3_64_intdigest(x.encode())
        values.append(((before * 0x9E3779B97F4A7C15 % 2**64 ^ h) * 0xD6E8FEB86659FD93 % 2**64) // 2**32)
        before = h
    out, held = [], []
    for i, x in enumerate(lines):
        held.append(i)
        if len(held) >= 2 and values[i] % 4 == 0 or i == len(lines) - 1:
            out.append(held)
            held = []
        elif len(held) == 64:
            best = min(range(1, 64), key=lambda j: values[held[j]])
            out.append(held[: best + 1])
            held = held[best + 1 :]
            assert not any(values[j] % 4 == 0 for j in held[1:])
    return [(c[0], "\n".join(lines[c[0] : c[-1] + 1])) for c in out if c]


def without_repeats(held):
    """(key, lines removed, text): chunks seen before go, with the lines around them that are those around the first, within the chunks next to both."""
    first, out = {}, []
    for k, t in sorted(held):
        lines, found, gone = t.split("\n"), [(place, body.split("\n")) for place, body in chunked(t)], set()
        for i, (place, chunk) in enumerate(found):
            if sum(bool(x.strip()) for x in chunk) < 2:
                continue
            before = found[i - 1][1][::-1] if i else []
            after = found[i + 1][1] if i + 1 < len(found) else []
            if tuple(chunk) not in first:
                first[tuple(chunk)] = before, after
                continue
            gone |= set(range(place, place + len(chunk)))
            for mine, other, at, step in ((before, first[tuple(chunk)][0], place - 1, -1), (after, first[tuple(chunk)][1], place + len(chunk), 1)):
                for x, y in zip(mine, other):
                    if x != y:
                        break
                    gone.add(at)
                    at += step
        out.append((k, len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_lines(spark, sf_dir, documents):
    want = {k: (n, sha(t.encode())) for k, n, t in without_repeats(documents)}
    got = rows(spark, sf_dir, "op4_line_dedup")
    assert {r["doc_id"]: (r["n_removed_lines"], r["kept_sha256"]) for r in got} == want
    assert sum(n for n, _ in want.values()) > 0


def test_lines_around_chunks(spark):
    """Passages cut differently at their ends, many copies dealt to several parts, and no line lost for good."""
    import random

    from tesserae.llm import lines

    draw = random.Random(4)
    passage = [f"shared line {i} of the passage" for i in range(9)]
    held = []
    for k in range(60):
        own = [[f"own {draw.random()}" for _ in range(draw.randint(1, 4))] for _ in range(2)]
        a, b = draw.randint(0, 3), draw.randint(6, 9)
        held.append((k, "\n".join(own[0] + passage[a:b] + own[1] + ["x"] * draw.randint(0, 3))))
    lines_parts, lines.CLASS_ROWS = lines.CLASS_ROWS, 3
    try:
        got = lines.remove_repeats(spark.createDataFrame(held, "doc_id long, text string").repartition(4), removed="n").collect()
    finally:
        lines.CLASS_ROWS = lines_parts
    want = without_repeats(held)
    assert sorted((r["doc_id"], r["n"], r["text"]) for r in got) == want
    assert {x for _, t in held for x in t.split("\n")} == {x for _, _, t in want for x in t.split("\n")}


def test_packing_is_the_cheapest():
    """The cuts against a programme that tries every earlier place, with penalties, exact powers of two, and places too far apart for sentences."""
    import random

    from tesserae.llm import packing

    rng = random.Random(11)
    powers = {1 << k for k in range(12)}
    for case in range(300):
        steps = rng.choice([[1, 2, 4, 8, 16, 64, 128, 512, 1024, 2048], [*range(5, 60)], [100, 156, 256, 300, 700, 1900]])
        places, penalties, at = [], [], 0
        for _ in range(rng.randrange(1, 60)):
            at += rng.choice(steps)
            places.append(at)
            penalties.append(rng.choice([0, 2, 32]) if case % 3 else 0)
        penalties[-1] = 0
        best, every = [0], [0, *places]
        for j in range(1, len(every)):
            cost = min(best[i] + (0 if every[j] - every[i] in powers else 2048 - (every[j] - every[i])) for i in range(j) if every[j] - every[i] <= 2048)
            best.append(cost + penalties[j - 1])
        cuts, total, before = packing.best_cuts(places, penalties), 0, 0
        for c in cuts:
            assert 0 < c - before <= 2048
            total += (0 if c - before in powers else 2048 - (c - before)) + penalties[places.index(c)]
            before = c
        assert before == places[-1] and total == best[-1]
