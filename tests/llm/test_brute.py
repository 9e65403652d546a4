"""Secret scans and the whole pipeline against plain Python written from their descriptions."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import duckdb
import pytest

import corpus_pipeline
from tesserae.llm import quality, secrets
from tests.llm.test_contracts import WORD, shingle_weights, weighted_jaccard, without_repeats

NAMES = "token|secret|password|passwd|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private_?key"
BENIGN = "commit|sha1?|sha256|hash|md5|checksum|digest|uuid|guid|version|build|etag|revision|id|file|path|url|example|integrity"
NAMED = re.compile(rf"""["']?(?:{NAMES})[A-Za-z0-9_-]*["']?[=:]+["']?([^\s"'&,;<>{{}}\[\]()]{{8,}})""", re.I | re.A)
RUN = re.compile(r"""["']?(?:[A-Za-z0-9_.-]+["']?[=:]+(?=[^=:\s]))?["']?([A-Za-z0-9+/_.-]+={0,2})""", re.A)
SPACES = re.compile(r"[ \t-\r]+")


def share(part, c):
    return part / len(c)


def features(c, w, p2, p1, n1):
    kinds = ["a" if "a" <= x <= "z" else "A" if "A" <= x <= "Z" else "0" if "0" <= x <= "9" else "-" for x in c]
    runs = [len(list(g)) for _, g in groupby(kinds)]
    left = re.sub(secrets._DICTIONARY, "", c.lower())
    return {
        "length": float(len(c)), "transitions": share(len(runs) - 1, c), "digits": share(sum(x in "0123456789" for x in c), c), "hexadecimal": share(sum(x in "0123456789abcdef" for x in c), c),
        "different": float(len(set(c))), "dictionary": share(len(c) - len(left), c), "path_marks": float(sum(x in "/.:" for x in c)), "dashes": float(sum(x in "-_" for x in c)), "longest_run": float(max(runs)),
        "secret_name": float(bool(re.search(rf"(^|[^a-z])({NAMES})", f"{p2} {p1} {w}".lower()))), "benign_name": float(bool(re.search(rf"(^|[^a-z])({BENIGN})([^a-z]|$)", f"{p2} {p1}".lower()))),
        "assigned": float(bool(re.search("[=:]$", p1) or re.search("[=:]", w))), "quoted": float(bool(re.search("[\"']", w))), "sentence_after": float(bool(re.match("^[a-z]+[,.]?$", n1))),
    }


def candidates(text):
    """(place of the word, candidate, features)."""
    words = SPACES.split(text)
    for i, word in enumerate(words):
        if len(word) < 8:
            continue
        near = [words[i - 2] if i > 1 else "", words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""]
        named = [(m[1], m[0]) for m in NAMED.finditer(word)]
        runs = [(m[1], m[0]) for m in RUN.finditer(word) if len(m[1]) >= 8 and not any(m[1] in c for c, _ in named)]
        for c, w in named + runs:
            told = re.search(NAMES, f"{near[0]} {near[1]} {w}".lower()) and (re.search("[=:]$", near[1]) or re.search("[=:].", w))
            if len(c) >= 16 and re.search("[0-9]", c) and re.search("[A-Za-z]", c) or len(c) >= 8 and told:
                yield i, c, features(c, w, *near)


def scored(forest, found):
    """The forest's SQL, evaluated by DuckDB over features made in Python."""
    forest = re.sub(r"(\d)D\b", r"\1", forest).replace("x.", "")
    base = duckdb.connect()
    names = list(secrets.FEATURES)
    base.execute(f"CREATE TABLE f (n BIGINT, {', '.join(f'{c} DOUBLE' for c in names)})")
    if found:
        base.executemany(f"INSERT INTO f VALUES ({', '.join('?' * (len(names) + 1))})", [[n, *[x[c] for c in names]] for n, x in enumerate(found)])
    return [s for _, s in base.execute(f"SELECT n, CAST({forest} AS DOUBLE) FROM f ORDER BY n").fetchall()]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.made_findings(spark))


def findings(forest, texts):
    found = [(k, place, c, x) for k, t in texts for place, c, x in candidates(t or "")]
    return [(k, place, c, s) for (k, place, c, _), s in zip(found, scored(forest, [x for *_, x in found]), strict=True)]


def test_scan_of_made_lines(spark, forest):
    """Lines with keys in addresses, compact JSON, cookies, padded base64, quotes and passwords with signs."""
    key = "q7Zx81Lp0Wm4Rt6Vy2Bn9Kc3Hd5Jf"
    made = [
        f"https://api.host.com/v1/items?user=abc&token={key}", f'{{"user":"alexander","token":"{key}"}}', "dGhpc2lzYXNlY3JldGtleQ== here", "password=Xy9!kQz#w2Lm$4 now", f"id=longusername1,key={key};x",
        f"the secret: '{key}' and {key}", "", "   ", None, f"auth={'ab1' * 4000}", f"api_key==={key}", "token=", f"\t{key}\n{key}",
    ]
    docs = list(enumerate(made))
    got = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"), forest).collect()
    want = findings(forest, docs)
    assert len(want) > 10
    assert Counter((r["doc_id"], r["place"], r["candidate"], r["is_secret"]) for r in got) == Counter((k, p, c, s >= 0.5) for k, p, c, s in want)


def test_scan(spark, sf_dir, texts, forest):
    got = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), forest).collect()
    want = findings(forest, texts)
    assert want
    assert Counter((r["doc_id"], r["place"], r["candidate"], round(r["score"], 9), r["is_secret"]) for r in got) == Counter((k, p, c, round(s, 9), s >= 0.5) for k, p, c, s in want)


def masked(text, found):
    parts = re.split(r"([ \t-\r]+)", text)
    for place, c, score in sorted(found, key=lambda f: -len(f[1])):
        if score >= 0.5:
            parts[2 * place] = parts[2 * place].replace(c, secrets.MASK)
    return "".join(parts)


def first_of_classes(rows):
    vectors, parent = shingle_weights(rows), {k: k for k, _ in rows}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by_shingle = {}
    for k, own in vectors.items():
        for s in own:
            by_shingle.setdefault(s, []).append(k)
    for a, b in {(a, b) for ks in by_shingle.values() for a in ks for b in ks if a < b}:
        if weighted_jaccard(vectors[a], vectors[b]) >= 0.8:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    blank = min((k for k, t in rows if not WORD.findall(t)), default=None)
    return [(k, t) for k, t in rows if top(k) == k and (WORD.findall(t) or k == blank)]


def test_pipeline_stages(spark, sf_dir, texts, forest):
    """Each stage's rows, from the rows that the stage before it should have left; then the packed tokens of run()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        found[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = duckdb.connect()
    judged.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    good = {k for k, kept in judged.execute(f"SELECT doc_id, kept FROM ({quality.ORACLE_SQL})").fetchall() if kept}
    rows = [(k, t) for k, t in texts if k in good]
    assert found["quality_rules"] == dict(rows)
    rows = [(k, t) for k, _, t in without_repeats(rows)]
    assert found["line_dedup"] == dict(rows)
    rows = first_of_classes(rows)
    assert found["near_dedup"] == dict(rows)
    by = {}
    for k, place, c, s in findings(forest, rows):
        by.setdefault(k, []).append((place, c, s))
    rows = [(k, masked(t, by.get(k, []))) for k, t in rows]
    assert found["secret_masking"] == dict(rows)
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in rows}
    pieces, length = corpus_pipeline.run(spark, sf_dir).collect(), Counter()
    for p in pieces:
        length[p["doc_id"]] += p["length"]
    assert length == want and all(p["doc_tokens"] == want[p["doc_id"]] for p in pieces)
