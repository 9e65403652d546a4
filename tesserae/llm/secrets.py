"""Secret scans: candidate strings by pattern, false positives removed by a random forest compiled to SQL.

A candidate is, between white space, any run of at least 16 key characters with a letter and a digit, or one of at
least 8 that a secret's name and an assignment stand before; behind such a name in the same word, other signs may be
part of it, up to a quote, bracket or separator.  A word may hold several; each is judged by the name before it, not
by those of the rest of the word.  Longer ones are masked first.  Its features:
length, changes between character classes, shares of digits and of hexadecimal digits, different characters,
dictionary coverage, path marks, and the words around it.  The forest is trained by Spark ML on labelled findings
(columns `candidate`, `prev2`, `prev`, `next`, `label`), of which at most TRAIN_ROWS are used; by default on a set made
here from rules of what secrets and their look-alikes (digests, identifiers, paths, placeholders, long words) are.
Its trees become CASE expressions over the features, so that a scan is one projection of built-in functions, without a
shuffle, over whole texts.

Null text: no findings; it stays null.  Rows with null or repeated keys are scanned like any other.  A secret that
occurs twice in a text is two findings and is masked at each place.  Other columns are left alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import free_name, read

TRAIN_ROWS = 6000
TREES = 15
DEPTH = 5
MASK = "[SECRET]"
_SPACES = "[ \\t-\\r]+"

_SECRET_NAMES = "token|secret|password|passwd|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private_?key"
_BENIGN_NAMES = "commit|sha1?|sha256|hash|md5|checksum|digest|uuid|guid|version|build|etag|revision|id|file|path|url|example|integrity"
#: Words whose share of a candidate's letters is its dictionary coverage.
_DICTIONARY = "about|account|admin|after|application|auth|build|change|class|client|config|content|create|data|default|document|example|file|first|function|get|group|handle|image|index|internal|item|key|list|main|manager|message|model|module|name|number|object|option|order|package|page|path|placeholder|process|project|public|query|record|release|report|request|response|result|sample|script|server|service|session|set|source|static|string|system|table|template|test|text|time|token|type|update|user|value|version|view|web|with|your"

FEATURES = {
    "length": "CAST(length(c) AS DOUBLE)",
    "transitions": "CAST(length(regexp_replace(k, '(.)\\\\1+', '$1')) - 1 AS DOUBLE) / length(c)",
    "digits": "CAST(length(c) - length(translate(c, '0123456789', '')) AS DOUBLE) / length(c)",
    "hexadecimal": "CAST(length(c) - length(translate(c, '0123456789abcdef', '')) AS DOUBLE) / length(c)",
    "different": "CAST(size(array_distinct(split(c, ''))) AS DOUBLE)",
    "dictionary": f"CAST(length(c) - length(regexp_replace(lower(c), '{_DICTIONARY}', '')) AS DOUBLE) / length(c)",
    "path_marks": "CAST(length(c) - length(translate(c, '/.:', '')) AS DOUBLE)",
    "dashes": "CAST(length(c) - length(translate(c, '-_', '')) AS DOUBLE)",
    "longest_run": "CAST(aggregate(split(regexp_replace(k, '(.)(?!\\\\1)', '$1 '), ' '), 0, (m, x) -> greatest(m, length(x))) AS DOUBLE)",
    "secret_name": f"CAST(CASE WHEN lower(concat_ws(' ', p2, p1, w)) RLIKE '(^|[^a-z])({_SECRET_NAMES})' THEN 1 ELSE 0 END AS DOUBLE)",
    "benign_name": f"CAST(CASE WHEN lower(concat_ws(' ', p2, p1)) RLIKE '(^|[^a-z])({_BENIGN_NAMES})([^a-z]|$)' THEN 1 ELSE 0 END AS DOUBLE)",
    "assigned": "CAST(CASE WHEN p1 RLIKE '[=:]$' OR w RLIKE '[=:]' THEN 1 ELSE 0 END AS DOUBLE)",
    "quoted": "CAST(CASE WHEN w RLIKE '[\"\\']' THEN 1 ELSE 0 END AS DOUBLE)",
    "sentence_after": "CAST(CASE WHEN n1 RLIKE '^[a-z]+[,.]?$' THEN 1 ELSE 0 END AS DOUBLE)",
}

_CLASSES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '0'), '[^aA0]', '-')"
#: A name of a secret, an assignment, and a value that may hold any sign but those that end it.
_NAMED = f"(?i)[\"\\']?(?:{_SECRET_NAMES})[A-Za-z0-9_-]*[\"\\']?[=:]+[\"\\']?([^\\\\s\"\\'&,;<>{{}}\\\\[\\\\]()]{{8,}})"
#: A run of key characters with its padding; a name and its assignment are passed over.
_RUN = "[\"\\']?(?:[A-Za-z0-9_.-]+[\"\\']?[=:]+(?=[^=:\\\\s])[\"\\']?)?([A-Za-z0-9+/_.-]+={0,2})"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _features(c: str, w: str, p2: str, p1: str, n1: str) -> str:
    """A struct of the features of a candidate c in the word w."""
    fields = ", ".join(f"'{n}', {e}" for n, e in FEATURES.items())
    body = f"named_struct({fields})"
    body = _let(_CLASSES, "k", body)
    for name, value in (("n1", n1), ("p1", p1), ("p2", p2), ("w", w), ("c", c)):
        body = _let(value, name, body)
    return body


def _candidates(w: str) -> str:
    """All parts of a word that may be a key (c), each with the quote, name and assignment before it (w): what a named assignment gives, up to a quote or separator, and every other run of key characters.

    A name before = or : is matched apart, so that it is no part of a run; = at the end of a run is base64 padding.
    """
    found = [f"transform(arrays_zip(regexp_extract_all({w}, '{p}', 1), regexp_extract_all({w}, '{p}', 0)), e -> named_struct('c', e['0'], 'w', e['1']))" for p in (_NAMED, _RUN)]
    runs = f"filter({found[1]}, r -> length(r.c) >= 8 AND NOT exists(named, e -> contains(e.c, r.c)))"
    return _let(found[0], "named", f"concat(named, {runs})")


def _is_candidate(c: str, p2: str, p1: str, w: str) -> str:
    named = f"lower(concat_ws(' ', {p2}, {p1}, {w})) RLIKE '({_SECRET_NAMES})' AND ({p1} RLIKE '[=:]$' OR {w} RLIKE '[=:].')"
    return f"(length({c}) >= 16 AND {c} RLIKE '[0-9]' AND {c} RLIKE '[A-Za-z]' OR length({c}) >= 8 AND {named})"


def made_findings(spark: SparkSession, n: int = TRAIN_ROWS) -> DataFrame:
    """Labelled findings by rule: secrets with their names and assignments, bare keys, and what only looks like them."""
    hexes = "sha2(concat('s', id), 256)"
    mixed = "translate(base64(unhex(sha2(concat('m', id), 256))), '+/=', 'xYz')"
    names = "element_at(array('token', 'secret', 'password', 'api_key', 'access_key', 'auth'), CAST(1 + pmod(xxhash64(id, 1), 6) AS INT))"
    benign = "element_at(array('commit', 'sha256', 'md5', 'checksum', 'uuid', 'version', 'etag', 'id'), CAST(1 + pmod(xxhash64(id, 2), 8) AS INT))"
    word = "element_at(array('the', 'la', 'and', 'von', 'que', 'these', 'under', 'mit'), CAST(1 + pmod(xxhash64(id, {0}), 8) AS INT))"
    size = "CAST(20 + pmod(xxhash64(id, 3), 24) AS INT)"
    w1, w2, w3 = word.format(4), word.format(5), word.format(6)
    kinds = [
        (1, f"left({hexes}, 40)", names, "'='", w1, True),
        (1, f"left({hexes}, 32)", names, "':'", w1, True),
        (1, f"left({mixed}, {size})", names, "'='", w1, True),
        (1, f"left({mixed}, {size})", w2, w3, w1, False),
        (1, f"upper(left({mixed}, 20))", names, "'='", w1, False),
        (0, f"left({hexes}, 40)", w2, benign, w1, False),
        (0, f"left({hexes}, 40)", benign, "'='", w1, False),
        (0, f"concat_ws('-', left({hexes}, 8), substr({hexes}, 9, 4), substr({hexes}, 13, 4), substr({hexes}, 17, 4), substr({hexes}, 21, 12))", w2, benign, w1, False),
        (0, f"concat('/usr/share/project/module', id, '/source_file.version.', pmod(id, 9))", w2, w3, w1, False),
        (0, "concat('your_example_token_value_', pmod(id, 90))", names, "'='", w1, True),
        (0, "concat('default_session_manager_v', pmod(id, 20))", w2, w3, w1, False),
        (0, f"concat(repeat({w2}, 5), pmod(id, 10))", w3, w1, w2, False),
    ]
    expr = "CASE CAST(pmod(id, {n}) AS INT) {whens} END"

    def pick(i: int) -> str:
        return expr.format(n=len(kinds), whens=" ".join(f"WHEN {j} THEN {k[i] if i < 5 else str(k[i]).lower()}" for j, k in enumerate(kinds)))

    return spark.range(n).selectExpr(f"{pick(1)} AS candidate", f"{pick(2)} AS prev2", f"{pick(3)} AS prev", f"{pick(4)} AS next", f"{pick(0)} AS label", f"{pick(5)} AS quoted")


def train(labelled: DataFrame, most: int = TRAIN_ROWS, seed: int = 7) -> str:
    """Fit the forest on at most `most` labelled findings, and return it as an SQL expression of the features: the share of trees that say secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    chosen = labelled.orderBy(F.xxhash64("candidate", "prev2", "prev", "next")).limit(most)
    word = "CASE WHEN quoted THEN concat('\"', candidate, '\"') ELSE candidate END" if "quoted" in labelled.columns else "candidate"
    table = chosen.selectExpr("CAST(label AS DOUBLE) AS label", f"{_features('candidate', word, 'prev2', 'prev', 'next')} AS x").select("label", "x.*")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)
    return compile_forest(model.toDebugString)


def compile_forest(text: str) -> str:
    """Spark ML's description of a forest as SQL over a struct `x` of the features."""
    names, trees = list(FEATURES), []
    for line in text.splitlines():
        line = line.strip()
        if re.match(r"Tree \d+", line):
            trees.append([])
        elif trees and line:
            trees[-1].append(line)

    def node(lines: list[str]) -> str:
        line = lines.pop(0)
        if m := re.match(r"Predict: ([\d.]+)", line):
            return f"{float(m[1])}D"
        m = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
        yes = node(lines)
        lines.pop(0)  # Else
        return f"CASE WHEN x.{names[int(m[1])]} <= {float(m[2])!r}D THEN {yes} ELSE {node(lines)} END"

    return "(" + " + ".join(node(t) for t in trees) + f") / {len(trees)}D"


def _findings(text: str, forest: str) -> str:
    """An array of the findings of a text: place (of the word), candidate, score."""
    near = [f"coalesce(get(t, i - {k}), '')" for k in (2, 1)] + ["coalesce(get(t, i + 1), '')"]
    found = f"named_struct('place', i, 'w', c.w, 'c', c.c, 'p2', {near[0]}, 'p1', {near[1]}, 'n1', {near[2]})"
    every = f"flatten(filter(transform(t, (w, i) -> CASE WHEN length(w) >= 8 THEN transform({_candidates('w')}, c -> {found}) END), x -> x IS NOT NULL))"
    long_words = f"filter({every}, f -> {_is_candidate('f.c', 'f.p2', 'f.p1', 'f.w')})"
    scored = f"transform({long_words}, f -> {_let(_features('f.c', 'f.w', 'f.p2', 'f.p1', 'f.n1'), 'x', f'named_struct({chr(39)}place{chr(39)}, CAST(f.place AS BIGINT), {chr(39)}candidate{chr(39)}, f.c, {chr(39)}score{chr(39)}, {forest})')})"
    return _let(f"split(coalesce({text}, ''), '[ \\\\t-\\\\r]+')", "t", scored)


def with_findings(docs: DataFrame, forest: str, text: str = "text", into: str = "__findings") -> DataFrame:
    return docs.withColumn(into, F.expr(_findings(f"CAST(`{text}` AS STRING)", forest)))


def scan(docs: DataFrame, forest: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per finding: key, place (of its word in the text), candidate, score, is_secret (half of the trees or more)."""
    forest = forest or train(made_findings(docs.sparkSession))
    found = with_findings(docs.select(F.col(key).alias(key), F.col(text).alias("__text")), forest, "__text")
    flat = found.select(key, F.explode("__findings").alias("f"))
    return flat.select(key, "f.place", "f.candidate", "f.score", (F.col("f.score") >= 0.5).alias("is_secret"))


def mask(docs: DataFrame, forest: str | None = None, text: str = "text") -> DataFrame:
    """All rows and columns; each secret is replaced by MASK in the words in which it was found."""
    forest = forest or train(made_findings(docs.sparkSession))
    kind, into = docs.schema[text].dataType, free_name(docs, "__findings")
    whole = f"CAST(`{text}` AS STRING)"
    own = "array_sort(filter(s, f -> f.place = i), (a, b) -> length(b.candidate) - length(a.candidate))"
    word = f"aggregate({own}, w, (t, f) -> replace(t, f.candidate, '{MASK}'))"
    # words and what stands between them take turns; only words that hold a secret change
    words = f"transform(split({whole}, '{_SPACES}'), (w, i) -> CASE WHEN array_contains(p, CAST(i AS BIGINT)) THEN {word} ELSE w END)"
    text_again = f"array_join(zip_with({words}, regexp_extract_all({whole}, '{_SPACES}', 0), (w, x) -> concat(w, coalesce(x, ''))), '')"
    masked = _let(f"filter({into}, f -> f.score >= 0.5D)", "s", f"CASE WHEN size(s) = 0 THEN {whole} ELSE {_let('array_distinct(transform(s, f -> f.place))', 'p', text_again)} END")
    return with_findings(docs, forest, text, into).withColumn(text, F.expr(masked).cast(kind)).drop(into)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
