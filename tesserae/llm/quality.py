"""Quality rules: a table of ratios and bounds, compiled into one projection of built-in functions.

Words are runs of anything but ASCII white space.  A text fails the base rules with fewer than 10 words, or if more
than a fifth of its words lie in five-word windows that the text has twice or more.  The other rules bound a ratio
each; a ratio whose denominator is 0 passes.  All counts are over whole texts, within one row: nothing is shuffled.
Windows are compared by a 64-bit hash of their words, within their text only.

Null text: no words, hence base_failed.  Rows with null or repeated keys are judged like any other.  Other columns
are left alone by `keep_good`, and don't appear in `measure`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import free_name, read

STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was were with",
    "fr": "au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une",
    "de": "auf aus das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu",
    "es": "al con de del el en es la las lo los no o para por que se su un una y",
}

#: name, what is counted, per what, least, most.  Measures are those of MEASURES and the base counts.
RULES = [
    ("word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols", "n_symbols", "n_words", 0.0, 0.25),
    ("exclamations", "n_exclamations", "n_words", 0.0, 0.5),
    ("stop_words", "n_stop_words", "n_words", 0.02, 1.0),
    ("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    ("bullet_lines", "n_bullet_lines", "n_lines", 0.0, 0.9),
    ("open_lines", "n_open_lines", "n_lines", 0.0, 0.5),
]
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20  # per cent of words

_W = r"[\\x20\\x09-\\x0D]"
_STOPS = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))


def _let(value: str, name: str, body: str) -> str:
    """`value` is computed once for each row and named in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated(words: str) -> str:
    """Words in windows that occur twice or more: sort windows by hash, keep those with an equal neighbour, add up what their places cover."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(WINDOW))
    windows = f"transform(sequence(0, size({words}) - {WINDOW}), i -> named_struct('h', xxhash64({parts}), 'p', i))"
    places = "sort_array(transform(filter(s, (x, k) -> get(s, k - 1).h <=> x.h OR get(s, k + 1).h <=> x.h), x -> x.p))"
    covered = f"aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L, (a, b) -> a + b)"
    found = _let(f"sort_array({windows})", "s", _let(places, "p", covered))
    return f"CASE WHEN size({words}) < {WINDOW} THEN 0L ELSE {found} END"


def _measures(text: str) -> str:
    """One struct of all counts of a text that is not null."""
    from_words = (
        "named_struct('n_words', CAST(size(w) AS BIGINT), "
        f"'n_stop_words', CAST(size(filter(w, x -> lower(rtrim('.,;:!?', x)) IN ({_STOPS}))) AS BIGINT), "
        f"'n_repeat_words', {_repeated('w')})"
    )
    from_lines = (
        "named_struct('n_lines', CAST(size(l) AS BIGINT), 'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT), "
        "'n_bullet_lines', CAST(size(filter(l, x -> ltrim(x) LIKE '-%' OR ltrim(x) LIKE '*%' OR ltrim(x) LIKE '•%')) AS BIGINT), "
        "'n_open_lines', CAST(size(filter(l, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS BIGINT))"
    )
    words = _let(f"filter(split({text}, '{_W}+'), x -> x <> '')", "w", from_words)
    lines = _let(f"filter(split({text}, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')", "l", from_lines)
    spaces = r"' \t\n\u000B\u000C\r'"
    chars = f"CAST(length(translate({text}, {spaces}, '')) AS BIGINT)"
    symbols = f"CAST(length({text}) - length(translate({text}, '#*$%&|<>', '')) AS BIGINT)"
    marks = f"CAST(length({text}) - length(translate({text}, '!', '')) AS BIGINT)"
    return f"named_struct('words', {words}, 'lines', {lines}, 'word_chars', {chars}, 'n_symbols', {symbols}, 'n_exclamations', {marks})"


def rule(count: str, per: str, least: float, most: float) -> str:
    """Multiplied out, so that no ratio is rounded."""
    return f"({per} = 0 OR {count} >= {least}D * {per} AND {count} <= {most}D * {per})"


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_exclamations", "n_lines", "n_bullet_lines", "n_open_lines"]


def with_measures(docs: DataFrame, text: str = "text", into: str = "__quality") -> DataFrame:
    """All columns, and a struct of the counts, `base_failed`, each rule's verdict and `kept`."""
    verdicts = {name: rule(*bounds) for name, *bounds in RULES}
    base = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
    flat = {"n_words": "q.words.n_words", "n_stop_words": "q.words.n_stop_words", "n_repeat_words": "q.words.n_repeat_words", "n_lines": "q.lines.n_lines", "n_dup_lines": "q.lines.n_dup_lines", "n_bullet_lines": "q.lines.n_bullet_lines", "n_open_lines": "q.lines.n_open_lines", "word_chars": "q.word_chars", "n_symbols": "q.n_symbols", "n_exclamations": "q.n_exclamations"}

    def on(expression: str) -> str:
        for name in sorted(COUNTS, key=len, reverse=True):
            expression = expression.replace(name, f"@{COUNTS.index(name)}@")
        for i, name in enumerate(COUNTS):
            expression = expression.replace(f"@{i}@", flat[name])
        return expression

    fields = [f"'{c}', {flat[c]}" for c in COUNTS] + [f"'base_failed', {on(base)}"] + [f"'ok_{n}', {on(v)}" for n, v in verdicts.items()] + [f"'kept', NOT {on(base)} AND {on(' AND '.join(verdicts.values()))}"]
    body = f"named_struct({', '.join(fields)})"
    return docs.withColumn(into, F.expr(_let(_measures(f"coalesce(CAST(`{text}` AS STRING), '')"), "q", body)))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, the counts, base_failed, ok_<rule> for each rule, kept."""
    return with_measures(docs.select(F.col(key).alias(key), F.col(text).alias("__text")), "__text").select(key, "__quality.*")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes all rules, with all their columns."""
    into = free_name(docs, "__quality")
    return with_measures(docs, text, into).where(F.col(into)["kept"]).drop(into)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    base = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
    verdicts = [(n, f"({p} = 0 OR {c} >= CAST({a} AS DOUBLE) * {p} AND {c} <= CAST({b} AS DOUBLE) * {p})") for n, c, p, a, b in RULES]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
s AS (SELECT doc_id, r, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS p, w FROM s WHERE len(w) >= {WINDOW}),
k AS (SELECT r, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g FROM g),
m AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM k),
c AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM m WHERE n > 1),
e AS (SELECT r, CAST(sum(least({WINDOW}, coalesce(q - p, {WINDOW}))) AS BIGINT) AS n_repeat_words FROM c GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
  CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(list_filter(l, lambda x: ltrim(x, ' ') LIKE '-%' OR ltrim(x, ' ') LIKE '*%' OR ltrim(x, ' ') LIKE '•%')) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS BIGINT) AS n_open_lines
  FROM s LEFT JOIN e USING (r))
SELECT doc_id, {", ".join(COUNTS)}, {base} AS base_failed, {", ".join(f"{v} AS ok_{n}" for n, v in verdicts)},
  NOT {base} AND {" AND ".join(v for _, v in verdicts)} AS kept FROM f"""


ORACLE_SQL = _oracle()
