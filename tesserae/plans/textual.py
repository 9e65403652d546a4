"""Text functions over pages, documents and conversations, and data curation over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import curation
from tesserae.plans.registry import query


@query("f1_last_code_block", r"""WITH c AS (SELECT doc_id, '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'and' || chr(10) || CASE WHEN length(text) % 3 = 0 THEN 'no block' ELSE '```' || chr(10) || source || chr(10) || '```' END AS t FROM documents),
b AS (SELECT doc_id, regexp_extract_all(t, '(?s)```(?:python|py)?\s*\n(.*?)```', 1) AS a, regexp_extract_all(t, '(?s)```(?:python|py|Python)?[ \t]*\n(.*?)```', 1) AS b FROM c)
SELECT doc_id, a[-1] AS code, regexp_replace(regexp_replace(coalesce(list_filter(b, lambda x: contains(x, 'the'))[-1], b[-1]), '^\n+', ''), '\n+$', '') || chr(10) AS preferred, CAST(len(b) AS BIGINT) AS n_blocks FROM b""")
def last_block(x):
    """The last block, and the last that holds a name, else the last, with the number of blocks; over all documents, those with fences of their own too."""
    last = F.when(F.length("text") % 3 == 0, "no block").otherwise(F.concat(F.lit("```\n"), "source", F.lit("\n```")))
    fenced = x.documents.select("doc_id", F.concat(F.lit("```python\n"), "text", F.lit("\n```\nand\n"), last).alias("t"))
    found = text.code_block_preferring(F.col("t"), "the")
    return fenced.select("doc_id", text.last_code_block(F.col("t")).alias("code"), found["code"].alias("preferred"), found["n_blocks"].alias("n_blocks"))


def _families_sql() -> str:
    tags = ", ".join("CASE WHEN regexp_matches(s, '" + p.replace("'", "''") + f"') THEN '{t}' END" for t, p in text.FAMILY_PATTERNS)
    order = ", ".join(f"'{o}'" for o in text.FAMILY_ORDER)
    return f"""WITH d AS (SELECT p_partkey, p_name || ' ' || ['nn.Linear(x)', 'F.softmax(x)', 'torch.sum(x)', 'Conv2d relu', 'plain', 'LayerNorm and rope', 'SwiGLU MLP', 'x @ y'][1 + p_partkey % 8] AS s FROM part),
f AS (SELECT p_partkey, list_filter([{tags}], lambda t: t IS NOT NULL) AS t FROM d), g AS (SELECT p_partkey, CASE WHEN len(t) = 0 THEN ['other'] ELSE t END AS family FROM f)
SELECT p_partkey, family, coalesce(list_filter([{order}], lambda o: list_contains(family, o))[1], 'other') AS primary_family FROM g"""


@query("f7_families", _families_sql())
def families(x):
    kinds = ["nn.Linear(x)", "F.softmax(x)", "torch.sum(x)", "Conv2d relu", "plain", "LayerNorm and rope", "SwiGLU MLP", "x @ y"]
    made = F.concat("p_name", F.lit(" "), F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 8).cast("int")))
    return x.part.select("p_partkey", text.families(made).alias("family")).withColumn("primary_family", text.primary_family(F.col("family")))


@query("f4_normal_message", """SELECT event_id, CASE WHEN event_type IN ('numerics', 'pass') THEN event_type ELSE event_type || '|' || right(regexp_replace(props, '[0-9]+', 'N', 'g'), 200) END AS message FROM events""")
def messages(x):
    return x.events.select("event_id", text.normal_message(F.col("event_type"), F.col("props")).alias("message"))


@query("f16_hashes", "SELECT doc_id, left(sha256(text), 12) AS prefix, sha256(lang || chr(0) || source) AS cache_key, CAST(('0x' || left(sha256(source), 12)) AS BIGINT) AS stable FROM documents")
def hashes(x):
    return x.documents.select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("prefix"), text.cache_key(F.col("lang"), F.col("source")).alias("cache_key"), text.stable_int(F.col("source")).alias("stable"))


@query("f3_head_tail", "SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 300) || chr(10) || '...' || chr(10) || right(text, 495) ELSE text END AS short, length(text) / 3.5 AS tokens FROM documents")
def head_tail(x):
    return x.documents.select("doc_id", text.head_tail(F.col("text")).alias("short"), text.token_estimate(F.col("text")).alias("tokens"))


@query("f3_shortened", """WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE length(text) > 1500),
k AS (SELECT *, length(l) AS n, length(l) - 600 AS all_cut, coalesce(sum(CASE WHEN length(l) > 640 THEN length(l) - 600 - 26 - length(CAST(length(l) - 600 AS VARCHAR)) END) OVER (PARTITION BY doc_id ORDER BY length(l) DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM l),
t AS (SELECT *, length(text) - 1500 - given AS excess, 450 + greatest(0, n - (length(text) - 1500 - given) - 640) AS tail FROM k),
s AS (SELECT doc_id, string_agg(CASE WHEN n > 640 AND excess > 0 THEN left(l, 150) || ' ...[' || CAST(n - 150 - tail AS BIGINT) || ' chars truncated]... ' || right(l, CAST(tail AS BIGINT)) ELSE l END, chr(10) ORDER BY i) AS o FROM t GROUP BY 1)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN text WHEN length(o) > 1800 THEN left(o, 750) || chr(10) || '...[truncated]...' || chr(10) || right(o, 750) ELSE o END AS short FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""")
def shortened(x):
    """Whole texts, the longest lines cut in the middle until 1,500 characters are left."""
    return x.documents.select("doc_id", text.shortened(F.col("text")).alias("short"))


@query("p10_failure_lines", """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split('Error: ' || text || chr(10) || 'PASS Error: x', chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '' AND NOT left(s, 6) LIKE '%PASS%' AND (s LIKE '%Error:%' OR s LIKE '%FAIL:%' OR s LIKE '%FAIL --%' OR s LIKE '%Trial %' OR s LIKE '%exceeds tol%' OR s LIKE '%Error %' OR s LIKE '%OutOfResources%' OR s LIKE '%error:%' OR s LIKE '%FATAL%' OR s LIKE '%illegal memory%' OR s LIKE '%WARNING: bench%')) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, left(l[1], 300) AS first FROM l""")
def failure_lines(x):
    found = text.failure_lines(F.concat(F.lit("Error: "), "text", F.lit("\nPASS Error: x")))
    return x.documents.select("doc_id", found.alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.get("l", F.lit(0)).alias("first"))


@query("u6_url_hosts", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1)) AS n FROM pages")
def hosts(x):
    p = x.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return p.join(p.groupBy("host").agg(F.count("*").alias("n")), "host").select("page_id", "host", "n")


@query("f9_chat_messages", """WITH d AS (SELECT doc_id, lang, text, length(text) - length(replace(text, chr(10), '')) AS n, toxic = 1 AS fixed FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT *, CASE WHEN fixed THEN 'Fixed Triton ' ELSE 'Triton ' END || lang || CASE WHEN n > 0 THEN ' (' || n || ' @triton.jit kernel' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ')' ELSE '' END || CASE WHEN fixed THEN ' for the bench failure above' ELSE '' END || '; full file with ModelNew below.' AS lead FROM d),
m AS (SELECT doc_id, 'system: be brief' || chr(10) || 'user: ' || lang AS head, coalesce(lead, '') AS lead, text, fixed FROM l)
SELECT doc_id, head || chr(10) || 'assistant: ' || CASE WHEN fixed THEN 'it' || chr(10) || 'user: failed' || chr(10) || 'assistant: ' ELSE '' END || lead || chr(10) || chr(10) || '```python' || chr(10) || regexp_replace(text, '[ \t\n\x0B\f\r]+$', '') || chr(10) || '```' AS rendered,
  CASE WHEN fixed THEN [0, 0, 1, 0, 1] ELSE [0, 0, 1] END AS loss_mask FROM m""".replace("toxic = 1 AS fixed", "coalesce(toxic = 1, false) AS fixed"))
def chat_messages(x):
    """Messages of each document, with a lead-in that counts; a repair shows the failed try and its feedback first.  Only what the assistant says is learned."""
    d = x.documents.join(x.labels.select("doc_id", "toxic"), "doc_id", "left")
    fixed = F.coalesce(F.col("toxic") == 1, F.lit(False))
    lead = text.lead_in(F.col("lang"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), fixed)
    code = F.concat(F.coalesce(lead, F.lit("")), F.lit("\n\n```python\n"), F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+$", ""), F.lit("\n```"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    head = [message("system", F.lit("be brief")), message("user", F.col("lang"))]
    tried = [message("assistant", F.lit("it")), message("user", F.lit("failed"))]
    m = d.select("doc_id", F.when(fixed, F.array(*head, *tried, message("assistant", code))).otherwise(F.array(*head, message("assistant", code))).alias("m"))
    return m.select("doc_id", F.array_join(F.transform("m", lambda e: F.concat(e["role"], F.lit(": "), e["content"])), "\n").alias("rendered"), F.transform("m", lambda e: (e["role"] == "assistant").cast("int")).alias("loss_mask"))


@query("t5_water_fill", """WITH n AS (SELECT source AS g, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT count(*) // 3 AS b FROM documents),
c AS (SELECT max(c) AS c FROM (SELECT c, sum(least(n, c)) AS s FROM n, range(0, (SELECT max(n) + 1 FROM n)) AS r(c) GROUP BY c) WHERE s <= (SELECT b FROM b)),
t AS (SELECT g, n, least(n, c) AS take, row_number() OVER (ORDER BY n DESC, g) AS place, c FROM n, c), rest AS (SELECT (SELECT b FROM b) - sum(take) AS rest FROM t),
q AS (SELECT g, take + CASE WHEN n > c AND place <= rest THEN 1 ELSE 0 END AS quota FROM t, rest)
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('0:' || doc_id)) AS r FROM documents) d JOIN q ON g = source WHERE r <= quota""")
def water_fill(x):
    d = x.documents.select("doc_id", "source")
    return curation.water_fill(d, "source", "doc_id", d.agg(F.floor(F.count("*") / 3).cast("long").alias("budget")))


@query("w2_scan_order_dedup", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY role, sha256(text) ORDER BY conv_id, turn) AS n FROM conversations) SELECT conv_id, turn FROM r WHERE n = 1")
def scan_order(x):
    first = x.conversations.groupBy("role", F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    return first.select("f.conv_id", "f.turn")


@query("j10_lagged_roles", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def lagged(x):
    return x.conversations.select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
