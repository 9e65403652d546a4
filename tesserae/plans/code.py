"""Source texts, logs and feedback: checks, views, renames, categories.  The texts are made from part rows by templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import code, text
from tesserae.plans.registry import query
from tesserae.storage import bounded, cut, shuffle_parts

#: p % 4: 0 launches its kernel, 1 does not, 2 does not parse, 3 calls what is forbidden and launches through an alias.
_BODY = """import triton
import triton.language as tl
from torch._inductor.runtime import helpers, hints  # internals
KJIT = triton.jit

@{jit}
def kernel_{n}(x):
    "doc {n}"
    return tl.load(x) + tl.math.exp(x)  # tl.store

class ModelNew:
    def forward(self, x):
        {call}
        return x{end}
"""
_KINDS = [("triton.jit", "kernel_{n}[(1,)](x)", ""), ("triton.jit", "pass", ""), ("triton.jit", "kernel_{n}[(1,)](x)", " +"), ("KJIT", "kernel_{n}[(1,)](torch.matmul(x, x))", "")]


def parts(x):
    """(p_partkey), dealt to all tasks: a file of millions of keys is a few MB, which one task would read and parse alone."""
    return x.part.select("p_partkey").repartition(shuffle_parts(x.spark), "p_partkey")


def sources(x):
    """(p_partkey, kind, code)."""
    n, kind = (F.col("p_partkey") % 50).cast("string"), F.col("p_partkey") % 4
    made = F.lit(None).cast("string")
    for i, (jit, call, end) in enumerate(_KINDS):
        body = _BODY.replace("{jit}", jit).replace("{call}", call).replace("{end}", end)
        made = F.when(kind == i, F.replace(F.lit(body), F.lit("{n}"), n)).otherwise(made)
    return parts(x).select("p_partkey", kind.alias("kind"), made.alias("code"))


@query("f20_static_check", """SELECT p_partkey, p_partkey % 4 <> 2 AS parses, CASE p_partkey % 4 WHEN 2 THEN [] WHEN 3 THEN [] ELSE ['kernel_' || p_partkey % 50] END AS jit_kernels, CASE WHEN p_partkey % 4 = 0 THEN ['kernel_' || p_partkey % 50] ELSE [] END AS launched,
  p_partkey % 4 <> 2 AS entry_found, CASE WHEN p_partkey % 4 = 3 THEN ['torch.matmul'] ELSE [] END AS forbidden, CASE WHEN p_partkey % 4 = 2 THEN [] ELSE ['tl.load', 'tl.math.exp'] END AS symbols,
  CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['not launched'] WHEN 2 THEN ['syntax'] ELSE ['no kernel', 'forbidden call'] END AS reasons, p_partkey % 4 = 0 AS ok FROM part""")
def static_check(x):
    return sources(x).select("p_partkey", code.static_check(F.col("code"), "ModelNew", ["torch.matmul"]).alias("f")).select("p_partkey", "f.*")


@query("f21_static_check_aliases", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN [] ELSE ['kernel_' || p_partkey % 50] END AS jit_kernels, CASE WHEN p_partkey % 4 IN (0, 3) THEN ['kernel_' || p_partkey % 50] ELSE [] END AS launched,
  CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['not launched'] WHEN 2 THEN ['syntax'] ELSE ['forbidden call'] END AS reasons FROM part""")
def static_check_aliases(x):
    """The second profile: names are followed through imports and assignments."""
    found = code.static_check(F.col("code"), "ModelNew", ["torch.matmul"], follow_aliases=True)
    return sources(x).select("p_partkey", found.alias("f")).select("p_partkey", "f.jit_kernels", "f.launched", "f.reasons")


@query("f19_source_features", """SELECT p_partkey, p_partkey % 4 <> 2 AS parses, CASE WHEN p_partkey % 4 <> 2 THEN 'kernel_' || p_partkey % 50 || ' ' || p_partkey % 4 END AS same, CASE WHEN p_partkey % 4 = 2 THEN [] ELSE ['forward', 'kernel_' || p_partkey % 50] END AS functions FROM part""")
def source_features(x):
    """Equal trees have equal keys: the key is told by the least text that has it."""
    f = sources(x).select("p_partkey", "kind", code.features(F.col("code")).alias("f"))
    f = cut(f.select("p_partkey", "kind", "f.parses", "f.ast_key", "f.functions"))  # for the keys and the join
    kernel = F.concat(F.lit("kernel_"), (F.col("p_partkey") % 50).cast("string"), F.lit(" "), F.col("kind").cast("string"))
    named = f.where("ast_key IS NOT NULL").groupBy("ast_key").agg(F.min(kernel).alias("same"))
    return f.join(bounded(named), "ast_key", "left").select("p_partkey", "parses", "same", "functions")


@query("f22_normal_view", """SELECT p_partkey, CAST(12 AS BIGINT) AS n_lines, CAST(CASE WHEN p_partkey % 4 = 2 THEN 0 ELSE 1 END AS BIGINT) AS n_classes, CAST(CASE WHEN p_partkey % 4 = 2 THEN 0 ELSE 2 END AS BIGINT) AS n_bodies,
  CASE p_partkey % 4 WHEN 2 THEN [] WHEN 3 THEN ['tl.load', 'tl.math.exp', 'torch.matmul'] ELSE ['tl.load', 'tl.math.exp'] END AS calls FROM part""")
def normal_view(x):
    v = sources(x).select("p_partkey", code.normal_view(F.col("code")).alias("v"))
    size = lambda c: F.size(f"v.{c}").cast("long")
    return v.select("p_partkey", size("lines").alias("n_lines"), size("classes").alias("n_classes"), size("bodies").alias("n_bodies"), F.sort_array("v.calls").alias("calls"))


@query("f23_launches", "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS launches, CASE WHEN p_partkey % 4 = 2 THEN 0 ELSE 1 END AS n_kernels, ['helpers', 'hints'] AS internals FROM part")
def launches(x):
    """Whether a kernel is launched, how many there are by pattern of their decorators, and what is imported from internals."""
    s = sources(x)
    checked = s.withColumn("f", code.static_check(F.col("code"), "ModelNew", [], follow_aliases=True))
    # decorators by their own name, or by a name that the source gives them
    alias = F.nullif(F.regexp_extract("code", r"(?m)^(\w+) = triton\.jit$", 1), F.lit(""))
    pattern = F.concat(F.lit(r"(?m)^\s*@(triton\.jit"), F.coalesce(F.concat(F.lit("|"), alias), F.lit("")), F.lit(r")\b"))
    counted = F.regexp_count("code", pattern)
    return checked.select("p_partkey", (F.size("f.launched") > 0).alias("launches"), F.when(F.col("f.parses"), counted).otherwise(0).cast("int").alias("n_kernels"), code.imports_of(F.col("code"), r"torch\._inductor").alias("internals"))


@query("f11_rename", """SELECT p_partkey, 'y = x.old + new("old", old_) # old ' || p_partkey || chr(10) AS code FROM part""")
def rename(x):
    """Names only: not behind a dot, in strings, comments or longer names."""
    made = F.concat(F.lit('old = x.old + old2("old", old_) # old '), F.col("p_partkey").cast("string"), F.lit("\n"))
    return parts(x).select("p_partkey", code.renamed(made, {"old": "y", "old2": "new"}).alias("code"))


@query("f13_likeness", """WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations) SELECT conv_id, turn, (len(l) - 1) / CAST(len(l) AS DOUBLE) AS ratio, ['-' || l[-1], '+' || l[-1] || '!'] AS diff FROM l""")
def likeness(x):
    """Each text and itself with a mark behind it, line by line."""
    return x.conversations.select("conv_id", "turn", code.likeness(F.col("text"), F.concat("text", F.lit("!"))).alias("f")).select("conv_id", "turn", "f.ratio", "f.diff")


@query("p7_format_guard", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'does_not_parse' WHEN p_partkey % 5 = 0 THEN 'holds_fence' ELSE 'kept' END AS reason FROM part""")
def format_guard(x):
    """A target that holds a fence or doesn't parse goes; what can be told without parsing is told first."""
    s = sources(x).withColumn("code", F.when(F.col("p_partkey") % 5 == 0, F.concat("code", F.lit("# ```\n"))).otherwise(F.col("code")))
    return s.select("p_partkey", F.when(~code.parses(F.col("code")), "does_not_parse").when(F.col("code").contains("```"), "holds_fence").otherwise("kept").alias("reason"))


@query("f2_feedback_fields", """SELECT event_id, event_type AS status, value AS speedup, CASE WHEN event_id % 3 = 0 THEN 'nested' ELSE NULL END AS detail FROM events""")
def feedback_fields(x):
    """Fields of a feedback text: a line of its own, or one of a nested payload."""
    status = F.concat(F.lit('{\n  "status": "'), "event_type", F.lit('",\n  "speedup": '), F.col("value").cast("string"), F.lit(","))
    payload = F.when(F.col("event_id") % 3 == 0, F.lit('\n  "result_payload": "{\\"detail\\": \\"nested\\"}"')).otherwise("")
    f = x.events.select("event_id", F.concat(status, payload, F.lit("\n}")).alias("t"))
    return f.select("event_id", text.field(F.col("t"), "status").alias("status"), text.field(F.col("t"), "speedup").try_cast("double").alias("speedup"), text.field(F.col("t"), "detail").alias("detail"))


@query("f14_observation", """SELECT event_id, '{"verdict":"' || CASE WHEN event_type = 'purchase' THEN 'PASS' ELSE 'FAIL' END || '"' || CASE WHEN event_type = 'purchase' THEN ',"user":' || user_id ELSE '' END || '}' || CASE WHEN event_type = 'error' THEN chr(10) || 'Failures:' || chr(10) || 'Error: ' || event_id ELSE '' END || chr(10) || 'tail: ' || right(props, 5) AS observation FROM events""")
def observation(x):
    """What a turn is told: fields that have a value, failures where there are any, and the end of the log."""
    passed = F.col("event_type") == "purchase"
    fields = F.to_json(F.struct(F.when(passed, "PASS").otherwise("FAIL").alias("verdict"), F.when(passed, F.col("user_id")).alias("user")))
    found = text.failure_lines(F.when(F.col("event_type") == "error", F.concat(F.lit("ok\n  Error: "), F.col("event_id").cast("string"))).otherwise("ok"))
    failures = F.when(F.size(found) > 0, F.concat(F.lit("Failures:\n"), F.array_join(found, "\n")))
    return x.events.select("event_id", F.concat_ws("\n", fields, failures, F.concat(F.lit("tail: "), F.right("props", F.lit(5)))).alias("observation"))


@query("f18_exceptions", """SELECT doc_id, CASE WHEN length(text) > 900 THEN left(text, 300) || ' [...] ' || right(text, 600) ELSE text END AS message, CASE doc_id % 4 WHEN 0 THEN 'triton_compile' WHEN 1 THEN 'triton_compile' WHEN 2 THEN 'triton_runtime' ELSE 'python' END AS place FROM documents""")
def exceptions(x):
    traces = ["x/triton/compiler/a.py", "x/triton/language/b.py", "x/triton/runtime/c.py", "main.py"]
    trace = F.get(F.array(*[F.lit(p) for p in traces]), (F.col("doc_id") % 4).cast("int"))
    return x.documents.select("doc_id", text.exception_text(F.col("text")).alias("message"), text.exception_place(trace).alias("place"))
