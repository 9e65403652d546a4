"""Second versions of rules over real rows: logs and sources are documents' texts in which some words stand for marks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import scores, stats, text
from tesserae.operators import poison
from tesserae.operators import trajectories as t
from tesserae.operators.selection import percentiles
from tesserae.plans.evaluation import TURNS_SQL, turns
from tesserae.plans.registry import query
from tesserae.storage import cut

#: Words of the texts and the marks that they become, so that real texts hold marks in any number and order.
LOG_MARKS = [
    ("ofan", "OutOfResources"), ("inthe", "Triton "), ("thew", "Error:"), ("eron", "exceeds tol"), ("atth", "NaN"), ("enin", "SyntaxError"), ("whou", "AttributeError"),
    ("reand", "illegal memory"), ("heof", "Traceback"), ("stnd", "instantiation failed"), ("lyti", "CompilationError"), ("haan", "EXC "), ("tior", "TIMEOUT"), ("ndat", "no ```python"),
]
SOURCE_MARKS = [("the ", "nn.Linear( "), ("tion", "relu"), ("ing.", " # softmax"), ("and ", "MLP "), ("hean", "x @ y"), ("ofer", "torch.sum("), ("inat", "'''"), ("esth", '"""'), ("riti", "conv2d"), ("onst", "rms_norm"), ("eaof", "Attention")]


def marked(column, marks):
    for word, mark in marks:
        column = F.replace(column, F.lit(word), F.lit(mark))
    return column


def marked_sql(column: str, marks) -> str:
    for word, mark in marks:
        quoted = mark.replace("'", "''")
        column = f"replace({column}, '{word}', '{quoted}')"
    return column


#: A short log of each document: its first lines, with marks.
LINES_SQL = "array_to_string(string_split(text, chr(10))[1:1 + doc_id % 3], chr(10))"
LOG_SQL = f"l AS (SELECT doc_id, quality, toxic, {marked_sql(LINES_SQL, LOG_MARKS)} AS log FROM documents LEFT JOIN labels USING (doc_id))"


def logs(x):
    lines = F.slice(F.split("text", "\n"), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))
    return x.documents.join(x.labels, "doc_id", "left").select("doc_id", "quality", "toxic", marked(F.array_join(lines, "\n"), LOG_MARKS).alias("log"))


@query("f5_failure_category", f"""WITH {LOG_SQL}, v AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'PASS' WHEN toxic = 1 THEN 'TIMEOUT' ELSE 'FAIL' END AS verdict, log, lower(log) AS low, length(log) % 5 = 0 AS smoke, length(log) % 7 = 0 AS stability FROM l)
SELECT doc_id, CASE WHEN verdict = 'PASS' THEN NULL WHEN contains(log, 'no ```python') THEN 'no code block' WHEN verdict = 'TIMEOUT' THEN 'timeout' WHEN contains(log, 'instantiation failed') THEN 'wrong ModelNew signature'
  WHEN contains(log, 'OutOfResources') OR contains(log, 'shared memory') THEN 'out of shared memory' WHEN contains(log, 'CompilationError') OR (contains(low, 'triton') AND contains(log, 'Error')) THEN 'Triton API / compile error'
  WHEN contains(log, 'exceeds tol') OR contains(log, 'max_abs_error') THEN 'numerical mismatch' WHEN contains(log, 'numerical_stability') OR contains(low, 'nan') OR stability THEN 'numerical stability' WHEN smoke THEN 'smoke test mismatch'
  WHEN contains(log, 'SyntaxError') OR contains(log, 'IndentationError') THEN 'syntax error' WHEN contains(log, 'AttributeError') OR contains(log, 'NameError') OR contains(log, 'ImportError') THEN 'API/name error'
  WHEN contains(low, 'illegal memory') OR contains(log, 'CUDA error') THEN 'illegal memory access' ELSE 'other FAIL/CRASH' END AS category FROM v""")
def failure_category(x):
    verdict = F.when(F.col("quality") == 1, "PASS").when(F.col("toxic") == 1, "TIMEOUT").otherwise("FAIL")
    failed = lambda n: F.when(F.length("log") % n == 0, "FAIL: 1").otherwise("PASS")
    return logs(x).select("doc_id", text.failure_category(verdict, F.col("log"), failed(5), failed(7)).alias("category"))


@query("f6_outcome_category", f"""WITH {LOG_SQL}, v AS (SELECT doc_id, CASE length(log) % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'INFRA_ERROR' WHEN 3 THEN 'CRASH' ELSE 'FAIL' END AS verdict, CASE WHEN toxic = 1 THEN 'import: ' || log ELSE log END AS why,
  log, CASE WHEN contains(log, 'EXC ') THEN regexp_extract(log, '(CompilationError|OutOfResources|SyntaxError)', 1) ELSE '' END AS raised, CASE WHEN contains(log, 'Traceback') THEN 'triton_compile' ELSE '' END AS place, CASE WHEN length(log) % 29 = 0 THEN ' ' ELSE log END AS code FROM l)
SELECT doc_id, CASE WHEN trim(code, ' ') = '' THEN 'format' WHEN verdict = 'PASS' THEN 'pass' WHEN verdict = 'TIMEOUT' OR contains(log, 'TIMEOUT') THEN 'timeout' WHEN verdict = 'INFRA_ERROR' THEN 'infra'
  WHEN verdict = 'CRASH' THEN CASE WHEN starts_with(why, 'import:') THEN 'python' WHEN raised = 'OutOfResources' OR contains(why, 'OutOfResources') THEN 'runtime_resources' WHEN contains(why, 'illegal memory') THEN 'runtime' WHEN raised = 'CompilationError' OR place = 'triton_compile' THEN 'compile' ELSE 'python' END
  WHEN contains(log, 'EXC ') THEN CASE WHEN contains(log, 'OutOfResources') THEN 'runtime_resources' WHEN contains(log, 'CompilationError') THEN 'compile' WHEN contains(log, 'illegal memory') THEN 'runtime' ELSE 'python' END ELSE 'numerics' END AS category FROM v""")
def outcome_category(x):
    n, log = F.length("log"), F.col("log")
    verdict = F.when(n % 6 == 0, "PASS").when(n % 6 == 1, "TIMEOUT").when(n % 6 == 2, "INFRA_ERROR").when(n % 6 == 3, "CRASH").otherwise("FAIL")
    why = F.when(F.col("toxic") == 1, F.concat(F.lit("import: "), log)).otherwise(log)
    raised = F.when(log.contains("EXC "), F.regexp_extract(log, "(CompilationError|OutOfResources|SyntaxError)", 1))
    place = F.when(log.contains("Traceback"), "triton_compile")
    return logs(x).select("doc_id", text.outcome_category(F.when(n % 29 == 0, " ").otherwise(log), verdict, why, log, raised, place).alias("category"))


@query("f36_kernel_bench_verdict", f"""WITH {LOG_SQL}, v AS (SELECT doc_id, log, CASE quality WHEN 1 THEN 'PASS' WHEN 0 THEN 'FAIL' END AS reported FROM l)
SELECT doc_id, CASE WHEN contains(log, 'TIMEOUT') THEN 'TIMEOUT' WHEN reported = 'PASS' THEN 'PASS' WHEN (contains(log, 'Traceback') AND reported IS NULL) OR contains(log, 'instantiation failed') OR contains(log, 'SyntaxError') THEN 'CRASH' ELSE 'FAIL' END AS verdict FROM v""")
def kernel_bench(x):
    reported = F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "FAIL")
    return logs(x).select("doc_id", scores.kernel_bench_verdict(reported, F.col("log"), F.col("log").contains("TIMEOUT")).alias("verdict"))


def _source_families_sql() -> str:
    tags = ", ".join("CASE WHEN regexp_matches(s, '" + p.replace("'", "''") + f"') THEN '{name}' END" for name, p in text.SECOND_PATTERNS)
    # one pattern for both kinds of quotes, as far as they close; a single pass, as the first to open decides
    plain = "regexp_replace(regexp_replace(s, '(?s)(?:\"\"\".*?\"\"\"|''''''.*?'''''')', '', 'g'), '#[^\\n]*', '', 'g')"
    return f"""WITH d AS (SELECT doc_id, {marked_sql('text', SOURCE_MARKS)} AS s FROM documents), p AS (SELECT doc_id, {plain} AS s FROM d),
f AS (SELECT doc_id, s, list_filter([{tags}], lambda t: t IS NOT NULL) AS t FROM p),
g AS (SELECT doc_id, CASE WHEN regexp_matches(s, '{text.MLP_NAME}') OR (len(regexp_extract_all(s, '{text.LINEAR_CALL}')) >= 2 AND list_contains(t, 'activation')) THEN list_append(t, 'mlp') ELSE t END AS t FROM f)
SELECT doc_id, CASE WHEN len(t) = 0 THEN ['other'] ELSE t END AS family FROM g"""


@query("f7_source_families", _source_families_sql())
def source_families(x):
    """The second table over sources without comments, with the rule for an mlp of two linear layers."""
    return x.documents.select("doc_id", text.source_families(marked(F.col("text"), SOURCE_MARKS)).alias("family"))


@query("j1_recomputed", """WITH r AS (SELECT doc_id, quality, 'file' AS origin FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL UNION ALL
SELECT doc_id, CASE WHEN len(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) >= 50 AND NOT contains(text, '```') THEN 1 ELSE 0 END, 'inline' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL))
SELECT doc_id, CAST(quality AS INTEGER) AS quality, origin, sum(CASE WHEN origin = 'inline' THEN 1 ELSE 0 END) OVER () AS n_inline FROM r""")
def recomputed(x):
    """A verdict from the file, or one that is computed from the text for those that the file lacks only; and how many these were."""
    known = x.labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    told = x.documents.select("doc_id").join(known, "doc_id").withColumn("origin", F.lit("file"))
    words = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)))
    missed = x.documents.join(known, "doc_id", "left_anti")
    inline = missed.select("doc_id", F.when((words >= 50) & ~F.col("text").contains("```"), 1).otherwise(0).cast("int").alias("quality"), F.lit("inline").alias("origin"))
    found = cut(told.unionByName(inline))
    return found.crossJoin(F.broadcast(found.agg(F.count_if(F.col("origin") == "inline").alias("n_inline"))))  # one row


@query("a29_old_verdicts", """WITH o AS (SELECT l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY 1),
k AS (SELECT p_partkey, p_type AS kind, CASE WHEN p_type = 'PROMO' THEN '' WHEN p_size < 20 THEN 'PASS' WHEN p_size < 35 THEN 'PASS (tol 1e-2)' ELSE 'FAIL' END AS expected, r, f, p_brand FROM part LEFT JOIN o ON p_partkey = l_partkey),
a AS (SELECT p_partkey, expected, CASE WHEN r = 1 THEN 'PASS' WHEN r = 0 THEN 'FAIL' END AS observed,
  CASE WHEN kind = 'ECONOMY' THEN coalesce(CASE WHEN f = 1 THEN 'PASS' WHEN f = 0 THEN 'FAIL' END, '-') WHEN kind = 'STANDARD' THEN 'PASS (is the reference)' ELSE coalesce(CASE WHEN f = 0 THEN 'FAIL' END, CASE p_brand WHEN 'Brand#11' THEN 'FAIL' WHEN 'Brand#12' THEN 'PASS' END, '-') END AS old FROM k),
b AS (SELECT *, CASE WHEN expected IN ('PASS', 'FAIL') THEN coalesce(observed = expected, false) WHEN starts_with(expected, 'PASS (tol') THEN coalesce(observed = 'PASS', false) END AS agree FROM a)
SELECT *, bool_and(agree IS DISTINCT FROM false) OVER () AS all_ok FROM b""")
def old_verdicts(x):
    """Expected, observed and old verdicts.  The old one by precedence: a table for starters, a fixed text for references, else what the run told, else what is known, else a dash."""
    o = x.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.col("l_returnflag") == "R").alias("r"), F.max(F.col("l_linestatus") == "F").alias("f"))
    k = x.part.join(o, "p_partkey", "left")
    expected = F.when(F.col("p_type") == "PROMO", "").when(F.col("p_size") < 20, "PASS").when(F.col("p_size") < 35, "PASS (tol 1e-2)").otherwise("FAIL")
    observed, told = F.when(F.col("r"), "PASS").when(~F.col("r"), "FAIL"), F.when(F.col("f"), "PASS").when(~F.col("f"), "FAIL")
    known = F.when(F.col("p_brand") == "Brand#11", "FAIL").when(F.col("p_brand") == "Brand#12", "PASS")
    old = F.when(F.col("p_type") == "ECONOMY", F.coalesce(told, F.lit("-"))).when(F.col("p_type") == "STANDARD", "PASS (is the reference)").otherwise(F.coalesce(F.when(~F.col("f"), "FAIL"), known, F.lit("-")))
    a = k.select("p_partkey", expected.alias("expected"), observed.alias("observed"), old.alias("old"))
    agree = F.when(F.col("expected").isin("PASS", "FAIL"), F.coalesce(F.col("observed") == F.col("expected"), F.lit(False))).when(F.col("expected").startswith("PASS (tol"), F.coalesce(F.col("observed") == "PASS", F.lit(False)))
    a = cut(a.withColumn("agree", agree))
    return a.crossJoin(F.broadcast(a.agg(F.min(stats.not_false(F.col("agree"))).alias("all_ok"))))  # one row


#: Rounds: a user's day; its code is what the event holds, missing for sign-ups; results of clicks aren't known.
ROUNDS_SQL = """r AS (SELECT event_id, user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS traj_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS turn,
  CASE WHEN event_type = 'signup' THEN NULL ELSE json_extract_string(props, '$.k') END AS code, event_type <> 'click' AS known, event_type IN ('purchase', 'view') AS good, value / 250 AS speedup FROM events)"""


def rounds(x):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    kind = F.col("event_type")
    return x.events.select(
        "event_id", F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("traj_id"), (F.row_number().over(w) - 1).alias("turn"),
        F.when(kind != "signup", F.get_json_object("props", "$.k")).alias("code"), (kind != "click").alias("known"), kind.isin("purchase", "view").alias("good"), (F.col("value") / 250).alias("speedup"),
    )


@query("m10_neighbour_pairs", f"""WITH {ROUNDS_SQL}, p AS (SELECT *, lead(turn) OVER w AS t1, lead(known) OVER w AS k1, lead(good) OVER w AS g1, lead(speedup) OVER w AS s1, lead(code) OVER w AS c1 FROM r WINDOW w AS (PARTITION BY traj_id ORDER BY turn))
SELECT event_id, CASE WHEN good AND speedup >= 1.0 THEN 'turn_not_failed' WHEN NOT coalesce(k1, false) THEN 'next_result_unknown' WHEN NOT g1 THEN 'next_not_better' WHEN good AND NOT s1 > speedup THEN 'next_not_faster'
  WHEN code IS NULL THEN 'failed_turn_no_code' WHEN c1 IS NULL THEN 'next_no_code' WHEN trim(code) = trim(c1) THEN 'identical_code' END AS skipped, CASE WHEN good THEN 'slow_to_faster' ELSE 'incorrect_to_correct' END AS kind FROM p WHERE t1 IS NOT NULL""")
def neighbour_pairs(x):
    """Neighbouring rounds of which the second repairs the first, and the first of seven reasons why others don't."""
    return t.neighbour_repairs(rounds(x), 1.0).select("event_id", "skipped", "kind")


@query("m10_later_pass", f"""WITH {ROUNDS_SQL}, g AS (SELECT DISTINCT code FROM r WHERE code IS NOT NULL AND good AND speedup > 1.0), m AS (SELECT r.*, g.code IS NOT NULL AS passing FROM r LEFT JOIN g USING (code)),
n AS (SELECT *, min(CASE WHEN passing THEN turn END) OVER (PARTITION BY traj_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM m),
f AS (SELECT n.event_id, n.code, n.passing, n.j, b.code AS target FROM n LEFT JOIN n b ON b.traj_id = n.traj_id AND b.turn = n.j WHERE NOT n.good),
k AS (SELECT *, CASE WHEN j IS NULL THEN 'no_later_pass' WHEN code IS NULL THEN 'failed_no_code' WHEN passing THEN 'failed_code_is_pass' WHEN target = '0' THEN 'target_is_starter' WHEN code = target THEN 'failed_same_as_target' END AS reason FROM f)
SELECT event_id, target, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason, code, target ORDER BY event_id) > 1 AND reason IS NULL THEN 'duplicate_pair' END) AS reason FROM k""")
def later_pass(x):
    """Each failing round with the first later one of its trajectory whose code is known to pass, and why a pair is dropped; of equal pairs the first stays."""
    r = rounds(x)
    passing = r.where(F.col("good") & (F.col("speedup") > 1.0) & F.col("code").isNotNull()).select("code").distinct().withColumn("passing", F.lit(True))
    marked = r.join(passing, "code", "left").withColumn("passing", F.coalesce("passing", F.lit(False)))
    return t.later_repairs(marked, "event_id", "0")


#: Runs of an evaluation: c stands alone; b covers some problems only, and replaces those of a.
RUNS_SQL = f"""{TURNS_SQL}, raw AS (SELECT traj_id, task_id, turn, verdict, speedup, message, CASE WHEN CAST(right(traj_id, 2) AS INTEGER) > 20 THEN 'c' WHEN CAST(right(traj_id, 2) AS INTEGER) > 10 AND task_id < 12 THEN 'b' ELSE 'a' END AS part FROM turns),
covered AS (SELECT DISTINCT task_id FROM raw WHERE part = 'b'), runs AS (SELECT *, CASE WHEN part = 'c' THEN 'c' ELSE 'a+b' END AS run, ['softmax', 'matmul', 'reduce'][1 + task_id % 3] AS family FROM raw WHERE part <> 'a' OR task_id NOT IN (SELECT task_id FROM covered)),
x AS (SELECT *, verdict = 'PASS' AS passed, verdict = 'PASS' AND abs(speedup - 1) >= 0.05 AS solved, verdict = 'PASS' AND abs(speedup - 1) >= 0.05 AND speedup > 1.05 AND speedup * 0.9 > 1.0 AS beat FROM runs),
y AS (SELECT *, lead(verdict) OVER w AS v1, lead(message) OVER w AS m1, lead(solved) OVER w AS s1 FROM x WINDOW w AS (PARTITION BY traj_id ORDER BY turn)),
e AS (SELECT run, family, task_id, traj_id, bool_or(passed) AS passed, bool_or(solved) AS solved, bool_or(beat) AS beat, bool_or(solved AND turn = 0) AS solved0, count(*) AS n, count(*) FILTER (verdict = 'CRASH') AS crashed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (solved) AS n_solved,
  count(*) FILTER (passed AND NOT solved) AS starters, count(*) FILTER (NOT passed AND v1 <> 'PASS') AS pairs, count(*) FILTER (NOT passed AND v1 <> 'PASS' AND verdict = v1 AND message = m1) AS same, count(*) FILTER (NOT passed AND v1 IS NOT NULL) AS fail_next, count(*) FILTER (NOT passed AND s1) AS fail_solved, max(CASE WHEN solved THEN speedup END) AS best FROM y GROUP BY ALL)"""


def _report_sql(scope: str) -> str:
    return f"""SELECT {scope} AS scope, count(DISTINCT task_id) AS problems, CAST(sum(episodes) AS BIGINT) AS episodes, CAST(sum(turns) AS BIGINT) AS turns, avg(p1) AS pass_1, avg(pn) AS pass_n, avg(t1) AS pass_1_first, avg(tn) AS pass_n_first, avg(a1) AS pass_1_any, avg(an) AS pass_n_any, avg(b1) AS beat_1, avg(bn) AS beat_n,
  sum(crashed) / CAST(sum(turns) AS DOUBLE) AS crash_rate, sum(crashed) / CAST(greatest(1, sum(failed)) AS DOUBLE) AS crash_share, CAST(sum(starters) AS BIGINT) AS starter_turns, sum(same) / CAST(greatest(1, sum(pairs)) AS DOUBLE) AS repeat_rate, CAST(sum(pairs) AS BIGINT) AS fail_pairs,
  sum(fail_solved) / CAST(greatest(1, sum(fail_next)) AS DOUBLE) AS solved_after_fail, CAST(sum(solved) AS BIGINT) AS solving_episodes, CAST(sum(n_solved) AS BIGINT) AS solving_turns, CAST(sum(pn) AS BIGINT) AS problems_solved, any_value(geomean) AS geomean, any_value(median) AS median
FROM (SELECT {scope} AS scope, task_id, count(*) AS episodes, sum(n) AS turns, avg(CAST(solved AS INT)) AS p1, max(CAST(solved AS INT)) AS pn, avg(CAST(solved0 AS INT)) AS t1, max(CAST(solved0 AS INT)) AS tn, avg(CAST(passed AS INT)) AS a1, max(CAST(passed AS INT)) AS an, avg(CAST(beat AS INT)) AS b1, max(CAST(beat AS INT)) AS bn,
  sum(crashed) AS crashed, sum(failed) AS failed, sum(starters) AS starters, sum(same) AS same, sum(pairs) AS pairs, sum(fail_solved) AS fail_solved, sum(fail_next) AS fail_next, sum(CAST(solved AS INT)) AS solved, sum(n_solved) AS n_solved FROM e GROUP BY 1, 2) k
JOIN (SELECT {scope} AS scope, exp(avg(ln(best))) AS geomean, quantile_cont(best, 0.5) AS median FROM e GROUP BY 1) s ON s.scope = k.scope GROUP BY 1""".replace(f"SELECT {scope} AS scope, count(DISTINCT", "SELECT k.scope AS scope, count(DISTINCT")


@query("m5_report", f"WITH {RUNS_SQL} " + " UNION ALL ".join(_report_sql(s) for s in ("'all'", "'run ' || run", "'family ' || family")))
def report(x):
    """One row for the whole evaluation, each run and each family of problems; a run "a+b" takes the problems that b covers from b alone."""
    day = F.right("traj_id", F.lit(2)).cast("int")
    raw = turns(x).withColumn("part", F.when(day > 20, "c").when((day > 10) & (F.col("task_id") < 12), "b").otherwise("a"))
    raw = raw.withColumn("family", F.get(F.array(*[F.lit(f) for f in ("softmax", "matmul", "reduce")]), (F.col("task_id") % 3).cast("int")))
    raw = cut(raw.withColumn("is_starter", F.abs(F.col("speedup") - 1) < 0.05).withColumn("low", F.col("speedup") * 0.9))
    merged = t.overridden(raw.where("part <> 'c'"), "part", "a", "b").withColumn("run", F.lit("a+b")).unionByName(raw.where("part = 'c'").withColumn("run", F.lit("c")))
    each = cut(t.judged_episodes(merged, ["run", "family"]))
    out = None
    for scope in (F.lit("all"), F.concat(F.lit("run "), "run"), F.concat(F.lit("family "), "family")):
        own = each.withColumn("scope", scope)
        middle = percentiles(own, ["scope"], "best", {"median": 0.5}).drop("n")
        found = t.report(own, "scope").join(middle, "scope", "left")
        out = found if out is None else out.unionByName(found)
    return out


@query("r7_stopped", """WITH c AS (SELECT conv_id, turn, role, length(text) / 3.5 AS tokens FROM conversations), s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT conv_id, count(*) FILTER (turn < 6 AND before + 2 * 100 <= 700) AS n_kept, count(*) AS n_turns, CASE WHEN bool_and(turn < 6 AND before + 2 * 100 <= 700) THEN 'ended' WHEN bool_or(turn < 6 AND before + 2 * 100 > 700) THEN 'context' ELSE 'turns' END AS stopped_by FROM s GROUP BY 1""")
def stopped(x):
    """How far each dialogue goes until its turns or its context run out, of which two more answers must fit."""
    c = x.conversations.select(F.col("conv_id").alias("traj_id"), "turn", text.token_estimate(F.col("text")).alias("tokens"))
    return t.stopped(c, 6, 100, 700).withColumnRenamed("traj_id", "conv_id")


@query("f37_token_mask", """WITH w AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n FROM conversations), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM w)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS n_learned, coalesce(list(start || '+' || n ORDER BY turn) FILTER (role = 'assistant'), []) AS spans, CAST(coalesce(sum(CASE WHEN turn = last THEN n END), 0) AS BIGINT) AS n_last FROM s GROUP BY 1""")
def token_mask(x):
    """Which words of a dialogue are learned: of every assistant turn, as spans, or of the last one only."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), 0))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    s = x.conversations.select("conv_id", "turn", (F.col("role") == "assistant").alias("own"), words.cast("long").alias("n"))
    s = s.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
    span = F.struct("turn", F.concat(F.col("start").cast("string"), F.lit("+"), F.col("n").cast("string")).alias("span"))
    by = s.groupBy("conv_id").agg(F.sum("n").alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("own"), F.col("n"))), F.lit(0)).alias("n_learned"), F.sort_array(F.collect_list(F.when(F.col("own"), span))).alias("s"), F.coalesce(F.max_by("n", F.when(F.col("own"), F.col("turn"))), F.lit(0)).alias("n_last"))
    return by.select("conv_id", "n_tokens", "n_learned", F.transform("s", lambda e: e["span"]).alias("spans"), "n_last")


def _measured(rows: list[dict]) -> list[dict]:
    """A batch of measurements; one bad row breaks it, as a dying worker would."""
    out = []
    for r in rows:
        k = int(r["props"].partition('"k": ')[2].rstrip("}"))
        if r["event_type"] == "error":
            raise RuntimeError(f"lost at {r['event_id']}")
        out.append({"per_k": r["value"] / k})  # fails where k is 0
    return out


@query("r6_poison_rows", """WITH e AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type = 'error' AS lost FROM events)
SELECT event_id, CASE WHEN NOT lost AND k <> 0 THEN value / k END AS per_k, CASE WHEN lost THEN 'RuntimeError: lost at ' || event_id WHEN k = 0 THEN 'ZeroDivisionError: division by zero' END AS error,
  (SELECT count(*) FROM e WHERE lost) AS n_lost, (SELECT count(*) FROM e WHERE NOT lost AND k = 0) AS n_divided FROM e""")
def poison_rows(x):
    """Every row's result or error; a row that raises costs no other row its result."""
    rows = x.events.select("event_id", "event_type", "value", "props")
    found = poison.guarded(rows, ["event_id"], _measured, "per_k double")
    counts = poison.errors_by_kind(found).groupBy().pivot("kind", ["RuntimeError", "ZeroDivisionError"]).agg(F.sum("n"))
    counts = counts.select(F.coalesce("RuntimeError", F.lit(0)).alias("n_lost"), F.coalesce("ZeroDivisionError", F.lit(0)).alias("n_divided"))
    return found.select("event_id", "per_k", F.replace("error", F.lit("float division"), F.lit("division")).alias("error")).crossJoin(F.broadcast(counts))  # one row
