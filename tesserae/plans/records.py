"""Filters with their accounting, summaries of runs, priorities and reports of rescoring, over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import scores, stats
from tesserae.operators import trajectories as t
from tesserae.operators.bootstrap import intervals, weight_sql
from tesserae.operators.ranks import numbered
from tesserae.operators.selection import percentiles
from tesserae.plans.evaluation import EPISODES_SQL, TURNS_SQL, rewards, turns
from tesserae.plans.registry import query
from tesserae.storage import bounded, cut

LABELLED_SQL = "d AS (SELECT doc_id, lang, source, n_chars, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def labelled(x):
    return x.documents.join(x.labels, "doc_id", "left")


@query("p1_whitelist", f"WITH {LABELLED_SQL} SELECT doc_id, lang, list_filter([CASE WHEN quality IS NOT NULL THEN 'quality=' || quality END, CASE WHEN toxic IS NOT NULL THEN 'toxic=' || toxic END], lambda v: v IS NOT NULL) AS meta FROM d")
def whitelist(x):
    """Fixed columns, and of the others those that have a value."""
    meta = F.map_filter(F.create_map(*[v for n in ("quality", "toxic") for v in (F.lit(n), F.col(n).cast("string"))]), lambda k, v: v.isNotNull())
    return labelled(x).select("doc_id", "lang", F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("meta"))


@query("p2_nested_flag", f"WITH {LABELLED_SQL} SELECT doc_id, coalesce(quality = 1, false) AS passed FROM d WHERE (toxic = 0) IS DISTINCT FROM false")
def nested_flag(x):
    """An unknown flag is not false: only explicit failures go."""
    nested = labelled(x).select("doc_id", F.struct((F.col("toxic") == 0).alias("ok")).alias("static"), F.struct(F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict")).alias("verify"))
    return nested.where(stats.not_false(F.col("static.ok"))).select("doc_id", (F.col("verify.verdict") == "PASS").alias("passed"))


@query("p3_arrays_overlap", "SELECT user_id FROM events GROUP BY 1 HAVING list_has_any(list(DISTINCT event_type), ['purchase', 'error'])")
def overlap(x):
    return x.events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds")).where(F.arrays_overlap("kinds", F.array(F.lit("purchase"), F.lit("error")))).select("user_id")


@query("p4_substring_exclude", "SELECT doc_id FROM documents WHERE NOT contains(text, 'http')")
def exclude(x):
    return x.documents.where(~F.col("text").contains("http")).select("doc_id")


@query("p5_drop_accounting", """WITH r AS (SELECT CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice / l_quantity / 1000 / l_discount / 10 END AS v FROM lineitem)
SELECT CASE WHEN NOT isfinite(v) THEN 'non_finite' WHEN v < 1.0 THEN 'below' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def drop_accounting(x):
    v = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") / F.col("l_quantity") / 1000 / F.col("l_discount") / 10)
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    return x.lineitem.select(v.alias("v")).groupBy(F.when(bad, "non_finite").when(F.col("v") < 1.0, "below").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@query("p6_is_good", f"WITH {LABELLED_SQL} SELECT doc_id, coalesce(quality = 1, false) AND (toxic = 1) IS DISTINCT FROM true AND n_chars > 0 AS good FROM d")
def is_good(x):
    """Known to be right, not known to be a decoy, and measured."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) & ~(F.col("toxic") == 1).eqNullSafe(True) & (F.col("n_chars") > 0)
    return labelled(x).select("doc_id", good.alias("good"))


@query("p8_outcome_fold", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'view' THEN 'FAIL' ELSE 'CRASH' END AS outcome FROM events")
def outcome_fold(x):
    told = F.when(F.col("event_type") == "purchase", "PASS").when(F.col("event_type") == "view", "FAIL").otherwise(F.upper("event_type"))
    return x.events.select("event_id", told.alias("told")).select("event_id", F.when(F.col("told").isin("PASS", "FAIL"), F.col("told")).otherwise("CRASH").alias("outcome"))


@query("p9_symbol_allowlist", """WITH s AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS s FROM part), a AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS s FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, list_sort(list_filter(list(DISTINCT CASE WHEN s NOT IN (SELECT s FROM a) THEN s END), lambda v: v IS NOT NULL)) AS unknown FROM s GROUP BY 1""")
def symbol_allowlist(x):
    """Words of a name that an allow list lacks."""
    symbols = x.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("s"))
    allowed = x.part.where("p_partkey % 3 = 0").select(F.get(F.split("p_name", " "), F.lit(1)).alias("s")).distinct()
    unknown = symbols.join(bounded(allowed), "s", "left_anti").groupBy("p_partkey").agg(F.sort_array(F.collect_set("s")).alias("unknown"))
    return x.part.select("p_partkey").join(unknown, "p_partkey", "left").select("p_partkey", F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))


@query("p11_share_columns", "SELECT lang, avg(CASE WHEN source IN ('src0', 'src1') THEN 1.0 ELSE 0.0 END) AS core_share, avg(CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 1.0 ELSE 0.0 END) AS generic_share FROM documents GROUP BY 1")
def share_columns(x):
    return x.documents.groupBy("lang").agg(stats.share(F.col("source").isin("src0", "src1")).alias("core_share"), stats.share(~F.col("source").isin("src0", "src1", "src2")).alias("generic_share"))


BENCH_SQL = "r AS (SELECT l_returnflag AS gpu, l_linestatus AS kernel, l_orderkey AS ord, l_linenumber AS line, l_quantity AS speedup, l_extendedprice AS wall, CASE WHEN l_linenumber = 1 THEN 'full' ELSE 'quick' END AS mode, CASE WHEN l_discount < 0.08 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM lineitem)"


def bench_rows(x):
    return x.lineitem.select(
        F.col("l_returnflag").alias("gpu"), F.col("l_linestatus").alias("kernel"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("speedup"),
        F.col("l_extendedprice").alias("wall"), F.when(F.col("l_linenumber") == 1, "full").otherwise("quick").alias("mode"), F.when(F.col("l_discount") < 0.08, "PASS").otherwise("FAIL").alias("verdict"),
    )


@query("a22_baseline_matrix", f"""WITH {BENCH_SQL}, g AS (SELECT gpu, kernel, avg(speedup) FILTER (mode = 'quick') AS mean, 100 * stddev_pop(speedup) FILTER (mode = 'quick') / avg(speedup) FILTER (mode = 'quick') AS cv,
  count(*) FILTER (verdict = 'PASS') AS n_pass, count(*) AS n, arg_min(verdict, struct_pack(o := ord, w := wall)) FILTER (mode = 'full') AS full_verdict, quantile_cont(wall, 0.5) AS p50, quantile_cont(wall, 0.95) AS p95,
  bool_or(mode = 'quick' AND verdict = 'PASS') AND NOT bool_or(mode = 'full' AND verdict = 'PASS' AND ord % 2 = 0) AS quick_only FROM r GROUP BY 1, 2) SELECT *, max(cv) OVER () AS max_cv FROM g""")
def baseline_matrix(x):
    """Per device and kernel: quick repeats, the first full verdict, passes, times; and the greatest deviation of all."""
    quick, full, passed = F.col("mode") == "quick", F.col("mode") == "full", F.col("verdict") == "PASS"
    q = F.when(quick, F.col("speedup"))
    rows = bench_rows(x)
    g = rows.groupBy("gpu", "kernel").agg(
        F.avg(q).alias("mean"), (100 * F.stddev_pop(q) / F.avg(q)).alias("cv"), F.count_if(passed).alias("n_pass"), F.count("*").alias("n"),
        F.min(F.when(full, F.struct("ord", "wall", "verdict"))).alias("first"),
        (F.max(quick & passed) & ~F.max(full & passed & (F.col("ord") % 2 == 0))).alias("quick_only"),
    )
    times = percentiles(rows, ["gpu", "kernel"], "wall", {"p50": 0.5, "p95": 0.95}).drop("n")
    g = g.withColumn("full_verdict", F.col("first.verdict")).drop("first").join(times, ["gpu", "kernel"], "left")
    return g.crossJoin(F.broadcast(g.agg(F.max("cv").alias("max_cv"))))


@query("a23_identity_sanity", f"""WITH {BENCH_SQL}, p AS (SELECT speedup / 25 AS s FROM r WHERE verdict = 'PASS')
SELECT (SELECT count(*) FROM p) AS n_pass, (SELECT count(*) FROM r WHERE verdict <> 'PASS') AS n_other, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.05) AS p5, quantile_cont(s, 0.95) AS p95, count(*) FILTER (s BETWEEN 0.99 AND 1.01) AS near_one FROM p""")
def identity_sanity(x):
    passed, rows = F.col("verdict") == "PASS", bench_rows(x).withColumn("s", F.when(F.col("verdict") == "PASS", F.col("speedup") / 25))
    counts = rows.agg(F.count_if(passed).alias("n_pass"), F.count_if(~passed).alias("n_other"), F.count_if(F.col("s").between(0.99, 1.01)).alias("near_one"))
    return counts.join(percentiles(rows, [], "s", {"median": 0.5, "p5": 0.05, "p95": 0.95}).drop("n"), how="left")  # one row each


@query("a22_quick_only", f"""WITH {BENCH_SQL}, o AS (SELECT gpu, kernel, ord, bool_and(verdict = 'PASS') FILTER (mode = 'quick') AS quick, bool_and(verdict = 'PASS') FILTER (mode = 'full') AS full_ok, min(speedup) FILTER (mode = 'quick') AS low FROM r GROUP BY ALL)
SELECT gpu, kernel, ord, low FROM o WHERE quick AND NOT full_ok""")
def quick_only(x):
    """Runs that pass every quick repeat and fail in full."""
    quick, full, passed = F.col("mode") == "quick", F.col("mode") == "full", F.col("verdict") == "PASS"
    runs = bench_rows(x).groupBy("gpu", "kernel", "ord").agg(F.min(F.when(quick, passed)).alias("quick"), F.min(F.when(full, passed)).alias("full"), F.min(F.when(quick, F.col("speedup"))).alias("low"))
    return runs.where("quick AND NOT full").select("gpu", "kernel", "ord", "low")


@query("a23_identity_by_file", f"""WITH {BENCH_SQL}, f AS (SELECT gpu || '/' || kernel AS file, ord, speedup / 25 AS s, verdict = 'PASS' AS passed FROM r)
SELECT file, count(*) AS n, count(DISTINCT ord) AS n_problems, count(*) FILTER (passed) / CAST(count(*) AS DOUBLE) AS pass_share, count(DISTINCT CASE WHEN passed THEN ord END) AS n_passed, quantile_cont(CASE WHEN passed THEN s END, 0.5) AS median, (SELECT count(DISTINCT ord) FROM f) AS all_problems FROM f GROUP BY 1""")
def identity_by_file(x):
    """Of each file its share of passes and its problems, and how many problems there are in all."""
    passed = F.col("verdict") == "PASS"
    rows = bench_rows(x).select(F.concat("gpu", F.lit("/"), "kernel").alias("file"), "ord", passed.alias("passed"), F.when(passed, F.col("speedup") / 25).alias("s"))
    # problems of a file are counted as rows of their own, so that no file is one task's set
    problems = rows.groupBy("file", "ord").agg(F.max("passed").alias("ever"), F.count("*").alias("c"), F.count_if("passed").alias("p"))
    by = problems.groupBy("file").agg(F.sum("c").alias("n"), F.count("*").alias("n_problems"), (F.sum("p") / F.sum("c")).alias("pass_share"), F.count_if("ever").alias("n_passed"))
    every = rows.select("ord").distinct().agg(F.count("*").alias("all_problems"))
    return by.join(percentiles(rows, ["file"], "s", {"median": 0.5}).drop("n"), "file", "left").crossJoin(F.broadcast(every))  # one row


@query("a24_failure_prefixes", """WITH f AS (SELECT CASE WHEN event_type = 'error' THEN 'Error ' || (user_id % 9) || ': at ' || event_id ELSE '' END AS line, event_type FROM events)
SELECT coalesce(nullif(split_part(line, ':', 1), ''), event_type) AS prefix, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, prefix LIMIT 6""")
def failure_prefixes(x):
    """What stands before the first colon of a failure, else the verdict; the six most frequent (the feature)."""
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("Error "), (F.col("user_id") % 9).cast("string"), F.lit(": at "), F.col("event_id").cast("string"))).otherwise("")
    prefix = F.coalesce(F.nullif(F.split_part(line, F.lit(":"), F.lit(1)), F.lit("")), F.col("event_type"))
    return x.events.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(6)


@query("a25_turn_means", f"""WITH {TURNS_SQL} SELECT CAST(turn AS INTEGER) AS turn, avg(length(message)) AS mean_chars, count(*) AS n, avg(CASE WHEN verdict = 'CRASH' THEN 1.0 ELSE 0.0 END) AS crash_share,
  avg(CASE WHEN length(message) > 6 THEN 1.0 ELSE 0.0 END) AS truncated_share, avg(CASE WHEN verdict = 'PASS' THEN 1.0 ELSE 0.0 END) AS cached_share, quantile_cont(coalesce(speedup, 0), 0.5) FILTER (verdict <> 'PASS') AS p50_wall FROM turns GROUP BY turn""")
def turn_means(x):
    passed, rows = F.col("verdict") == "PASS", turns(x)
    wall = percentiles(rows.select("turn", F.when(~passed, F.coalesce("speedup", F.lit(0.0))).alias("v")), ["turn"], "v", {"p50_wall": 0.5}).drop("n")
    found = rows.groupBy("turn").agg(
        F.avg(F.length("message")).alias("mean_chars"), F.count("*").alias("n"), stats.share(F.col("verdict") == "CRASH").alias("crash_share"), stats.share(F.length("message") > 6).alias("truncated_share"),
        stats.share(passed).alias("cached_share"),
    )
    return found.join(wall, "turn", "left")


@query("a26_step_curve", """WITH c AS (SELECT CAST(ts AS DATE) AS step, -avg(value) AS y FROM events GROUP BY 1)
SELECT arg_min(y, step) AS first, arg_max(y, step) AS last, avg(y) AS mean, min(y) AS low, max(y) AS high, count(*) AS n_steps FROM c""")
def step_curve(x):
    c = x.events.groupBy(F.to_date("ts").alias("step")).agg((-F.avg("value")).alias("y"))
    return c.agg(F.min_by("y", "step").alias("first"), F.max_by("y", "step").alias("last"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n_steps"))


@query("a29_expected_observed", """WITH e AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' END AS expected FROM part), o AS (SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'PASS' ELSE 'FAIL' END AS observed FROM lineitem GROUP BY 1),
a AS (SELECT p_partkey, expected, observed, expected = observed AS agree FROM e LEFT JOIN o ON p_partkey = l_partkey) SELECT *, bool_and(agree IS DISTINCT FROM false) OVER () AS all_ok FROM a""")
def expected_observed(x):
    """True, false or unknown by part; overall, unknown counts as agreed."""
    expected = x.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "PASS").when(F.col("p_partkey") % 3 == 1, "FAIL").alias("expected"))
    observed = x.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.when(F.max(F.col("l_returnflag") == "R"), "PASS").otherwise("FAIL").alias("observed"))
    a = expected.join(observed, "p_partkey", "left").withColumn("agree", F.col("expected") == F.col("observed"))
    return a.crossJoin(F.broadcast(a.agg(F.min(stats.not_false(F.col("agree"))).alias("all_ok"))))


@query("a30_nested_audit", """SELECT event_type AS stage, count(*) AS n, list_sort(list(DISTINCT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END)) AS labels FROM events WHERE (CASE WHEN event_id % 5 = 0 THEN NULL ELSE value > 100 END) = false GROUP BY 1""")
def nested_audit(x):
    """Of nested cases those that are known to be wrong, by stage, with their labels."""
    case = F.struct(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("label"), F.struct(F.when(F.col("event_id") % 5 != 0, F.col("value") > 100).alias("ok")).alias("native"))
    wrong = x.events.select(F.col("event_type").alias("stage"), case.alias("c")).where(F.col("c.native.ok").eqNullSafe(False))
    return wrong.groupBy("stage").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("c.label")).alias("labels"))


@query("a31_speedup_by_kernel", f"""WITH {TURNS_SQL} SELECT task_id, count(*) AS n, min(speedup) AS low, power(2, quantile_cont(log2(speedup), 0.5)) AS median, max(speedup) AS high, count(DISTINCT traj_id) AS n_codes FROM turns WHERE verdict = 'PASS' AND speedup > 0 GROUP BY 1""")
def speedup_by_kernel(x):
    s = F.col("speedup")
    rows = turns(x).where(t.passes() & (s > 0))
    middle = percentiles(rows.select("task_id", F.log2(s).alias("l")), ["task_id"], "l", {"l": 0.5}).select("task_id", F.power(F.lit(2.0), F.col("l")).alias("median"))
    return rows.groupBy("task_id").agg(F.count("*").alias("n"), F.min(s).alias("low"), F.max(s).alias("high"), F.count_distinct("traj_id").alias("n_codes")).join(middle, "task_id")


@query("w9_started_unfinished", """WITH l AS (SELECT user_id, event_id AS ord, event_type AS line FROM events WHERE event_type IN ('view', 'purchase')),
s AS (SELECT user_id, ord, lead(line) OVER (PARTITION BY user_id ORDER BY ord) AS next FROM l WHERE true QUALIFY line = 'view') SELECT user_id, max(ord) AS current FROM s WHERE next IS DISTINCT FROM 'purchase' GROUP BY 1""")
def started(x):
    """The last start of each worker that no end follows."""
    lines = x.events.where(F.col("event_type").isin("view", "purchase"))
    following = lines.select("user_id", "event_id", "event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("next"))
    return following.where((F.col("event_type") == "view") & ~F.col("next").eqNullSafe("purchase")).groupBy("user_id").agg(F.max("event_id").alias("current"))


@query("w14_global_batches", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM documents) SELECT doc_id, place, place // 4 AS batch, sha256('7:' || (place // 4)) AS shuffled FROM r")
def global_batches(x):
    """All rows in one order of length, four to a batch; batches are shuffled by hash."""
    placed = numbered(x.documents.select("doc_id", "n_chars"), [F.col("n_chars").asc_nulls_last(), F.col("doc_id").asc_nulls_last()])
    batch = F.floor(F.col("place") / 4)
    return placed.select("doc_id", "place", batch.alias("batch"), F.sha2(F.concat(F.lit("7:"), batch.cast("string")), 256).alias("shuffled"))


@query("w14_length_batches", "WITH r AS (SELECT doc_id, lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) / 4) AS BIGINT) AS batch FROM documents) SELECT doc_id, lang, batch, sha256('7:' || lang || ':' || batch) AS place FROM r")
def length_batches(x):
    """Rows of like length, four to a batch within a language; batches are shuffled by hash."""
    placed = numbered(x.documents.select("doc_id", "lang", "n_chars"), [F.col("n_chars").asc_nulls_last(), F.col("doc_id").asc_nulls_last()], "n", ["lang"])
    return placed.select("doc_id", "lang", F.floor(F.col("n") / 4).alias("batch")).withColumn("place", F.sha2(F.concat(F.lit("7:"), "lang", F.lit(":"), F.col("batch").cast("string")), 256))


@query("t4_composite_argmax", "SELECT user_id, count(DISTINCT event_type) AS n_kinds, stddev_pop(value) AS sd, min(event_id) AS first FROM events GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 LIMIT 1")
def composite_argmax(x):
    g = x.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("n_kinds"), F.stddev_pop("value").alias("sd"), F.min("event_id").alias("first"))
    return g.orderBy(F.desc("n_kinds"), F.desc("sd"), "first").limit(1)


@query("t6_format_first", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, sha256('0:' || doc_id)) AS place FROM documents")
def format_first(x):
    """One format before the others, in hash order, within each source."""
    order = [F.when(F.col("lang") == "en", 0).otherwise(1), F.sha2(F.concat(F.lit("0:"), F.col("doc_id").cast("string")), 256)]
    return numbered(x.documents.select("doc_id", "source", "lang"), order, "place", ["source"]).select("doc_id", (F.col("place") + 1).alias("place"))


@query("u1_labelled_union", "SELECT 'documents' AS origin, doc_id AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT 'pages', page_id, NULL, url FROM pages UNION ALL SELECT 'benchmark', item_id, NULL, NULL FROM benchmark")
def labelled_union(x):
    """Sources with different columns under one label; what a source lacks is null."""
    parts = [x.documents.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang"), x.pages.select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), "url"), x.benchmark.select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query("f34_verdicts", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'CRASH' WHEN value > 50 AND user_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS bench,
  CASE WHEN event_type = 'error' THEN 'NO_LAUNCH' WHEN user_id % 7 = 0 THEN 'FALLBACK' WHEN value <= 50 THEN 'FAIL' WHEN user_id % 2 = 1 THEN 'FAIL_SHAPE2' ELSE 'PASS' END AS verify,
  CASE WHEN event_type = 'purchase' THEN 'PASS' WHEN event_type IN ('error', 'signup') THEN 'CRASH' ELSE 'FAIL' END AS first,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE 0.25 + CASE WHEN value > 50 THEN 0.5 ELSE 0.5 * (1 - 3 / 4.0) END + CASE WHEN user_id % 2 = 0 THEN 0.25 ELSE 0 END END AS progress,
  greatest(0.001, 2 * 0.0078125) AS floor FROM events""")
def verdicts(x):
    """Verdicts of runs by three rules of precedence, how far a failing run came, and the least tolerance."""
    error, fast, even = F.col("event_type") == "error", F.col("value") > 50, F.col("user_id") % 2 == 0
    cases = F.array(F.struct(fast.alias("ok"), F.lit("tol").alias("reason")), F.struct(F.lit(None).cast("boolean").alias("ok"), F.lit("skipped").alias("reason")))
    log = F.when(F.col("event_type") == "error", "ImportError: x").otherwise("done")
    reported = F.when(F.col("event_type") == "purchase", "PASS").when(F.col("event_type") != "signup", "FAIL")
    sweep = F.when(fast, "PASS").otherwise("FAIL (3/4 failed)")
    return x.events.select(
        "event_id", scores.bench_verdict(error, cases, F.lit(2), even).alias("bench"), scores.verify_verdict(~error, F.col("user_id") % 7 == 0, fast, even, F.lit(None).cast("boolean")).alias("verify"),
        scores.first_verdict(reported, log, F.lit("PASS")).alias("first"), scores.progress(F.when(error, "FAIL").otherwise("PASS"), sweep, F.when(even, "PASS").otherwise("FAIL")).alias("progress"),
        scores.tolerance_floor(F.lit(0.001), F.lit(0.0078125)).alias("floor"),
    )


@query("f38_bandwidth", """SELECT l_partkey, sum(l_extendedprice) * 1e3 / quantile_cont(l_quantity, 0.5) / 1e9 AS own_gbs, sum(l_extendedprice) * 2e3 / quantile_cont(l_quantity, 0.5) / 1e9 AS fused_gbs, 100 * sum(l_extendedprice) * 1e3 / quantile_cont(l_quantity, 0.5) / 1e9 / 300 AS pct_peak FROM lineitem GROUP BY 1""")
def bandwidth(x):
    """Bytes over the median time, of the kernel's own traffic and of the fused one, against the peak."""
    middle = percentiles(x.lineitem, ["l_partkey"], "l_quantity", {"median": 0.5}).select("l_partkey", "median")
    own = F.col("bytes") * 1e3 / F.col("median") / 1e9
    total = x.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("bytes")).join(middle, "l_partkey", "left")
    return total.select("l_partkey", own.alias("own_gbs"), (2 * own).alias("fused_gbs"), (100 * own / 300).alias("pct_peak"))


@query("m5_summary", f"""{EPISODES_SQL} SELECT 'pass_at_1' AS measure, avg(p) AS value FROM (SELECT avg(CAST(any_pass AS DOUBLE)) AS p FROM rewards GROUP BY task_id) UNION ALL
SELECT 'geomean', exp(avg(ln(best_speedup))) FROM rewards WHERE any_pass AND best_speedup > 0 UNION ALL SELECT 'crash_share', sum(crash_count) / CAST(sum(n_turns) AS DOUBLE) FROM rewards UNION ALL SELECT 'best', max(best_speedup) FROM rewards UNION ALL
SELECT 'repeats', sum(pass_count) / CAST(count(*) AS DOUBLE) FROM rewards""")
def summary(x):
    """All measures of one evaluation under their names: success within tasks first, speed, crashes, the best, passes a trajectory."""
    r = cut(rewards(x))
    tasks = r.groupBy("task_id").agg(F.avg(F.col("any_pass").cast("double")).alias("p")).agg(F.avg("p").alias("pass_at_1"))
    rest = r.agg(stats.geomean(F.when(F.col("any_pass"), F.col("best_speedup"))).alias("geomean"), stats.ratio(F.sum("crash_count"), F.sum("n_turns")).alias("crash_share"), F.max("best_speedup").alias("best"), stats.ratio(F.sum("pass_count"), F.count("*")).alias("repeats"))
    both = tasks.crossJoin(rest)
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in ("pass_at_1", "geomean", "crash_share", "best", "repeats")])).alias("m")).select("m.*")


M6_RESAMPLES = 200


@query("m6_rescore", f"""WITH r AS (SELECT l_suppkey AS code, l_returnflag AS shape, l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g, l_orderkey * 8 + l_linenumber AS rep, l_quantity / 22 AS ratio, l_discount < 0.1 AS pass FROM lineitem),
w AS (SELECT g, ratio, b, {weight_sql("rep", "b")} AS w FROM r, range({M6_RESAMPLES}) AS t(b)), m AS (SELECT g, b, quantile_cont(ratio, 0.5) AS m FROM (SELECT g, b, ratio, unnest(range(w)) FROM w) GROUP BY ALL),
c AS (SELECT g, quantile_cont(m, 0.025) AS lo FROM m GROUP BY g), s AS (SELECT code, shape, g, quantile_cont(ratio, 0.5) AS median, bool_and(pass) AS pass FROM r GROUP BY ALL)
SELECT code, count(*) AS n_shapes, exp(avg(ln(median))) AS geomean, min(lo) AS lowest, min(lo) > 1.0 AND exp(avg(ln(median))) > 1.05 AS sig, bool_and(pass) AND min(lo) > 1.0 AND exp(avg(ln(median))) > 1.05 AS claimed,
  coalesce(list_sort(list(shape) FILTER (lo > 1.0 AND median > 1.05)), []) AS some_shapes FROM s JOIN c USING (g) GROUP BY code""")
def rescore(x):
    """A code's speedup is real if the lower end of every shape's interval is above 1 and the mean of its medians above 1.05; the verdict comes on top."""
    shape = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = x.lineitem.select(
        F.col("l_suppkey").alias("code"), F.col("l_returnflag").alias("shape"), (F.col("l_suppkey") * 4 + shape).cast("long").alias("g"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rep"),
        (F.col("l_quantity") / 22).alias("ratio"), (F.col("l_discount") < 0.1).alias("pass"),
    )
    lows = intervals(rows, "g", "rep", "ratio", M6_RESAMPLES).select("g", F.col("low").alias("lo"))
    middle = percentiles(rows, ["g"], "ratio", {"median": 0.5}).drop("n")
    s = rows.groupBy("code", "shape", "g").agg(F.min("pass").alias("pass")).join(middle, "g").join(lows, "g")
    some = F.sort_array(F.collect_list(F.when((F.col("lo") > 1.0) & (F.col("median") > scores.SIGNIFICANT), F.col("shape")))).alias("some_shapes")
    g = s.groupBy("code").agg(F.count("*").alias("n_shapes"), stats.geomean(F.col("median")).alias("geomean"), F.min("lo").alias("lowest"), F.min("pass").alias("pass"), some)
    sig = (F.col("lowest") > 1.0) & (F.col("geomean") > scores.SIGNIFICANT)
    return g.select("code", "n_shapes", "geomean", "lowest", sig.alias("sig"), (F.col("pass") & sig).alias("claimed"), "some_shapes")


@query("m8_low_variance", f"""{EPISODES_SQL}, g AS (SELECT task_id, min(reward) <> max(reward) AND stddev_pop(reward) < 0.95 AS low, bool_or(any_pass) AND NOT bool_and(any_pass) AS mixed, bool_and(any_pass) AS all_pass, count(DISTINCT best_speedup) FILTER (any_pass) AS n_best, avg(CASE WHEN pass_count > 1 THEN 1.0 ELSE 0.0 END) AS cached FROM rewards GROUP BY 1)
SELECT task_id, mixed, all_pass, n_best, cached FROM g WHERE low""")
def low_variance(x):
    """Groups that vary little: solved by some or all, different best results, share of repeats."""
    r, v = rewards(x), F.col("reward")
    g = r.groupBy("task_id").agg(
        (~stats.is_constant(v) & (F.stddev_pop(v) < 0.95)).alias("low"), (F.max("any_pass") & ~F.min("any_pass")).alias("mixed"), F.min("any_pass").alias("all_pass"),
        F.count_distinct(F.when(F.col("any_pass"), F.col("best_speedup"))).alias("n_best"), stats.share(F.col("pass_count") > 1).alias("cached"),
    )
    return g.where("low").drop("low")


@query("m9_first_failing_scale", """SELECT l_partkey, l_returnflag, arg_min(l_quantity, struct_pack(s := l_orderkey, l := l_linenumber, q := l_quantity)) AS scale, count(*) AS n_failing FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1, 2""")
def first_failing_scale(x):
    """The first scale, in the order of the scan, at which a kernel fails."""
    failing = x.lineitem.where("l_discount >= 0.05")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    return failing.groupBy("l_partkey", "l_returnflag").agg(first.alias("f"), F.count("*").alias("n_failing")).select("l_partkey", "l_returnflag", F.col("f.l_quantity").alias("scale"), "n_failing")


@query("m10_repair_pairs", f"""WITH {TURNS_SQL}, p AS (SELECT traj_id, turn, verdict AS v0, speedup AS s0, lead(verdict) OVER w AS v1, lead(speedup) OVER w AS s1 FROM turns WINDOW w AS (PARTITION BY traj_id ORDER BY turn))
SELECT traj_id, turn, CASE WHEN v1 IS NULL THEN 'last' WHEN v1 = 'CRASH' THEN 'next_crashed' WHEN v1 <> 'PASS' THEN 'next_incorrect' WHEN v0 <> 'PASS' THEN 'incorrect_to_correct' WHEN s1 > 1.1 * s0 THEN 'slow_to_faster' WHEN s1 < s0 THEN 'slower' ELSE 'too_close' END AS kind FROM p""")
def repair_pairs(x):
    """Neighbouring turns of which the second is better, and why the others are none."""
    w = Window.partitionBy("traj_id").orderBy("turn")
    p = turns(x).select("traj_id", "turn", "verdict", "speedup", F.lead("verdict").over(w).alias("v1"), F.lead("speedup").over(w).alias("s1"))
    kind = (
        F.when(F.col("v1").isNull(), "last").when(F.col("v1") == "CRASH", "next_crashed").when(F.col("v1") != "PASS", "next_incorrect").when(F.col("verdict") != "PASS", "incorrect_to_correct")
        .when(F.col("s1") > 1.1 * F.col("speedup"), "slow_to_faster").when(F.col("s1") < F.col("speedup"), "slower").otherwise("too_close")
    )
    return p.select("traj_id", "turn", kind.alias("kind"))


@query("j4_content_hash", "WITH h AS (SELECT sha256(text) AS sha, min(doc_id) AS doc_id, any_value(text) AS body FROM documents WHERE lang <> 'fr' GROUP BY 1) SELECT d.doc_id, h.doc_id AS found, length(h.body) AS n_chars, h.sha IS NULL AS missing FROM documents d LEFT JOIN h ON h.sha = sha256(d.text)")
def content_hash(x):
    """Bodies are found again by the hash of their contents; what is not found is reported."""
    store = x.documents.where("lang <> 'fr'").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("found"), F.max(F.length("text")).alias("n_chars"))
    wanted = x.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    return wanted.join(store, "sha", "left").select("doc_id", "found", "n_chars", F.col("found").isNull().alias("missing"))
