"""Multi-turn evaluation: events play the turns, a user's day is a trajectory, users modulo 30 are tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import scores, stats
from tesserae.operators import inversions
from tesserae.operators import trajectories as t
from tesserae.operators.selection import percentiles
from tesserae.plans.registry import Tables, query

TURNS_SQL = """turns AS (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS traj_id, user_id % 30 AS task_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS turn,
  CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'error' THEN 'CRASH' ELSE 'FAIL' END AS verdict,
  value / 100 AS speedup, event_type AS message FROM events)"""
EPISODES_SQL = f"""WITH {TURNS_SQL}, episodes AS (SELECT traj_id, task_id, bool_or(verdict = 'PASS') AS any_pass,
  coalesce(max(CASE WHEN verdict = 'PASS' THEN speedup END), 0.0) AS best_speedup,
  count(*) FILTER (verdict = 'PASS') AS pass_count, count(*) FILTER (verdict = 'CRASH') AS crash_count, count(*) AS n_turns FROM turns GROUP BY ALL),
rewards AS (SELECT *, CASE WHEN any_pass AND best_speedup > 0 THEN greatest(-1.0, least(3.0, log2(greatest(best_speedup, 1e-6)))) ELSE 0.0 END AS reward FROM episodes)"""


def turns(tables: Tables) -> DataFrame:
    day = F.to_date("ts")
    w = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    return tables.events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), day.cast("string")).alias("traj_id"),
        (F.col("user_id") % 30).alias("task_id"),
        (F.row_number().over(w) - 1).alias("turn"),
        F.when(F.col("event_type") == "purchase", "PASS").when(F.col("event_type") == "error", "CRASH").otherwise("FAIL").alias("verdict"),
        (F.col("value") / 100).alias("speedup"),
        F.col("event_type").alias("message"),
    )


def rewards(tables: Tables) -> DataFrame:
    return t.episodes(turns(tables)).withColumn("reward", scores.reward(F.col("any_pass"), F.col("best_speedup")))


@query("w4_pass_at_turn", f"""WITH {TURNS_SQL}, f AS (SELECT traj_id, min(CASE WHEN verdict = 'PASS' THEN turn + 1 END) AS p FROM turns GROUP BY 1)
SELECT CAST(b AS INTEGER) AS budget, count(*) AS n_trajectories, count(*) FILTER (p <= b) AS n_solved FROM f, range(1, 9) AS r(b) GROUP BY b""")
def pass_at_turn(x):
    return t.pass_at_turn(turns(x), 8)


@query("m5_episodes", f"{EPISODES_SQL} SELECT * FROM episodes")
def episodes(x):
    return t.episodes(turns(x))


@query("a10_macro_pass", f"{EPISODES_SQL}, k AS (SELECT task_id, avg(CAST(any_pass AS DOUBLE)) AS p, max(CAST(any_pass AS DOUBLE)) AS q FROM episodes GROUP BY 1) SELECT count(*) AS n_tasks, avg(p) AS pass_at_1, avg(q) AS pass_at_n FROM k")
def macro(x):
    return t.macro_pass(t.episodes(turns(x)))


@query("a10_fast_p", f"""{EPISODES_SQL}, k AS (SELECT p, task_id, avg(CASE WHEN any_pass AND (p = 0 OR best_speedup > p) THEN 1.0 ELSE 0.0 END) AS h
  FROM episodes, (VALUES (CAST(0 AS DOUBLE)), (1), (2)) AS v(p) GROUP BY ALL) SELECT p, avg(h) AS fast_p FROM k GROUP BY p""")
def fast(x):
    return t.fast_p(t.episodes(turns(x)), [0, 1, 2])


@query("w5_reward_by_budget", f"""WITH {TURNS_SQL}, r AS (SELECT traj_id, b, max(CASE WHEN verdict = 'PASS' AND turn < b THEN speedup END) AS s FROM turns, range(1, 9) AS r(b) GROUP BY ALL)
SELECT CAST(b AS INTEGER) AS budget, avg(CASE WHEN s > 0 THEN greatest(-1.0, least(3.0, log2(greatest(s, 1e-6)))) ELSE 0.0 END) AS mean_reward FROM r GROUP BY b""")
def reward_by_budget(x):
    return t.reward_by_budget(turns(x), 8)


@query("a14_transitions", f"""WITH {TURNS_SQL}, p AS (SELECT verdict AS before, lead(verdict) OVER (PARTITION BY traj_id ORDER BY turn) AS after FROM turns),
c AS (SELECT before, after, count(*) AS n FROM p WHERE after IS NOT NULL GROUP BY ALL) SELECT before, after, n, n / sum(n) OVER (PARTITION BY before) AS p FROM c""")
def transitions(x):
    return t.transitions(turns(x))


@query("w6_repeated_errors", f"""WITH {TURNS_SQL}, p AS (SELECT verdict v, message m, lead(verdict) OVER w v2, lead(message) OVER w m2 FROM turns WINDOW w AS (PARTITION BY traj_id ORDER BY turn))
SELECT count(*) AS n_pairs, count(*) FILTER (m = m2) AS n_same FROM p WHERE v <> 'PASS' AND v2 <> 'PASS'""")
def repeated(x):
    return t.repeated_errors(turns(x), F.col("message"))


@query("j9_later_pass", f"""WITH {TURNS_SQL}, p AS (SELECT *, min(CASE WHEN verdict = 'PASS' THEN turn END) OVER (PARTITION BY traj_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fixed_at FROM turns)
SELECT traj_id, CAST(turn AS INTEGER) AS turn, CAST(fixed_at AS INTEGER) AS fixed_at FROM p WHERE verdict <> 'PASS' AND fixed_at IS NOT NULL""")
def later(x):
    return t.later_pass(turns(x)).select("traj_id", "turn", "fixed_at")


@query("w7_early_stop", f"""WITH {TURNS_SQL}, s AS (SELECT traj_id, min(turn) AS stop FROM turns WHERE verdict = 'PASS' AND turn + 1 >= 2 AND speedup > 1 GROUP BY 1),
b AS (SELECT t.traj_id, count(*) FILTER (turn > stop) AS saved, count(*) AS n, coalesce(max(CASE WHEN verdict = 'PASS' THEN speedup END), 0) AS best,
  coalesce(max(CASE WHEN verdict = 'PASS' AND (stop IS NULL OR turn <= stop) THEN speedup END), 0) AS kept FROM turns t LEFT JOIN s USING (traj_id) GROUP BY 1)
SELECT CAST(sum(saved) AS BIGINT) AS turns_saved, CAST(sum(n) AS BIGINT) AS turns_total,
  sum(CASE WHEN best > 0 THEN greatest(-1.0, least(3.0, log2(greatest(best, 1e-6)))) ELSE 0 END - CASE WHEN kept > 0 THEN greatest(-1.0, least(3.0, log2(greatest(kept, 1e-6)))) ELSE 0 END) AS reward_lost FROM b""")
def early(x):
    return t.early_stop(turns(x), 2, 1.0)


@query("w10_advantages", f"""{EPISODES_SQL}, z AS (SELECT *, stddev_pop(reward) OVER w AS sd, avg(reward) OVER w AS mean, min(reward) OVER w = max(reward) OVER w AS tie FROM rewards WINDOW w AS (PARTITION BY task_id))
SELECT traj_id, reward, CASE WHEN tie THEN 0.0 ELSE (reward - mean) / (sd + 1e-6) END AS advantage FROM z""")
def advantages(x):
    return t.advantages(rewards(x), ["task_id"]).select("traj_id", "reward", "advantage")


@query("a12_group_spread", f"""{EPISODES_SQL} SELECT task_id, count(*) AS n, min(reward) = max(reward) AS zero_variance, min(reward) <> max(reward) AND stddev_pop(reward) < 0.02 AS noise,
  bool_or(any_pass) AND NOT bool_and(any_pass) AS mixed, bool_and(any_pass) AS all_solved, NOT bool_or(any_pass) AS none_solved FROM rewards GROUP BY 1""")
def spread(x):
    return t.group_spread(rewards(x), ["task_id"])


@query("a15_noise_mass", f"""{EPISODES_SQL}, z AS (SELECT *, stddev_pop(reward) OVER w AS sd, avg(reward) OVER w AS mean, min(reward) OVER w = max(reward) OVER w AS tie FROM rewards WINDOW w AS (PARTITION BY task_id)),
a AS (SELECT NOT tie AND sd < 0.9 AS noise, CASE WHEN tie THEN 0 ELSE abs(reward - mean) END AS p, CASE WHEN tie THEN 0 ELSE abs(reward - mean) / (sd + 1e-6) END AS s FROM z)
SELECT coalesce(sum(s) FILTER (noise), NULL) / nullif(sum(s), 0) AS share_std, sum(p) FILTER (noise) / nullif(sum(p), 0) AS share_plain FROM a""")
def noise(x):
    return t.noise_mass(rewards(x), ["task_id"], noise=0.9)


@query("f32_tie_probability", f"""{EPISODES_SQL}, c AS (SELECT task_id, pass_count AS v, count(*) AS c FROM episodes GROUP BY ALL), n AS (SELECT task_id, sum(c) AS n FROM c GROUP BY 1),
p AS (SELECT task_id, sum(CASE WHEN c >= 3 THEN c * (c - 1) * (c - 2) ELSE 0 END) / (max(n) * (max(n) - 1) * (max(n) - 2)) AS p FROM c JOIN n USING (task_id) WHERE n >= 3 GROUP BY 1)
SELECT count(*) AS n_groups, avg(p) AS tie_probability FROM p""")
def ties(x):
    return t.tie_probability(t.episodes(turns(x)), "task_id", "pass_count", 3)


@query("f33_reordered_pairs", f"""{EPISODES_SQL}, r AS (SELECT *, reward + 0.02 * n_turns AS shaped FROM rewards),
d AS (SELECT a.reward - b.reward AS d0, a.shaped - b.shaped AS d1 FROM r a JOIN r b ON a.task_id = b.task_id AND (a.reward < b.reward OR (a.reward = b.reward AND a.shaped < b.shaped)))
SELECT count(*) AS n_pairs, count(*) FILTER ((((d0 > 0) <> (d1 > 0)) AND d0 <> 0) OR (d0 = 0 AND d1 <> 0)) AS n_changed FROM d WHERE d0 <> 0 OR d1 <> 0""")
def reordered(x):
    shaped = rewards(x).withColumn("shaped", F.col("reward") + 0.02 * F.col("n_turns"))
    found = inversions.reordered_pairs(shaped, "task_id", "reward", "shaped")
    return found.select(F.col("n_pairs").cast("long").alias("n_pairs"), F.col("n_changed").cast("long").alias("n_changed"))


@query("f25_rewards", f"""{EPISODES_SQL} SELECT traj_id, reward,
  CASE WHEN any_pass AND best_speedup > 0 THEN greatest(-1.0, least(CASE WHEN task_id IN (1, 2) THEN 4.0 ELSE 3.0 END, log2(greatest(best_speedup, 1e-6)))) ELSE 0.0 END AS reward_wide,
  CASE WHEN any_pass THEN 0.5 + greatest(0.0, least(3.0, log2(greatest(best_speedup, 1e-6)))) ELSE 0.3 * (crash_count / n_turns) END AS reward_floor,
  CASE WHEN any_pass AND best_speedup > 0 THEN 0.5 + greatest(0.0, log2(greatest(best_speedup, 1e-6))) ELSE 0.0 END AS reward_validation FROM rewards""")
def all_rewards(x):
    p, b = F.col("any_pass"), F.col("best_speedup")
    return rewards(x).select(
        "traj_id", "reward", scores.reward_by_kind(p, b, F.col("task_id").cast("string"), ["1", "2"]).alias("reward_wide"),
        scores.reward_with_floor(p, b, F.col("crash_count") / F.col("n_turns")).alias("reward_floor"), scores.reward_validation(p, b).alias("reward_validation"),
    )


@query("a16_speedup_bands", f"""WITH {TURNS_SQL} SELECT CASE WHEN speedup < 0.95 THEN 'slower' WHEN speedup < 1.05 THEN 'equal' ELSE 'faster' END AS band, floor(greatest(-2.0, log2(greatest(speedup, 1e-6))) * 16) / 16 AS bin, count(*) AS n
  FROM turns WHERE verdict = 'PASS' GROUP BY ALL""")
def bands(x):
    s = F.col("speedup")
    band = F.when(s < 0.95, "slower").when(s < 1.05, "equal").otherwise("faster")
    return turns(x).where(t.passes()).groupBy(band.alias("band"), (F.floor(F.greatest(F.lit(-2.0), scores.log2_floor(s)) * 16) / 16).alias("bin")).agg(F.count("*").alias("n"))


@query("a31_speedup_population", f"""WITH {TURNS_SQL}, s AS (SELECT *, log2(speedup) AS l FROM turns WHERE verdict = 'PASS' AND speedup > 0)
SELECT count(*) AS n, power(2, quantile_cont(l, 0.5)) AS median, avg(CASE WHEN speedup >= 1 THEN 1.0 ELSE 0.0 END) AS at_least_1, min(speedup) AS low, max(speedup) AS high, count(DISTINCT task_id) AS n_tasks FROM s""")
def population(x):
    s = F.col("speedup")
    rows = turns(x).where(t.passes() & (s > 0))
    found = rows.agg(F.count("*").alias("n"), stats.share(s >= 1).alias("at_least_1"), F.min(s).alias("low"), F.max(s).alias("high"), F.count_distinct("task_id").alias("n_tasks"))
    middle = percentiles(rows.select(F.log2(s).alias("l")), [], "l", {"l": 0.5}).select(F.power(F.lit(2.0), F.col("l")).alias("median"))
    return found.join(middle, how="left")  # one row each


@query("a28_tied_but_separable", f"""{EPISODES_SQL}, g AS (SELECT task_id, min(pass_count) = max(pass_count) AS tied, stddev_pop(n_turns) > 0.02 AS separable FROM rewards GROUP BY 1)
SELECT count(*) AS n_groups, count(*) FILTER (tied AND separable) AS n_tied_separable FROM g""")
def tied(x):
    g = rewards(x).groupBy("task_id").agg(stats.is_constant(F.col("pass_count")).alias("tied"), (F.stddev_pop("n_turns") > 0.02).alias("separable"))
    return g.agg(F.count("*").alias("n_groups"), F.count_if(F.col("tied") & F.col("separable")).alias("n_tied_separable"))


@query("m7_gates", f"""{EPISODES_SQL}, m AS (SELECT avg(CAST(any_pass AS DOUBLE)) AS gain, avg(CASE WHEN reward = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM rewards)
SELECT 'gain' AS gate, gain AS value, 0.3 AS bound, gain >= 0.3 AS ok FROM m UNION ALL SELECT 'zero_share', zero_share, 0.15, zero_share < 0.15 FROM m""")
def gates(x):
    """Names that speak of a share must stay below their bound, the others reach it."""
    m = rewards(x).agg(F.avg(F.col("any_pass").cast("double")).alias("gain"), stats.share(F.col("reward") == 0).alias("zero_share"))
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.lit(b).alias("bound")) for n, b in (("gain", 0.3), ("zero_share", 0.15))])).alias("g")).select("g.*")
    return rows.withColumn("ok", F.when(F.col("gate").contains("share"), F.col("value") < F.col("bound")).otherwise(F.col("value") >= F.col("bound")))


@query("j7_two_runs", """WITH r AS (SELECT user_id AS k, event_id % 2 AS run, max(value) AS v, bool_or(event_type = 'purchase') AS p FROM events GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (a.p = b.p) AS n_same, quantile_cont(abs(a.v - b.v), 0.5) FILTER (a.p AND b.p) AS median_difference FROM r a JOIN r b ON a.k = b.k AND a.run = 0 AND b.run = 1""")
def two_runs(x):
    r = x.events.groupBy("user_id", (F.col("event_id") % 2).alias("run")).agg(F.max("value").alias("v"), F.max(F.col("event_type") == "purchase").alias("p"))
    both = r.groupBy("user_id").agg(*[F.max(F.when(F.col("run") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("v", "p")]).where("p0 IS NOT NULL AND p1 IS NOT NULL")
    difference = percentiles(both.select(F.when(F.col("p0") & F.col("p1"), F.abs(F.col("v0") - F.col("v1"))).alias("d")), [], "d", {"median_difference": 0.5}).drop("n")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("p0") == F.col("p1")).alias("n_same")).join(difference, how="left")  # one row each
