"""Multi-turn trajectories: success by budget, transitions, rewards, groups.

A turns table has traj_id, task_id, turn (from 0), verdict, speedup.  Every window is partitioned by trajectory or
group; nothing is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import scores, stats


def passes() -> Column:
    return F.col("verdict") == "PASS"


def episodes(turns: DataFrame) -> DataFrame:
    """One row per trajectory."""
    return turns.groupBy("traj_id", "task_id").agg(
        F.max(passes()).alias("any_pass"),
        F.coalesce(F.max(F.when(passes(), F.col("speedup"))), F.lit(0.0)).alias("best_speedup"),
        F.count_if(passes()).alias("pass_count"),
        F.count_if(F.col("verdict") == "CRASH").alias("crash_count"),
        F.count("*").alias("n_turns"),
    )


def pass_at_turn(turns: DataFrame, most: int) -> DataFrame:
    """Share of trajectories solved within k turns, k = 1..most; a trajectory that ended keeps its last value."""
    first = turns.groupBy("traj_id").agg(F.min(F.when(passes(), F.col("turn") + 1)).alias("first_pass"))
    return (
        first.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("budget"), "first_pass")
        .groupBy("budget")
        .agg(F.count("*").alias("n_trajectories"), F.count_if(F.col("first_pass") <= F.col("budget")).alias("n_solved"))
    )


def reward_by_budget(turns: DataFrame, most: int) -> DataFrame:
    """Mean reward if trajectories ended after k turns."""
    w = Window.partitionBy("traj_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.withColumn("best", F.max(F.when(passes(), F.col("speedup"))).over(w))
    last = run.groupBy("traj_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", F.coalesce("best", F.lit(0.0))))).alias("best"), F.max("turn").alias("last"))
    at = last.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("budget"), "best", "last")
    best = F.coalesce(F.try_element_at("best", F.least(F.col("budget") - 1, F.col("last")).cast("bigint")), F.lit(0.0))
    return at.groupBy("budget").agg(F.avg(scores.reward(best > 0, best)).alias("mean_reward"))


def macro_pass(episode: DataFrame) -> DataFrame:
    """Within each task first, then over tasks: pass@1, pass@n."""
    task = episode.groupBy("task_id").agg(F.avg(F.col("any_pass").cast("double")).alias("p1"), F.max("any_pass").cast("double").alias("pn"))
    return task.agg(F.count("*").alias("n_tasks"), F.avg("p1").alias("pass_at_1"), F.avg("pn").alias("pass_at_n"))


def fast_p(episode: DataFrame, bounds: list[float]) -> DataFrame:
    """Share of trajectories that pass faster than p, by task, then over tasks; p = 0 only asks for a pass."""
    hits = [F.avg((F.col("any_pass") & (F.col("best_speedup") > p) if p else F.col("any_pass")).cast("double")).alias(f"p{i}") for i, p in enumerate(bounds)]
    task = episode.groupBy("task_id").agg(*hits)
    means = task.agg(*[F.avg(f"p{i}").alias(f"p{i}") for i in range(len(bounds))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"p{i}").alias("fast_p")) for i, p in enumerate(bounds)])).alias("x")).select("x.p", "x.fast_p")


def transitions(turns: DataFrame) -> DataFrame:
    """Counts of neighbouring verdicts and their share of the first verdict's row."""
    w = Window.partitionBy("traj_id").orderBy("turn")
    pairs = turns.select(F.col("verdict").alias("before"), F.lead("verdict").over(w).alias("after")).where("after IS NOT NULL")
    counts = pairs.groupBy("before", "after").count().withColumnRenamed("count", "n")
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def repeated_errors(turns: DataFrame, message: Column) -> DataFrame:
    """Of neighbouring failures, how many repeat the message."""
    w = Window.partitionBy("traj_id").orderBy("turn")
    pairs = turns.select("verdict", message.alias("m"), F.lead("verdict").over(w).alias("v2"), F.lead(message).over(w).alias("m2"))
    failed = pairs.where((F.col("verdict") != "PASS") & (F.col("v2") != "PASS"))
    return failed.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("m") == F.col("m2")).alias("n_same"))


def later_pass(turns: DataFrame) -> DataFrame:
    """Each failing turn with the first later passing turn of its trajectory."""
    w = Window.partitionBy("traj_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    return turns.withColumn("fixed_at", F.min(F.when(passes(), F.col("turn"))).over(w)).where(~passes() & F.col("fixed_at").isNotNull())


def early_stop(turns: DataFrame, least_turns: int, speedup: float) -> DataFrame:
    """Turns saved and reward lost by stopping at the first fast pass from a turn on."""
    stop = turns.where(passes() & (F.col("turn") + 1 >= least_turns) & (F.col("speedup") > speedup)).groupBy("traj_id").agg(F.min("turn").alias("stop"))
    joined = turns.join(stop, "traj_id", "left")
    kept = F.when(passes() & (F.col("stop").isNull() | (F.col("turn") <= F.col("stop"))), F.col("speedup"))
    by = joined.groupBy("traj_id").agg(
        F.count_if(F.col("turn") > F.col("stop")).alias("saved"),
        F.count("*").alias("n"),
        F.coalesce(F.max(F.when(passes(), F.col("speedup"))), F.lit(0.0)).alias("best"),
        F.coalesce(F.max(kept), F.lit(0.0)).alias("kept"),
    )
    lost = scores.reward(F.col("best") > 0, F.col("best")) - scores.reward(F.col("kept") > 0, F.col("kept"))
    return by.agg(F.sum("saved").alias("turns_saved"), F.sum("n").alias("turns_total"), F.sum(lost).alias("reward_lost"))


def advantages(rewards: DataFrame, group: list[str], value: str = "reward", min_std: float = 0.0, divide: bool = True) -> DataFrame:
    """(r - mean) / (deviation + 1e-6) in each group; 0 in groups that are constant or vary no more than `min_std`."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(value).over(w)
    tie = (F.min(value).over(w) == F.max(value).over(w)) | (sd <= min_std)
    z = F.col(value) - F.avg(value).over(w)
    return rewards.withColumn("advantage", F.when(tie, F.lit(0.0)).otherwise(z / (sd + 1e-6) if divide else z))


def group_spread(rewards: DataFrame, group: list[str], value: str = "reward", noise: float = scores.NOISE_STD) -> DataFrame:
    """Per group: constant, varying no more than noise, mixed, all or none solved."""
    return rewards.groupBy(*group).agg(
        F.count("*").alias("n"),
        stats.is_constant(F.col(value)).alias("zero_variance"),
        (~stats.is_constant(F.col(value)) & (F.stddev_pop(value) < noise)).alias("noise"),
        (F.max("any_pass") & ~F.min("any_pass")).alias("mixed"),
        F.min("any_pass").alias("all_solved"),
        (~F.max("any_pass")).alias("none_solved"),
    )


def noise_mass(rewards: DataFrame, group: list[str], value: str = "reward", noise: float = scores.NOISE_STD) -> DataFrame:
    """Share of the absolute advantage that lies in groups of noise, with and without dividing by the deviation."""
    w = Window.partitionBy(*group)
    constant = F.min(value).over(w) == F.max(value).over(w)
    noisy = rewards.withColumn("noise", ~constant & (F.stddev_pop(value).over(w) < noise))
    scaled = advantages(noisy, group, value).withColumnRenamed("advantage", "a_std")
    both = advantages(scaled, group, value, divide=False).withColumnRenamed("advantage", "a_plain")
    part = lambda c: stats.ratio(F.sum(F.when(F.col("noise"), F.abs(c))), F.sum(F.abs(c)))
    return both.agg(part(F.col("a_std")).alias("share_std"), part(F.col("a_plain")).alias("share_plain"))


def tie_probability(values: DataFrame, group: str, value: str, size: int) -> DataFrame:
    """Mean over groups of the chance that `size` rows drawn without repeats are equal: sum over values of C(count, size) / C(n, size)."""

    def log_choose(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda a, i: a + F.ln(n - i))

    counts = values.groupBy(group, value).agg(F.count("*").alias("c"))
    per = counts.groupBy(group).agg(F.sum("c").alias("n"), F.collect_list("c").alias("cs")).where(F.col("n") >= size)
    p = F.aggregate("cs", F.lit(0.0), lambda a, c: a + F.when(c >= size, F.exp(log_choose(c) - log_choose(F.col("n")))).otherwise(F.lit(0.0)))
    return per.select(p.alias("p")).agg(F.count("*").alias("n_groups"), F.avg("p").alias("tie_probability"))


def neighbour_repairs(rounds: DataFrame, least_speedup: float) -> DataFrame:
    """Each round but a trajectory's last (traj_id, turn, code, known, good, speedup) with `kind`, the repair that the next one would be, and `skipped`, the first reason why it is none."""
    w = Window.partitionBy("traj_id").orderBy("turn")
    pairs = rounds.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("turn", "code", "known", "good", "speedup")]).where("next_turn IS NOT NULL")
    reasons = [
        ("turn_not_failed", F.col("good") & (F.col("speedup") >= least_speedup)),
        ("next_result_unknown", ~F.coalesce("next_known", F.lit(False))),
        ("next_not_better", ~F.col("next_good")),
        ("next_not_faster", F.col("good") & ~(F.col("next_speedup") > F.col("speedup"))),
        ("failed_turn_no_code", F.col("code").isNull()),
        ("next_no_code", F.col("next_code").isNull()),
        ("identical_code", F.trim("code") == F.trim("next_code")),
    ]
    kind = F.when(F.col("good"), "slow_to_faster").otherwise("incorrect_to_correct")
    return pairs.withColumns({"skipped": F.coalesce(*[F.when(c, n) for n, c in reasons]), "kind": kind})


def later_repairs(rounds: DataFrame, key: str, starter: str) -> DataFrame:
    """(key, target, reason) of failing rounds (traj_id, turn, code, good, passing): the code of the first later round that is known to pass, and why the pair is dropped."""
    # read backwards, so that the window grows by one row at a time
    back = Window.partitionBy("traj_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    target = F.last(F.when(F.col("passing"), F.col("code")), ignorenulls=True).over(back)
    failing = rounds.withColumn("target", target).where(~F.col("good"))
    reasons = [
        ("no_later_pass", F.col("target").isNull()),
        ("failed_no_code", F.col("code").isNull()),
        ("failed_code_is_pass", F.col("passing")),
        ("target_is_starter", F.col("target") == starter),
        ("failed_same_as_target", F.col("code") == F.col("target")),
    ]
    told = failing.withColumn("reason", F.coalesce(*[F.when(c, n) for n, c in reasons]))
    # of equal pairs the first, by an aggregate: a pair may be a hot one
    first = told.where("reason IS NULL").groupBy("code", "target").agg(F.min(key).alias("first"))
    kept = told.join(first, ["code", "target"], "left")
    return kept.select(key, "target", F.when(F.col("reason").isNull() & (F.col(key) != F.col("first")), "duplicate_pair").otherwise(F.col("reason")).alias("reason"))


def overridden(rows: DataFrame, run: str, base: str, over: str) -> DataFrame:
    """The rows of run `base`, but those of the problems that run `over` covers from there only."""
    covered = rows.where(F.col(run) == over).select("task_id").distinct()
    return rows.where(F.col(run) == base).join(covered, "task_id", "left_anti").unionByName(rows.where(F.col(run) == over))


def judged_episodes(turns: DataFrame, keep: list[str], least_gain: float = 1.05) -> DataFrame:
    """One row a trajectory.  A turn solves if it passes with code that isn't the starter's, and beats it if its speedup and the lower end of the interval show a gain."""
    solved = passes() & ~F.col("is_starter")
    w = Window.partitionBy("traj_id").orderBy("turn")
    seen = turns.withColumns({"solved": solved, "beat": solved & (F.col("speedup") > least_gain) & (F.col("low") > 1.0)})
    seen = seen.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("verdict", "message", "solved")])
    failed, then = F.col("verdict") != "PASS", F.col("next_verdict") != "PASS"
    same = (F.col("verdict") == F.col("next_verdict")) & (F.col("message") == F.col("next_message"))
    return seen.groupBy(*keep, "task_id", "traj_id").agg(
        F.max(passes()).alias("passed"), F.max("solved").alias("solved"), F.max("beat").alias("beat"), F.max(F.col("solved") & (F.col("turn") == 0)).alias("solved_first"),
        F.count("*").alias("turns"), F.count_if(F.col("verdict") == "CRASH").alias("crashed"), F.count_if(failed).alias("failed"), F.count_if("solved").alias("n_solved"), F.count_if(passes() & F.col("is_starter")).alias("starters"),
        F.count_if(failed & then).alias("pairs"), F.count_if(failed & then & same).alias("same"), F.count_if(failed & F.col("next_verdict").isNotNull()).alias("fail_next"), F.count_if(failed & F.col("next_solved")).alias("fail_solved"),
        F.max(F.when(F.col("solved"), F.col("speedup"))).alias("best"),
    )


def report(episodes: DataFrame, scope: str) -> DataFrame:
    """One row for each scope: rates within problems first, then over problems; shares of turns and of neighbouring pairs; the best speedups."""
    rate = lambda c, n: (F.avg(F.col(c).cast("double")).alias(f"{n}_1"), F.max(F.col(c).cast("int")).alias(f"{n}_n"))
    sums = ["turns", "crashed", "failed", "n_solved", "starters", "pairs", "same", "fail_next", "fail_solved"]
    task = episodes.groupBy(scope, "task_id").agg(
        F.count("*").alias("episodes"), *rate("solved", "p"), *rate("solved_first", "t"), *rate("passed", "a"), *rate("beat", "b"), F.count_if("solved").alias("solving"), F.count("best").alias("n_best"), F.sum(F.ln("best")).alias("logs"), *[F.sum(c).alias(c) for c in sums]
    )
    share = lambda a, b: F.sum(a) / F.greatest(F.lit(1), F.sum(b))
    return task.groupBy(scope).agg(
        F.count("*").alias("problems"), F.sum("episodes").alias("episodes"), F.sum("turns").alias("turns"), F.avg("p_1").alias("pass_1"), F.avg("p_n").alias("pass_n"), F.avg("t_1").alias("pass_1_first"), F.avg("t_n").alias("pass_n_first"),
        F.avg("a_1").alias("pass_1_any"), F.avg("a_n").alias("pass_n_any"), F.avg("b_1").alias("beat_1"), F.avg("b_n").alias("beat_n"), (F.sum("crashed") / F.sum("turns")).alias("crash_rate"), share("crashed", "failed").alias("crash_share"),
        F.sum("starters").alias("starter_turns"), share("same", "pairs").alias("repeat_rate"), F.sum("pairs").alias("fail_pairs"), share("fail_solved", "fail_next").alias("solved_after_fail"), F.sum("solving").alias("solving_episodes"),
        F.sum("n_solved").alias("solving_turns"), F.sum("p_n").alias("problems_solved"), F.exp(F.try_divide(F.sum("logs"), F.sum("n_best"))).alias("geomean"),
    )


def stopped(turns: DataFrame, most_turns: int, answer_tokens: int, context_tokens: int) -> DataFrame:
    """(traj_id, n_kept, n_turns, stopped_by): a trajectory (traj_id, turn, tokens) goes on while it has turns left and what was said before leaves room for two answers."""
    w = Window.partitionBy("traj_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("tokens").over(w), F.lit(0.0))
    seen = turns.select("traj_id", (F.col("turn") < most_turns).alias("early"), (before + 2 * answer_tokens <= context_tokens).alias("room"))
    go = F.col("early") & F.col("room")
    why = F.when(F.min(go), "ended").when(F.max(F.col("early") & ~F.col("room")), "context").otherwise("turns")
    return seen.groupBy("traj_id").agg(F.count_if(go).alias("n_kept"), F.count("*").alias("n_turns"), why.alias("stopped_by"))
