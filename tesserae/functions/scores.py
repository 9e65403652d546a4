"""Rewards, verdicts and checks of measured kernels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the rewards.
CLIP_LOW, CLIP_HIGH = -1.0, 3.0
WIDE_CLIP_HIGH = 4.0
NOISE_STD = 0.02
#: A speedup counts as real above this.
SIGNIFICANT = 1.05


def log2_floor(x: Column) -> Column:
    """log2, guarded against 0 by a floor of 1e-6."""
    return F.log2(F.greatest(x, F.lit(1e-6)))


def reward(any_pass: Column, best: Column, high: Column | float = CLIP_HIGH) -> Column:
    """Clipped log2 of the best speedup; 0 without a pass or a positive speedup."""
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(any_pass & (best > 0), F.greatest(F.lit(CLIP_LOW), F.least(high, log2_floor(best)))).otherwise(F.lit(0.0))


def reward_by_kind(any_pass: Column, best: Column, kind: Column, wide_kinds: list[str]) -> Column:
    return reward(any_pass, best, F.when(kind.isin(wide_kinds), F.lit(WIDE_CLIP_HIGH)).otherwise(F.lit(CLIP_HIGH)))


def reward_with_floor(any_pass: Column, best: Column, progress: Column) -> Column:
    """0.5 plus the clipped log2 of the best speedup, or 0.3 of the best progress without a pass."""
    return F.when(any_pass, 0.5 + F.greatest(F.lit(0.0), F.least(F.lit(CLIP_HIGH), log2_floor(best)))).otherwise(0.3 * F.coalesce(progress, F.lit(0.0)))


def reward_validation(any_pass: Column, best: Column) -> Column:
    return F.when(any_pass & (best > 0), 0.5 + F.greatest(F.lit(0.0), log2_floor(best))).otherwise(F.lit(0.0))


def progress(smoke: Column, sweep: Column, stability: Column) -> Column:
    """How far a failing kernel came, from the texts of its stages: 0 unless the smoke test passed."""
    failed = F.try_divide(F.regexp_extract(sweep, r"\((\d+)/(\d+) failed\)", 1).try_cast("double"), F.regexp_extract(sweep, r"\((\d+)/(\d+) failed\)", 2).try_cast("double"))
    swept = F.when(sweep.startswith("PASS"), F.lit(0.5)).when(failed.isNotNull(), 0.5 * (1 - failed)).otherwise(F.lit(0.0))
    stable = F.when(stability.startswith("PASS"), F.lit(0.25)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(smoke.startswith("PASS"), F.lit(False)), 0.25 + swept + stable).otherwise(F.lit(0.0))


def tolerance_check(out: Column, golden: Column, atol: Column, rtol: Column) -> dict[str, Column]:
    """Element-wise |o - g| <= atol + rtol * |g|.  `ok` is null (invalid) when the golden values aren't finite; a non-finite output is a violation."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    pairs = F.zip_with(out, golden, lambda o, g: F.struct(o.alias("o"), g.alias("g")))
    bad = F.filter(pairs, lambda p: ~finite(p["o"]) | (F.abs(p["o"] - p["g"]) > atol + rtol * F.abs(p["g"])))
    sound = F.filter(pairs, lambda p: finite(p["o"]) & finite(p["g"]))
    golden_ok = F.forall(golden, finite)
    return {
        "n_viol": F.size(bad).cast("long"),
        "n_nonfinite": F.size(F.filter(out, lambda o: ~finite(o))).cast("long"),
        "max_abs_err": F.coalesce(F.array_max(F.transform(sound, lambda p: F.abs(p["o"] - p["g"]))), F.lit(0.0)),
        "max_rel_err": F.coalesce(F.array_max(F.transform(sound, lambda p: F.abs(p["o"] - p["g"]) / F.greatest(F.abs(p["g"]), F.lit(1e-12)))), F.lit(0.0)),
        "ok": F.when(golden_ok, F.size(bad) == 0),
    }


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def _pairs(out: Column, golden: Column) -> Column:
    return F.zip_with(out, golden, lambda o, g: F.struct(o.alias("o"), g.alias("g")))


def _count(pairs: Column, rule) -> Column:
    return F.size(F.filter(pairs, rule)).cast("long")


def loose_check(out: Column, golden: Column, tol: float, loose: float) -> dict[str, Column]:
    """Where the golden value is finite |o - g| <= t + t * |g|, else the same infinity or both NaN; by a strict and a loose t.  With `finite_only` only non-finite outputs where the golden value is finite count."""
    pairs = _pairs(out, golden)
    lost = _count(pairs, lambda p: _finite(p["g"]) & ~_finite(p["o"]))
    both_nan = lambda p: F.isnan(p["o"]) & F.isnan(p["g"])
    other = _count(pairs, lambda p: ~_finite(p["g"]) & ~((p["o"] == p["g"]) | both_nan(p)))
    far = lambda t: _count(pairs, lambda p: _finite(p["g"]) & _finite(p["o"]) & (F.abs(p["o"] - p["g"]) > t + t * F.abs(p["g"])))
    sound = F.filter(pairs, lambda p: _finite(p["g"]) & _finite(p["o"]))
    return {
        "n_viol": far(tol) + lost + other, "ok": far(tol) + lost + other == 0, "loose_ok": far(loose) + lost + other == 0, "n_nonfinite": lost, "finite_only_ok": lost == 0,
        "max_abs": F.coalesce(F.array_max(F.transform(sound, lambda p: F.abs(p["o"] - p["g"]))), F.lit(0.0)),
    }


def pattern_check(out: Column, golden: Column, tol: float, strict: float) -> dict[str, Column]:
    """NaNs must stand in the same places; then every pair is close by both bounds, infinities equal."""
    pairs = _pairs(out, golden)
    same = ~F.exists(pairs, lambda p: F.isnan(p["o"]) != F.isnan(p["g"]))
    close = lambda t: (lambda p: F.isnan(p["g"]) | (p["o"] == p["g"]) | (_finite(p["o"]) & _finite(p["g"]) & (F.abs(p["o"] - p["g"]) <= t + t * F.abs(p["g"]))))
    sound = F.filter(pairs, lambda p: _finite(p["g"]) & _finite(p["o"]))
    return {
        "match": same & F.forall(pairs, close(tol)), "strict": same & F.forall(pairs, close(strict)), "n_bad": F.when(same, _count(pairs, lambda p: ~close(tol)(p))),
        "max_diff": F.when(same, F.coalesce(F.array_max(F.transform(sound, lambda p: F.abs(p["o"] - p["g"]))), F.lit(0.0))),
    }


def zero_rows(out: Column, golden: Column, width: int) -> Column:
    """Rows of so many numbers that are all 0 where the golden ones aren't."""
    starts = F.sequence(F.lit(0), F.floor((F.size(out) - 1) / width).cast("int"))
    zero = lambda x, i: F.forall(F.slice(x, i * width + 1, F.lit(width)), lambda v: v == 0)
    return F.size(F.filter(starts, lambda i: zero(out, i) & ~zero(golden, i))).cast("long")


def kernel_bench_verdict(reported: Column, log: Column, timed_out: Column) -> Column:
    """What the run reported, if it passed; a crash by the marks of its log; a run without a result and with a traceback crashed."""
    nothing = F.coalesce(reported, F.lit("")) == ""
    crash = (log.contains("Traceback") & nothing) | log.contains("instantiation failed") | log.contains("SyntaxError")
    return F.when(timed_out, "TIMEOUT").when(reported.eqNullSafe("PASS"), "PASS").when(crash, "CRASH").otherwise("FAIL")


def tolerance_floor(rtol: Column, unit_roundoff: Column) -> Column:
    return F.greatest(rtol, 2 * unit_roundoff)


def roofline(flops: Column, moved_bytes: Column, seconds: Column, peak_tflops: float, peak_gbs: float) -> dict[str, Column]:
    tflops, gbs = flops / seconds / 1e12, moved_bytes / seconds / 1e9
    intensity = flops / moved_bytes
    bound = F.when(intensity < peak_tflops * 1e12 / (peak_gbs * 1e9), "memory").otherwise("compute")
    return {"tflops": tflops, "gbs": gbs, "intensity": intensity, "bound": bound, "pct_peak": F.when(bound == "memory", 100 * gbs / peak_gbs).otherwise(100 * tflops / peak_tflops)}


def bench_verdict(fatal: Column, cases: Column, expected: Column, deterministic: Column) -> Column:
    """cases: array of (ok, reason).  A crash is a fatal error or a first case that raised; a pass needs all cases run and none false."""
    raised = F.coalesce(F.get(cases, F.lit(0))["reason"].startswith("EXC"), F.lit(False))
    clean = (F.size(cases) == expected) & ~F.exists(cases, lambda c: c["ok"].eqNullSafe(False)) & deterministic
    return F.when(fatal | raised, "CRASH").when(clean, "PASS").otherwise("FAIL")


def verify_verdict(launched: Column, fallback: Column, ok: Column, second_ok: Column, extreme_ok: Column) -> Column:
    """The first that applies, unknown counting as passed."""
    return (
        F.when(~launched, "NO_LAUNCH").when(fallback, "FALLBACK").when(ok.eqNullSafe(False), "FAIL")
        .when(second_ok.eqNullSafe(False), "FAIL_SHAPE2").when(extreme_ok.eqNullSafe(False), "FAIL_EXTREME").otherwise("PASS")
    )


def first_verdict(reported: Column, log: Column, smoke: Column) -> Column:
    crash = log.contains("ImportError") | log.contains("SyntaxError") | smoke.eqNullSafe("CRASH") | reported.isNull()
    return F.when(reported.eqNullSafe("PASS"), "PASS").when(crash, "CRASH").otherwise("FAIL")
