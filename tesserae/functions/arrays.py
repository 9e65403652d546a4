"""Reference maths on arrays of doubles: one row is one vector."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def bound(value: Column, body) -> Column:
    """`body(value)`, where the value is computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(ZERO), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def log_sum_exp(x: Column) -> Column:
    return bound(F.array_max(x), lambda top: top + F.ln(total(F.transform(x, lambda v: F.exp(v - top)))))


def softmax(x: Column) -> Column:
    def divided(e):
        return bound(total(e), lambda s: F.transform(e, lambda v: v / s))

    return bound(F.array_max(x), lambda top: bound(F.transform(x, lambda v: F.exp(v - top)), divided))


def layernorm(x: Column, weight: Column | None = None, bias: Column | None = None, eps: float = 1e-5) -> Column:
    """By the population variance; weight and bias are arrays of the same length."""

    def scaled(m):
        return bound(F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m))) + eps), lambda sd: F.transform(x, lambda v: (v - m) / sd))

    out = bound(mean(x), scaled)
    if weight is not None:
        out = F.zip_with(out, weight, lambda a, b: a * b)
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b)


def rmsnorm(x: Column, eps: float = 1e-6) -> Column:
    return bound(F.sqrt(mean(F.transform(x, lambda v: v * v)) + eps), lambda rms: F.transform(x, lambda v: v / rms))


def cross_entropy(x: Column, target: Column) -> Column:
    return log_sum_exp(x) - F.get(x, target)


#: Terms of the series of the error function, enough up to ERF_END, from where on it is 1 in doubles.
ERF_TERMS, ERF_END = 110, 6.0


def erf(x: Column) -> Column:
    """The error function to double precision: 2 / sqrt(pi) * exp(-x * x) * x * (1 + 2 x^2 / 3 * (1 + 2 x^2 / 5 * (1 + ...))), whose terms are all positive, so nothing cancels."""
    size = F.least(F.abs(x), F.lit(ERF_END))
    twice = 2 * size * size
    steps = F.transform(F.sequence(F.lit(ERF_TERMS), F.lit(1), F.lit(-1)), lambda n: 2 * n + 1)
    inner = F.aggregate(steps, F.lit(1.0), lambda total, n: 1 + twice / n * total)
    near = 2 / math.sqrt(math.pi) * F.exp(-size * size) * size * inner
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * F.when(F.abs(x) >= ERF_END, F.lit(1.0)).otherwise(near))


def gelu(x: Column) -> Column:
    return F.transform(x, lambda v: 0.5 * v * (1 + erf(v / 2**0.5)))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (1 + F.exp(-v)))


def squared_relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(ZERO)) * F.greatest(v, F.lit(ZERO)))


def gated(gate: Column, up: Column) -> Column:
    return F.zip_with(silu(gate), up, lambda a, b: a * b)


def rotary(x: Column, position: Column, base: float = 10000.0) -> Column:
    """Neighbouring pairs turned by position / base ** (2 i / n)."""

    def at(i: Column) -> Column:
        angle = position / F.power(F.lit(base), (i - i % 2) / F.size(x))
        own, other = F.get(x, i), F.get(x, i + 1 - 2 * (i % 2))
        return own * F.cos(angle) + F.when(i % 2 == 0, -other).otherwise(other) * F.sin(angle)

    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), at)
