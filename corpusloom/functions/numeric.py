"""Numeric functions over arrays as column expressions: all run inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once, also where ``fn`` uses it within a lambda for each element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def stretch(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return F.ln(q / (1 - q))


def silent(logit: Column) -> Column:
    """An expert that says nothing gives a logit of 0."""
    return F.coalesce(logit, F.lit(0.0))


def softplus(x: Column) -> Column:
    return F.when(x > 20, x).otherwise(F.ln(1 + F.exp(F.least(x, F.lit(20.0)))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def rms_norm(c: Column, eps: float = 1e-6) -> Column:
    return let(c, lambda v: let(F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v) + eps), lambda scale: F.transform(v, lambda x: x / scale)))


def mean_zero(c: Column) -> Column:
    return let(c, lambda v: let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean)))


def layer_norm(c: Column, eps: float = 1e-6) -> Column:
    return rms_norm(mean_zero(c), eps)


def l2_norm(c: Column, eps: float = 1e-6) -> Column:
    return let(c, lambda v: let(F.sqrt(total(F.transform(v, lambda x: x * x)) + eps), lambda scale: F.transform(v, lambda x: x / scale)))


def relu2(c: Column) -> Column:
    return F.transform(c, lambda x: F.pow(F.greatest(x, F.lit(0.0)), 2))


def softmax(c: Column) -> Column:
    shifted = let(c, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def softcap(c: Column, cap: float = 15.0) -> Column:
    return F.transform(c, lambda x: cap * F.tanh(x / cap))


def quantize(c: Column, scale: Column, low: int, high: int) -> Column:
    """Rounded half to even, clamped."""
    return let(scale, lambda k: F.transform(c, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.rint(x / k).cast("int")))))


def rope(c: Column, pos: Column, base: float = 10000.0) -> Column:
    """Pairs (2i, 2i+1) turned by pos / base^(2i/d)."""
    half = F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 1)

    def turn(i: Column) -> Column:
        angle = pos / F.pow(F.lit(base), 2 * i / F.size(c))
        x, y = F.element_at(c, 2 * i + 1), F.element_at(c, 2 * i + 2)
        return F.array(x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle))

    return F.flatten(F.transform(half, turn))


def neg_log_prob(p: Column, target: Column) -> Column:
    """-ln p[target], the target counted from 0."""
    return -F.ln(F.greatest(F.element_at(p, target + 1), F.lit(1e-38)))


def log2_factorial(n: Column) -> Column:
    """Exact below 16, beyond that Stirling's series to the fifth power (off by less than 1e-10); its cost doesn't grow with n."""
    small = F.array(*[F.lit(math.log2(math.factorial(k))) for k in range(16)])
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series / math.log(2))


def adaptive_bits(counts: Column, alphabet: int) -> Column:
    """Code length of an adaptive add-one model, from the symbol counts alone."""
    n = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    own = F.aggregate(F.transform(counts, log2_factorial), F.lit(0.0), lambda a, x: a + x)
    return let(n, lambda k: log2_factorial(k + (alphabet - 1))) - log2_factorial(F.lit(alphabet - 1)) - own


def learning_rate(fraction: Column, warm: float = 0.05) -> Column:
    """Cosine warm-up, then cosine decay."""
    up = (1 - F.cos(F.lit(3.141592653589793) * fraction / warm)) / 2
    down = (F.cos(F.lit(3.141592653589793) * (fraction - warm) / (1 - warm)) + 1) / 2
    return F.when(fraction < warm, up).otherwise(down)


def uvarint_length(n: Column) -> Column:
    """Bytes of a base-128 varint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")
