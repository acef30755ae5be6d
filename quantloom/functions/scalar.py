"""Scalar functions: ratios, the normal distribution and bet sizes (Z1, Z2, Z4-Z14), log-uniform draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles, where b may be 0: an infinity of a's sign, or no number if a is 0 too."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, to 7.5e-8. The published coefficients."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-x * x / 2.0) * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def signal(prob: Column, pred: Column, classes: int = 2, side: Column | None = None) -> Column:
    """Pred * (2 cdf(z) - 1) with z = (p - 1/n) / sqrt(p (1 - p)), times side if there is one; p of 0 or 1 gives -pred or pred."""
    z = F.try_divide(prob - 1.0 / classes, F.sqrt(prob * (1.0 - prob)))
    size = F.when(prob >= 1, 1.0).when(prob <= 0, -1.0).otherwise(2.0 * normal_cdf(z) - 1.0)
    out = pred * size
    return out if side is None else out * side


def discrete(x: Column, step: float = 0.05) -> Column:
    """The nearest multiple of ``step``, of two the even one, within -1 and 1; never a negative zero."""
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.rint(x / step) * step)) + 0.0


def bet_size(w: Column, x: Column) -> Column:
    """Z5."""
    return x / F.sqrt(w + x * x)


def target_position(w: Column, f: Column, price: Column, most: Column) -> Column:
    """Truncated towards zero."""
    return (bet_size(w, f - price) * most).cast("int")


def inverse_price(f: Column, w: Column, m: Column) -> Column:
    """Z7."""
    return f - m * F.sqrt(w / (1.0 - m * m))


def _mean_price(target: Column, now: Column, most: Column, one, sign: Column, symmetric: bool) -> Column:
    last = F.abs(target) + 1 if symmetric else F.abs(target + 1)
    first = F.abs(now + sign)
    steps = F.when(last > first, F.sequence(first.cast("int"), (last - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.try_divide(F.aggregate(steps, F.lit(0.0), lambda s, j: s + one(j / most.cast("double"))), (target - now).cast("double"))


def limit_price(target: Column, now: Column, f: Column, w: Column, most: Column, symmetric: bool = False) -> Column:
    """The mean inverse price over the steps from the position to the target. The range's end is |target + 1|, or |target| + 1 if ``symmetric``."""
    sign = F.when(target >= now, 1).otherwise(-1)
    return _mean_price(target, now, most, lambda m: inverse_price(f, w, m), sign, symmetric)


def calibrated_w(x: Column, m: Column) -> Column:
    """Z9."""
    return x * x * (1.0 / (m * m) - 1.0)


def bet_size_power(w: Column, x: Column) -> Column:
    """Z10."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * F.pow(F.abs(x), w))


def target_position_power(w: Column, f: Column, price: Column, most: Column) -> Column:
    """Z11."""
    return (bet_size_power(w, f - price) * most).cast("int")


def inverse_price_power(f: Column, w: Column, m: Column) -> Column:
    """Z12."""
    return F.when(m == 0, f).otherwise(f - F.signum(m) * F.pow(F.abs(m), 1.0 / w))


def limit_price_power(target: Column, now: Column, f: Column, w: Column, most: Column, symmetric: bool = False) -> Column:
    """Z13."""
    sign = F.signum((target - now).cast("double")).cast("int")
    return _mean_price(target, now, most, lambda m: inverse_price_power(f, w, m), sign, symmetric)


def calibrated_w_power(x: Column, m: Column) -> Column:
    """Z14."""
    return F.try_divide(F.log(m / F.signum(x)), F.log(F.abs(x)))


def log_uniform(a: float, b: float, seed: int) -> Column:
    """M16."""
    return F.lit(a) * F.pow(F.lit(b / a), F.rand(seed))
