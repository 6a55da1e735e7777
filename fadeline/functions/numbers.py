"""Numeric guards and scores. NaN and infinities become null on the way in, so that aggregates skip them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def number(text: Column) -> Column:
    """A finite number out of text, else null."""
    return finite(text.try_cast("double"))


def or_inf(x: Column) -> Column:
    """Sort key: non-finite values last in ascending order."""
    return F.coalesce(finite(x), F.lit(INF))


def or_neg_inf(x: Column) -> Column:
    """Sort key: non-finite values last in descending order."""
    return F.coalesce(finite(x), F.lit(-INF))


def improvement(reference: Column, x: Column) -> Column:
    """reference - x; null if either is missing."""
    return finite(reference) - finite(x)


def improvement_percent(reference: Column, x: Column) -> Column:
    """The improvement in percent of the reference; null if that is 0."""
    return F.try_divide(improvement(reference, x), finite(reference)) * 100


def skill(error: Column, baseline: Column) -> Column:
    """1 - error / baseline; NaN unless the baseline is finite and positive."""
    base = finite(baseline)
    return F.when(base > 0, 1 - F.try_divide(error, base)).otherwise(F.lit(float("nan")))


def gap(x: Column, base: Column) -> Column:
    return x - base


def ratio(x: Column, base: Column) -> Column:
    """x / base, null at base 0."""
    return F.try_divide(x, base)


def spread_score(mean: Column, std: Column, weight: float = 1.0, improved: Column | None = None, penalty: float = 0.0) -> Column:
    """mean + weight * std, and penalty * |improvement| where a baseline beats it."""
    score = mean + weight * std
    return score if improved is None else score + F.when(improved < 0, penalty * F.abs(improved)).otherwise(0.0)


def weighted_score(parts: dict[str, float]) -> Column:
    """Weighted sum of columns."""
    return reduce(lambda a, b: a + b, (F.col(c) * w for c, w in parts.items()))


def band(x: Column, bounds: tuple[tuple[float, str], ...], otherwise: str) -> Column:
    """Label of the first bound that x reaches; NaN reaches none."""
    out = F.lit(otherwise)
    for bound, label in reversed(bounds):
        out = F.when(~F.isnan(x) & (x >= bound), label).otherwise(out)
    return out


def soh_band(x: Column) -> Column:
    return band(x, ((0.90, "early_ge_0.90"), (0.80, "mid_0.80_0.90")), "late_lt_0.80")


def clip_low(z: Column) -> Column:
    """z, at least 0; null for NaN and null."""
    return F.when(z.isNotNull() & ~F.isnan(z), F.greatest(z, F.lit(0.0)))


def row_mean(*columns: Column) -> Column:
    """Mean across columns of one row, skipping null and NaN."""
    kept = F.filter(F.array(*(finite(c) for c in columns)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))


def average_rank(x: Column, *by: str) -> Column:
    """Rank of x within its group, ties sharing their mean rank; null stays unranked."""
    x = finite(x)
    ranks = F.rank().over(W.partitionBy(*by).orderBy(x.asc_nulls_last()))
    ties = F.count("*").over(W.partitionBy(*by, x))
    return F.when(x.isNotNull(), ranks + (ties - 1) / 2)


def delta_target(future: Column, baseline: Column, mode: str = "delta", scale: float = 1.0) -> Column:
    """Training target of the windowed track: the future value, or future - baseline; scaled."""
    if mode not in ("absolute", "delta") or scale <= 0:
        raise ValueError("mode is absolute or delta, scale is positive")
    return (future - baseline if mode == "delta" else future) * scale


def delta_restore(output: Column, baseline: Column, mode: str = "delta", scale: float = 1.0) -> Column:
    """Inverse of delta_target."""
    if mode not in ("absolute", "delta") or scale <= 0:
        raise ValueError("mode is absolute or delta, scale is positive")
    return baseline + output / scale if mode == "delta" else output / scale


def loss_target(current: Column, target: Column, scale: float = 1.0) -> Column:
    """Training target of the fixed-origin track: current - target, the opposite sign."""
    return (current - target) * scale


def loss_restore(output: Column, current: Column, scale: float = 1.0) -> Column:
    return current - output / scale
