"""Roll-ups of experiment results: over seeds, over horizons, against baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import average_rank, finite, improvement, improvement_percent, skill
from ..session import checkpointed
from .ranking import best

FUNCTIONS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def stats(rows: DataFrame, by: tuple[str, ...], columns: tuple[str, ...], functions: tuple[str, ...] = ("mean", "std", "min", "max")) -> DataFrame:
    """(by, n, <column>_<function>...): NaN counts as missing, null groups are kept. std is null for one value."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(FUNCTIONS[f](finite(F.col(c))).alias(f"{c}_{f}") for c in columns for f in functions))


def first_known(column: str, order: str) -> Column:
    """First value in order that is not null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def with_counts(rows: DataFrame, by: tuple[str, ...], columns: tuple[str, ...], part: str) -> DataFrame:
    """(by, n_trials, n_<part>, <column>_mean...): means of finite values with the rows and distinct parts behind them, in one aggregate."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_trials"), F.count_distinct(part).alias(f"n_{part}"), *(F.avg(finite(F.col(c))).alias(f"{c}_mean") for c in columns))


def most_frequent(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, column, n): the commonest value that is not null, of several the least; values are counted first."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    if by:
        return best(counts, by, [F.desc("n"), column])
    return counts.orderBy(F.desc("n"), column).limit(1)


def finite_means(rows: DataFrame, by: tuple[str, ...], *columns: str) -> DataFrame:
    """(by, <column>): means that leave NaN, infinite and missing values out; null if none is left."""
    return rows.groupBy(*by).agg(*(F.avg(finite(F.col(c))).alias(c) for c in columns))


def by_seed(rows: DataFrame, keys: tuple[str, ...], sums: tuple[str, ...] = (), means: tuple[str, ...] = (), firsts: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Level 1: one row per key (stage, seed, horizon, model ...). Rows with a null key are left out."""
    own = rows.dropna(subset=list(keys))
    return own.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(finite(F.col(c))).alias(c) for c in means), *(first_known(c, order).alias(c) for c in firsts))


def by_horizon(level1: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...], seed: str = "seed") -> DataFrame:
    """Level 2, over seeds: n_seeds, mean and sample deviation of each metric."""
    own = level1.dropna(subset=list(keys))
    return own.groupBy(*keys).agg(F.count_distinct(seed).alias("n_seeds"), *(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))


def overall(level2: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...], horizon: str = "horizon") -> DataFrame:
    """Level 3, over horizons: n_horizons; mean, deviation (0 for one horizon) and worst of each metric's mean."""
    own = level2.dropna(subset=list(keys))
    parts = [x for m in metrics for x in (F.avg(f"{m}_mean").alias(f"{m}_avg"), F.coalesce(F.stddev_samp(f"{m}_mean"), F.lit(0.0)).alias(f"{m}_std"), F.max(f"{m}_mean").alias(f"{m}_worst"))]
    return own.groupBy(*keys).agg(F.count_distinct(horizon).alias("n_horizons"), *parts)


def rank_columns(rows: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """rows with rank_<metric> (ties share their mean) and mean_rank."""
    for m in metrics:
        rows = rows.withColumn(f"rank_{m}", average_rank(F.col(m), *by))
    ranks = F.filter(F.array(*(F.col(f"rank_{m}") for m in metrics)), lambda x: x.isNotNull())
    return rows.withColumn("mean_rank", F.try_divide(F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x), F.size(ranks)))


def against_baseline(rows: DataFrame, keys: tuple[str, ...], metric: str, baseline, model: str = "model") -> DataFrame:
    """rows with the baseline model's metric of the same keys, and gain, gain_percent, skill.

    One baseline row per key at most; keys compare null-safely; without one the columns are null. rows are computed
    once: a mean computed again may differ in its last digit, and the baseline would gain on itself.
    """
    rows = checkpointed(rows)
    base = rows.filter(F.col(model) == baseline).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(metric).alias(f"baseline_{metric}"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = rows.join(base, on, "left").drop(*(f"_{k}" for k in keys))
    b, x = F.col(f"baseline_{metric}"), F.col(metric)
    return out.withColumns({"gain": improvement(b, x), "gain_percent": improvement_percent(b, x), "skill": skill(x, b)})


def gaps(rows: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...], baseline, model: str = "model") -> DataFrame:
    """rows with <metric>_gap (x - base) and <metric>_ratio (x / base, null at 0) against the baseline's row of the same keys; rows are computed once."""
    rows = checkpointed(rows)
    base = rows.filter(F.col(model) == baseline).select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(m).alias(f"_base_{m}") for m in metrics))
    out = rows.join(base, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    for m in metrics:
        out = out.withColumn(f"{m}_gap", F.col(m) - F.col(f"_base_{m}")).withColumn(f"{m}_ratio", F.try_divide(F.col(m), F.col(f"_base_{m}")))
    return out.drop(*(f"_base_{m}" for m in metrics))


def pivot_pair(rows: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...], own, other, by: str = "model", names: tuple[str, str] = ("own", "other")) -> DataFrame:
    """(keys, <own>_<metric>, <other>_<metric>, <metric>_gain, <metric>_gain_percent): two rows of each key side by side, in one aggregate."""
    pick = lambda which, m: F.max(F.when(F.col(by) == which, F.col(m)))
    out = rows.filter(F.col(by).isin(own, other)).groupBy(*keys).agg(*(pick(w, m).alias(f"{n}_{m}") for m in metrics for w, n in zip((own, other), names, strict=True)))
    for m in metrics:
        ref, x = F.col(f"{names[1]}_{m}"), F.col(f"{names[0]}_{m}")
        out = out.withColumn(f"{m}_gain", improvement(ref, x)).withColumn(f"{m}_gain_percent", improvement_percent(ref, x))
    return out


def mean_std(rows: DataFrame, by: tuple[str, ...], column: str) -> DataFrame:
    """(by, n, mean, std) over finite values: none gives infinities, one a deviation of 0."""
    x, inf = finite(F.col(column)), F.lit(float("inf"))
    n = F.count(x)
    return rows.groupBy(*by).agg(n.alias("n"), F.coalesce(F.avg(x), inf).alias("mean"), F.when(n == 0, inf).when(n == 1, 0.0).otherwise(F.stddev_samp(x)).alias("std"))
