"""Channel normalisation, fitted on training windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GUARD = 1e-8


def multiplicity(place, n, lookback: int, horizon: int):
    """In how many windows the cycle at `place` (from 1) of n usable cycles stands; windows end from lookback to n - horizon."""
    last = F.least(n - horizon, place + (lookback - 1))
    return F.greatest(F.lit(0), last - F.greatest(F.lit(lookback), place) + 1)


def fit_channels(cycles: DataFrame, channels: dict[str, str], weight: str | None = None) -> DataFrame:
    """(channel, n, mean, std): population statistics over all points of array columns, channel name -> column.

    A cycle counts `weight` times, once for each training window that holds it, without the windows
    being laid out. std has the guard added. Two passes over sums of arrays: means first, then squares of
    differences to them, which do not cancel whatever the size of the values. The first is run when this is
    called; it leaves a number per channel.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    part = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    sums = cycles.agg(*(x for name, c in channels.items() for x in (F.sum(w * F.size(c)).alias(f"n_{name}"), F.sum(w * part(F.col(c), lambda x: x)).alias(f"s_{name}")))).first()
    means = {name: sums[f"s_{name}"] / sums[f"n_{name}"] if sums[f"n_{name}"] else None for name in channels}
    off = lambda name: lambda x: x - F.lit(means[name])
    rows = [F.struct(F.lit(name).alias("channel"), (w * F.size(c)).alias("n"), (w * part(F.col(c), off(name))).alias("s"), (w * part(F.col(c), lambda x, d=off(name): d(x) * d(x))).alias("q")) for name, c in channels.items()]
    total = cycles.select(F.inline(F.array(*rows))).groupBy("channel").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    centre = F.create_map(*(x for name, mean in means.items() for x in (F.lit(name), F.lit(mean).cast("double"))))
    away = F.try_divide("s", F.col("n"))  # what rounding left of the first mean
    spread = F.sqrt(F.greatest(F.try_divide("q", F.col("n")) - away * away, F.lit(0.0)))
    return total.select("channel", "n", (F.element_at(centre, F.col("channel")) + away).alias("mean"), (spread + GUARD).alias("std"))


def apply_channels(cycles: DataFrame, fitted: DataFrame, channels: dict[str, str]) -> DataFrame:
    """cycles with the channels' arrays normalised; the one row of statistics is broadcast."""
    stats = fitted.groupBy().pivot("channel", list(channels)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    out = cycles.crossJoin(F.broadcast(stats))  # one row
    for name, c in channels.items():
        out = out.withColumn(c, _scaled(c, name))
    return out.select(*cycles.columns)


def _scaled(c: str, name: str):
    return F.transform(c, lambda x: (x - F.col(f"{name}_mean")) / F.col(f"{name}_std"))
