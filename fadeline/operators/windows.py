"""Samples out of sequences: positional windows, fixed-origin look-ups, persistence baselines, crossings.

A sequence has the columns file, ord (position among usable cycles), cycle_number and soh; all
operators share one partitioning by file, so that a chain of them shuffles once. Where one file may hold a
large share of all rows, `in_blocks` runs the same operators over blocks of each file that overlap by what a window sees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import numbered_by_ranges

#: Rows of a file that one block holds, but for what it sees of its neighbours.
BLOCK = 1 << 16


def _by(key: str, order: str):
    return W.partitionBy(key).orderBy(order)


def sliding_samples(seq: DataFrame, lookback: int, horizon: int, key: str = "file", order: str = "ord", cycle: str = "cycle_number", value: str = "soh", history: tuple[str, ...] = ()) -> DataFrame:
    """Every window of `lookback` consecutive usable rows with the row `horizon` places behind its end.

    Positional: skipped cycles do not count. Adds input_start_cycle, input_end_cycle, target_cycle,
    target and, for the columns named, history_<column> arrays in order. Files with fewer than
    lookback + horizon rows have no sample.
    """
    w = _by(key, order)
    ahead = lambda c: F.lead(c, horizon).over(w) if horizon else F.col(c)
    out = seq.withColumns({
        "input_start_cycle": F.lag(cycle, lookback - 1).over(w),
        "input_end_cycle": F.col(cycle),
        "target_cycle": ahead(cycle),
        "target": ahead(value),
        **{f"history_{c}": F.collect_list(c).over(w.rowsBetween(1 - lookback, 0)) for c in history},
        "place": F.row_number().over(w),
        "behind": F.lead(F.lit(1), horizon).over(w) if horizon else F.lit(1),
    })
    return out.filter((F.col("place") >= lookback) & F.col("behind").isNotNull()).drop("place", "behind")


def fixed_origin_samples(seq: DataFrame, lookback: int, horizons: DataFrame, key: str = "file", cycle: str = "cycle_number", value: str = "soh") -> DataFrame:
    """(key, horizon, target_cycle, current, target): per horizon the value at cycle number lookback + horizon.

    By cycle number, not by position. Sequences without a value at either cycle have no row.
    """
    now = seq.filter(F.col(cycle) == lookback).select(key, F.col(value).alias("current"))
    wanted = now.crossJoin(F.broadcast(horizons.select("horizon"))).withColumn("target_cycle", F.lit(lookback) + F.col("horizon"))
    later = seq.select(key, F.col(cycle).alias("target_cycle"), F.col(value).alias("target"))
    return wanted.join(later, [key, "target_cycle"]).select(key, "horizon", "target_cycle", "current", "target")


def previous_value(seq: DataFrame, key: str = "file", order: str = "ord", value: str = "soh") -> DataFrame:
    """seq with `previous`: the value of the row before in its file."""
    return seq.withColumn("previous", F.lag(value, 1).over(_by(key, order)))


def persistence(seq: DataFrame, lookback: int, horizon: int, key: str = "file", order: str = "ord", cycle: str = "cycle_number", value: str = "soh") -> DataFrame:
    """Sliding samples with `pred`, the persistence baseline: the last input's value, or at horizon 0 the one before it."""
    seq = previous_value(seq, key, order, value)
    out = sliding_samples(seq, lookback, horizon, key, order, cycle, value)
    return out.withColumn("pred", F.col(value) if horizon else F.col("previous")).withColumn("baseline", F.col(value))


def fixed_origin_persistence(samples: DataFrame) -> DataFrame:
    """Fixed-origin samples with `pred`: the value at the origin, a change of 0."""
    return samples.withColumn("pred", F.col("current"))


def slope(seq: DataFrame, key: str = "cell_id", order: str = "target_cycle", value: str = "residual") -> DataFrame:
    """seq with `slope`: the difference to the row before, 0 for the first and where either is missing."""
    x = F.when(~F.isnan(value), F.col(value))
    return seq.withColumn("slope", F.coalesce(x - F.lag(x).over(_by(key, order)), F.lit(0.0)))


def first_crossing(rows: DataFrame, threshold: float, value: str, key: str = "cell_id", cycle: str = "target_cycle") -> DataFrame:
    """(key, crossing): the first cycle at which the value is at or below the threshold; null if none. Null keys are left out."""
    at = F.when((F.col(value) <= threshold) & ~F.isnan(value), F.col(cycle))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("crossing"))


def in_blocks(seq: DataFrame, run: Callable[[DataFrame, str], DataFrame], before: int, after: int, key: str = "file", order: str = "ord", block: int = BLOCK) -> DataFrame:
    """run(seq, key) for operators that see at most `before` rows back and `after` ahead of a row, with every file cut into blocks.

    A block is given to run as a file of its own, under another key column that it must group by, and holds the rows
    that its windows see of its neighbours; of its results those for its own rows stay. run must keep the columns of seq
    and return a row for its own row only. Places are counted by ranges, so that no task holds a whole file.
    """
    if block <= max(before, after):
        raise ValueError("a block is larger than what a row sees")
    laid = numbered_by_ranges(seq, (key,), [order], "_place").withColumn("_place", F.col("_place") - 1)
    own = F.floor(F.col("_place") / block).cast("long")
    inside = F.col("_place") % block
    copies = F.array(own, F.when(inside >= block - before, own + 1), F.when(inside < after, own - 1))
    dealt = laid.withColumn("_own", own).withColumn("_block", F.explode(F.filter(copies, lambda b: b >= 0)))
    dealt = dealt.withColumn("_key", F.struct(F.col(key).alias("key"), F.col("_block").alias("block")))
    out = run(dealt, "_key")
    return out.filter("_own = _block").drop("_place", "_own", "_block", "_key")
