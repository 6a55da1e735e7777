"""Regression, end-of-life, group-wise and paired metrics of predictions.

Pairs with a null, NaN or infinite side do not count, unless an operator says otherwise. Every report is
one aggregate (the end-of-life error needs one more, by cell), so that partial sums combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..session import checkpointed
from .quantiles import quantiles

GUARD, EOL, WITHIN = 1e-8, 0.8, 0.15


def finite_pairs(rows: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """rows whose two sides are finite numbers."""
    return rows.filter(finite(F.col(actual)).isNotNull() & finite(F.col(pred)).isNotNull())


def percent_error(actual: Column, pred: Column) -> Column:
    """|error| over |actual|, which counts as 1e-8 at least."""
    return F.abs(pred - actual) / F.greatest(F.abs(actual), F.lit(GUARD))


def regression_aggs(actual: str = "actual", pred: str = "pred") -> list[Column]:
    """n, RMSE, MAE, MAPE_percent, R2 (null if the actual values do not vary)."""
    y, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    error = p - y
    spread = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("n"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.avg(F.abs(error)).alias("MAE"),
        (F.avg(percent_error(y, p)) * 100).alias("MAPE_percent"),
        F.when(spread > 0, 1 - F.sum(error * error) / spread).alias("R2"),
    ]


def regression_metrics(rows: DataFrame, by: tuple[str, ...] = (), actual: str = "actual", pred: str = "pred") -> DataFrame:
    """One row of n, RMSE, MAE, MAPE_percent, R2 per group over finite pairs."""
    return finite_pairs(rows, actual, pred).groupBy(*by).agg(*regression_aggs(actual, pred))


def strict_regression_metrics(rows: DataFrame, by: tuple[str, ...] = (), actual: str = "actual", pred: str = "pred") -> DataFrame:
    """regression_metrics, raising when it is run over a table without a finite pair."""
    out = regression_metrics(rows, by, actual, pred)
    return out.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no finite pair of actual and predicted values")).cast("long")))


def accuracy_within(rows: DataFrame, share: float = WITHIN, by: tuple[str, ...] = (), actual: str = "actual", pred: str = "pred") -> DataFrame:
    """(n, MAPE_percent, accuracy): share of predictions within `share` of the actual value. No finite filter; pairs with a null side do not count."""
    ape = percent_error(F.col(actual).cast("double"), F.col(pred).cast("double"))
    return rows.groupBy(*by).agg(F.count(ape).alias("n"), (F.avg(ape) * 100).alias("MAPE_percent"), F.avg((ape <= share).cast("double")).alias("accuracy"))


def crossings(rows: DataFrame, by: tuple[str, ...], threshold: float = EOL, cell: str = "cell_id", cycle: str = "target_cycle", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """(by, cell, actual_crossing, pred_crossing): first cycles at or below the threshold. Null cells are left out."""
    first = lambda c: F.min(F.when((F.col(c) <= threshold) & ~F.isnan(F.col(c).cast("double")), F.col(cycle)))
    return rows.filter(F.col(cell).isNotNull()).groupBy(*by, cell).agg(first(actual).alias("actual_crossing"), first(pred).alias("pred_crossing"))


def eol_error(rows: DataFrame, by: tuple[str, ...] = (), threshold: float = EOL, cell: str = "cell_id", cycle: str = "target_cycle", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """(by, n_cells, EOL_Error_cycles): mean absolute difference of the crossings of cells that have both; null if none has."""
    each = crossings(rows, by, threshold, cell, cycle, actual, pred)
    apart = F.abs(F.col("pred_crossing") - F.col("actual_crossing"))
    return each.groupBy(*by).agg(F.count(apart).alias("n_cells"), F.avg(apart).alias("EOL_Error_cycles"))


def group_metrics(rows: DataFrame, groups: tuple[str, ...], cell: str = "cell_id", cycle: str = "target_cycle", actual: str = "actual", pred: str = "pred", threshold: float = EOL) -> DataFrame:
    """The same metrics for several independent groupings, null groups kept: group_by, group_value, n_samples, n_cells, cycle range, metrics.

    The labels are stacked, so that each sample meets each grouping once; sums and crossings are taken by
    grouping and cell, and those few rows by grouping. Squares are of differences to the threshold, near
    which the values lie, so that their sums do not cancel.
    """
    label = F.explode(F.array(*(F.struct(F.lit(g).alias("group_by"), F.col(g).cast("string").alias("group_value")) for g in groups)))
    stacked = rows.select(cell, cycle, actual, pred, label.alias("g")).select("*", "g.*").drop("g")
    good = finite(F.col(actual)).isNotNull() & finite(F.col(pred)).isNotNull()
    y, p = F.when(good, F.col(actual).cast("double")), F.when(good, F.col(pred).cast("double"))
    first = lambda c: F.min(F.when((F.col(c) <= threshold) & ~F.isnan(F.col(c).cast("double")), F.col(cycle)))
    sums = {"n": F.count(y), "e2": F.sum((p - y) * (p - y)), "e1": F.sum(F.abs(p - y)), "ape": F.sum(percent_error(y, p)), "y1": F.sum(y - threshold), "y2": F.sum((y - threshold) * (y - threshold))}
    keys = ("group_by", "group_value")
    cells = stacked.groupBy(*keys, cell).agg(F.count("*").alias("all"), F.min(cycle).alias("from"), F.max(cycle).alias("to"), *(c.alias(k) for k, c in sums.items()), first(actual).alias("a"), first(pred).alias("p"))
    total = {k: F.sum(k) for k in sums}
    spread = total["y2"] - total["y1"] * total["y1"] / total["n"]
    some = lambda c: F.when(total["n"] > 0, c)
    apart = F.when(F.col(cell).isNotNull(), F.abs(F.col("p") - F.col("a")))
    return cells.groupBy(*keys).agg(
        F.sum("all").alias("n_samples"), F.count(cell).alias("n_cells"), F.min("from").alias("target_cycle_min"), F.max("to").alias("target_cycle_max"),
        some(F.sqrt(total["e2"] / total["n"])).alias("RMSE"), some(total["e1"] / total["n"]).alias("MAE"), some(total["ape"] / total["n"] * 100).alias("MAPE_percent"),
        some(F.when(spread > 0, 1 - total["e2"] / spread)).alias("R2"), F.avg(apart).alias("EOL_Error_cycles"),
    )


def cell_metrics(rows: DataFrame, by: tuple[str, ...] = ("cell_id",), actual: str = "actual", pred: str = "pred") -> DataFrame:
    """(by, n, RMSE, MAE, bias) per cell; bias is the mean of predicted - actual. Null keys are left out."""
    rows = rows.dropna(subset=list(by))
    error = F.col(pred).cast("double") - F.col(actual).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("RMSE"), F.avg(F.abs(error)).alias("MAE"), F.avg(error).alias("bias"))


def paired_improvement(rows: DataFrame, reference: DataFrame, key: tuple[str, ...], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """(n, mean_gain, median_gain, improved): how much smaller the absolute errors are than the reference model's on the same samples.

    The median is exact and found when this is called.
    """
    error = F.abs(F.col(pred).cast("double") - F.col(actual).cast("double"))
    pairs = rows.select(*key, error.alias("error")).join(reference.select(*key, error.alias("ref_error")), list(key))
    gains = checkpointed(pairs.select((F.col("ref_error") - F.col("error")).alias("gain")))
    middle = quantiles(gains, {"gain": (F.col("gain"), 0.5)})["gain"]
    return gains.agg(F.count("*").alias("n"), F.avg("gain").alias("mean_gain"), F.lit(middle).cast("double").alias("median_gain"), F.avg((F.col("gain") > 0).cast("double")).alias("improved"))


def delta_summary(rows: DataFrame, baseline: str = "baseline", delta: str = "pred_delta", pred: str = "pred", actual_delta: str = "actual_delta") -> DataFrame:
    """Means and sample deviations of actual and predicted changes, and the largest |pred - (baseline + change)|."""
    apart = F.abs(F.col(pred) - (F.col(baseline) + F.col(delta)))
    return rows.agg(F.count("*").alias("n"), F.avg(actual_delta).alias("actual_delta_mean"), F.avg(delta).alias("pred_delta_mean"), F.stddev_samp(actual_delta).alias("actual_delta_std"), F.stddev_samp(delta).alias("pred_delta_std"), F.max(apart).alias("reconstruction_error"))
