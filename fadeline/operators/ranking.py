"""Ranks, tops and deduplication. Every order ends in a unique key, so that results do not depend on the plan."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import finite, or_inf, or_neg_inf
from ..session import checkpointed


def metric_order(*tie: str, rmse: str = "RMSE", mae: str = "MAE", r2: str = "R2") -> list[Column]:
    """Least RMSE, then MAE, then largest R2, missing ones last, then the names given."""
    return [or_inf(F.col(rmse)), or_inf(F.col(mae)), or_neg_inf(F.col(r2)).desc(), *map(F.col, tie)]


def rank_records(rows: DataFrame, by: tuple[str, ...], *tie: str, **names: str) -> DataFrame:
    """rows with rank (1.. in each group, no ties) and is_best. Without groups all rows rank together."""
    order = metric_order(*tie, **names)
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))) if by else ranked_together(rows, order, "rank")
    return out.withColumn("is_best", F.col("rank") == 1)


def ranked_together(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place among all rows, from 1: sorted by ranges, each of which counts on from those before it.

    The sorted ranges are written once, to the checkpoint folder, so that counts and places come from the
    same ranges. The driver holds one count per range.
    """
    laid = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = dict(laid.groupBy(F.spark_partition_id()).count().collect())
    before = list(accumulate((counts.get(k, 0) for k in range(max(counts, default=0))), initial=0))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower 33 bits count the rows of a partition
    return laid.withColumn(name, F.get(F.lit(before), F.spark_partition_id()) + place + 1)


def top_k(rows: DataFrame, by: tuple[str, ...], order: list, k: int) -> DataFrame:
    """The first k rows of each group in the order given, with their place from 1."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def numbered(rows: DataFrame, by: tuple[str, ...], order: list, name: str = "place") -> DataFrame:
    """rows with their place in their group, from 1."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def numbered_by_ranges(rows: DataFrame, by: tuple[str, ...], order: list, name: str = "place") -> DataFrame:
    """`numbered` for groups that hold a large share of the rows: a group is sorted in ranges over many tasks, and each range counts on from those before it."""
    return running_total(rows, by, order, F.lit(1), name)


def running_total(rows: DataFrame, by: tuple[str, ...], order: list, value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of their group up to and including their own, in an order without ties.

    Group and order are cut into ranges; what is joined back is one total per group and range that holds it.
    """
    laid = checkpointed(rows.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    own = F.sum("_value").over(W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    totals = laid.groupBy("_range", *by).agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(F.col("_range").alias("_of"), *(F.col(c).alias(f"_{c}_of") for c in by), F.coalesce(before, F.lit(0)).alias("_before"))
    met = laid.withColumn(name, own).join(totals, [F.col("_range") == F.col("_of"), *(F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in by)])
    return met.withColumn(name, F.col(name) + F.col("_before")).drop("_value", "_range", "_of", "_before", *(f"_{c}_of" for c in by))


def average_rank_by_ranges(rows: DataFrame, by: tuple[str, ...], column: str, name: str) -> DataFrame:
    """rows with the rank of their value in their group, ties sharing their mean rank; missing and NaN values stay unranked.

    For groups that hold a large share of the rows: equal values are counted first, and the counts summed in ranges.
    """
    kept = rows.withColumn("_rank_of", finite(F.col(column)))
    ties = kept.filter("_rank_of is not null").groupBy(*by, "_rank_of").agg(F.count("*").alias("_ties"))
    ties = running_total(ties, by, ["_rank_of"], F.col("_ties"), "_upto").select(*(F.col(c).alias(f"_{c}_at") for c in by), F.col("_rank_of").alias("_at"), (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name))
    met = kept.join(ties, [F.col("_rank_of") == F.col("_at"), *(F.col(c).eqNullSafe(F.col(f"_{c}_at")) for c in by)], "left")
    return met.drop("_rank_of", "_at", *(f"_{c}_at" for c in by))


def best(rows: DataFrame, by: tuple[str, ...], order: list) -> DataFrame:
    """The first row of each group."""
    return top_k(rows, by, order, 1).drop("place")


def keep_best_then_latest(rows: DataFrame, keys: tuple[str, ...], has: tuple[str, ...], order: str) -> DataFrame:
    """One row per key: the one that has most of the columns `has` in their order of weight, then the latest."""
    first = [F.coalesce(finite(F.col(c)), F.lit(None)).isNotNull().desc() if dict(rows.dtypes)[c] in ("double", "float") else F.col(c).isNotNull().desc() for c in has]
    return best(rows, keys, [*first, F.col(order).desc()])


def distinct_top(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The k best rows with different keys."""
    return best(rows, (key,), order).orderBy(*order, key).limit(k)


def winners_first(rows: DataFrame, gain: str, order: list) -> DataFrame:
    """rows ordered with those that gain first, the given order within."""
    return rows.orderBy((F.coalesce(F.col(gain), F.lit(0.0)) > 0).desc(), *order)


def unique_in_order(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(column, order): distinct values at their first place."""
    return rows.groupBy(column).agg(F.min(order).alias(order))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def sorted_rows(rows: DataFrame, keys: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """rows by those of the keys that they have; missing and NaN values last, whichever way."""
    kinds = dict(rows.dtypes)
    value = lambda c: finite(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    return rows.orderBy(*(value(c).desc_nulls_last() if c in descending else value(c).asc_nulls_last() for c in keys if c in kinds))
