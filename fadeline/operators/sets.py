"""Set operations and membership between tables of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows; a column that a table lacks is null there, columns stand in the order first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def used(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose keys occur in the other table."""
    return rows.join(keys, on, "left_semi")


def pending(plan: DataFrame, completed: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a plan that have not been completed: what a resumed run has left to do."""
    return plan.join(completed, on, "left_anti")


def missing(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct rows expected and not present."""
    return expected.subtract(present)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def product(*tables: DataFrame) -> DataFrame:
    """Cross product of the small tables that span an experiment plan."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)


def has_all(rows: DataFrame, by: tuple[str, ...], column: str, required: list[str]) -> DataFrame:
    """(by, complete, lacking): whether each group has every required value."""
    lacking = F.array_except(F.array(*map(F.lit, required)), F.collect_set(column))
    return rows.groupBy(*by).agg(F.sort_array(lacking).alias("lacking")).withColumn("complete", F.size("lacking") == 0)
