"""Projections: constants in front, prefixes, column order, keys of several columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_constants(rows: DataFrame, **values) -> DataFrame:
    """rows with constant columns in front; a column of the same name gives way."""
    return rows.select(*(F.lit(v).alias(k) for k, v in values.items()), *(c for c in rows.columns if c not in values))


def prefixed(rows: DataFrame, prefix: str, columns: tuple[str, ...]) -> DataFrame:
    """rows with some columns renamed."""
    return rows.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def known_first(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """The known columns that rows has, in their order, then the others in theirs."""
    own = [c for c in known if c in rows.columns]
    return rows.select(*own, *(c for c in rows.columns if c not in own))


def without(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.drop(*columns)


def key_of(*columns: str, named: bool = False) -> Column:
    """One text of several columns, joined by |; with names, as name=value. Missing values are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", *(F.concat(F.lit(f"{c}="), text(c)) if named else text(c) for c in columns))


def enriched(rows: DataFrame, plan: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of their plan row (configuration, seeds, shapes) that they lack."""
    extra = [c for c in plan.columns if c not in rows.columns]
    return rows.join(plan.select(*on, *extra), on, "left")


def filled_path(rows: DataFrame, column: str, existing: DataFrame, expected: Column) -> DataFrame:
    """rows with a missing path set to the expected one where such a file exists (`existing`: column path)."""
    files = existing.select(F.col("path").alias("_path"))
    met = rows.withColumn("_expected", expected).join(files, F.col("_expected") == F.col("_path"), "left")
    return met.withColumn(column, F.coalesce(column, "_path")).drop("_expected", "_path")
