"""Tables that belong together by place: rows get their place in the table, and two tables are laid side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .ranking import ranked_together


def ordered(rows: DataFrame, *order, name: str = "position") -> DataFrame:
    """rows with their place, from 0, in an order that has no ties."""
    return ranked_together(rows, [F.col(c) if isinstance(c, str) else c for c in order], name).withColumn(name, F.col(name) - 1)


def as_read(rows: DataFrame, name: str = "position") -> DataFrame:
    """rows of a scan of files, not yet filtered or joined, with their place, from 0: files by path, each from its beginning.

    However the scan is dealt to tasks. Rows are written once with their file, the block of it that a task read, and a
    number that grows within the block; what is joined back is one offset per block.
    """
    tagged = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    laid = checkpointed(tagged)
    blocks = laid.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a row per block of a file: blocks are few beside rows
    before = F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    met = laid.join(blocks, ["_file", "_block"])
    return met.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def zipped(a: DataFrame, b: DataFrame, name: str = "position") -> DataFrame:
    """The rows of two tables side by side, by a place that both have from 0 on without gaps.

    Raises when it is called if one is longer than the other, if places have gaps or repeats, or a column stands in both.
    """
    if again := {c.lower() for c in a.columns} & {c.lower() for c in b.columns} - {name.lower()}:
        raise ValueError(f"columns of both tables: {', '.join(sorted(again))}")
    at = F.col(name).cast("decimal(38,0)")
    sizes = [t.agg(F.count("*"), F.min(name), F.max(name), F.sum(at), F.sum(at * at)).first() for t in (a, b)]  # sums tell gaps and repeats without a shuffle
    for n, low, high, total, squares in sizes:
        if n and (low, high, total, squares) != (0, n - 1, n * (n - 1) // 2, (n - 1) * n * (2 * n - 1) // 6):
            raise ValueError(f"{name} is no place: {n} rows, places from {low} to {high}")
    if sizes[0][0] != sizes[1][0]:
        raise ValueError(f"tables of {sizes[0][0]} and {sizes[1][0]} rows")
    return a.join(b, name)
