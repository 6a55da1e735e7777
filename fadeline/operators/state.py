"""Roll-ups that grow batch by batch: per key and metric a small state, written per batch and merged when it is read.

A summary after the latest batch costs the size of the states, not that of the facts. A batch has a name; delivered
again it replaces its own state. `compact` merges what is there into one state that remembers which batches it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import artefacts
from ..functions.numbers import finite

STATE = ("n", "mean", "m2", "low", "high")


def batch_state(rows: DataFrame, by: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """(by, metric, n, mean, m2, low, high): finite values of each metric in each group; m2 sums squares of differences to the mean."""
    each = rows.select(*by, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), finite(F.col(m).cast("double")).alias("x")) for m in metrics))))
    n = F.count("x")
    return each.groupBy(*by, "metric").agg(n.alias("n"), F.avg("x").alias("mean"), (F.coalesce(F.var_pop("x"), F.lit(0.0)) * n).alias("m2"), F.min("x").alias("low"), F.max("x").alias("high"))


def merged(states: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One state per group and metric out of several: squares are taken about a centre near all means, so that nothing cancels. One shuffle."""
    near = F.avg("mean").over(W.partitionBy(*by, "metric"))
    off = F.col("mean") - F.col("_near")
    n, s = F.sum("n"), F.sum(F.col("n") * off)
    own = states.withColumn("_near", near).groupBy(*by, "metric")
    away = F.coalesce(F.try_divide(s, n), F.lit(0.0))
    m2 = F.sum(F.col("m2") + F.coalesce(F.col("n") * off * off, F.lit(0.0))) - n * away * away
    return own.agg(n.alias("n"), (F.first("_near", True) + away).alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))


def summary(states: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, metric, n, mean, std, min, max): std of a sample, null for one value."""
    own = merged(states, by)
    return own.select(*by, "metric", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"))


def deliver(rows: DataFrame, by: tuple[str, ...], metrics: tuple[str, ...], path: str, batch: str) -> None:
    """Write the state of one batch below path, as an artefact of the batch's name: whole or not at all, and once however often it comes."""
    artefacts.publish(rows.sparkSession, f"{path}/batches/{batch}", {"state": batch_state(rows, by, metrics)}, {"batches": [batch]})


def _batches(spark: SparkSession, path: str) -> list[str]:
    own, store = artefacts._store(spark, f"{path}/batches")
    return sorted(s.getPath().getName() for s in store.listStatus(own) if s.isDirectory()) if store.exists(own) else []


def delivered(spark: SparkSession, path: str) -> DataFrame | None:
    """The states of all batches below path, each once: the newest compaction and the batches that it does not hold. None if there are none."""
    held = artefacts.table(spark, f"{path}/compact", "batches") if artefacts.versions(spark, f"{path}/compact") else None
    names = _batches(spark, path)
    known = {r.batch: r.version for r in held.collect()} if held is not None else {}  # one name per batch, as the listing is
    newest = {b: v[-1] for b in names if (v := artefacts.versions(spark, f"{path}/batches/{b}"))}
    if any(newest.get(b, v) != v for b, v in known.items()):
        known, held = {}, None  # a batch that was compacted has come again: its old state is in a sum, so that all are read anew
    folders = [artefacts.current(spark, f"{path}/batches/{b}", newest[b]) + "/content/state" for b in newest if b not in known]
    parts = [spark.read.parquet(*folders)] if folders else []
    if held is not None:
        parts.append(artefacts.table(spark, f"{path}/compact", "state"))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, path: str, by: tuple[str, ...]) -> int:
    """Merge the states of all batches into one table; the number of its version. Batches' own states stay, for those that come again."""
    newest = [(b, v[-1]) for b in _batches(spark, path) if (v := artefacts.versions(spark, f"{path}/batches/{b}"))]
    states = delivered(spark, path)
    if states is None:
        raise ValueError(f"{path}: no batch")
    return artefacts.publish(spark, f"{path}/compact", {"state": merged(states, by), "batches": spark.createDataFrame(newest, "batch string, version int")})


