"""Successive pruning of trials: all trials of a rung are scored in one pass over its samples, and the median rule decides who goes on."""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import artefacts
from ..functions.numbers import finite, spread_score
from .experiments import grid

SCORES = "trial int, rung int, error double, score double, state string"


def rung_errors(samples: DataFrame, trials: dict[int, dict], error: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """(trial, error): mean finite error of each trial over all samples, in one pass.

    Trials (number -> parameters of one form) are literals of the plan: a sample meets them in a projection, and is
    summed up per trial before anything is shuffled. error(param) gets a function from a parameter's name to its column.
    """
    literals = F.array(*(F.struct(F.lit(n).alias("trial"), *(F.lit(v).alias(k) for k, v in p.items())) for n, p in trials.items()))
    each = samples.withColumn("_trial", F.explode(literals))
    return each.groupBy(F.col("_trial.trial").alias("trial")).agg(F.avg(finite(error(lambda k: F.col(f"_trial.{k}")))).alias("error"))


def running(errors: list[float], weight: float = 0.0) -> float:
    """Mean of a trial's errors so far and `weight` times their sample deviation."""
    return statistics.fmean(errors) + (weight * statistics.stdev(errors) if len(errors) > 1 else 0.0)


def survivors(scores: dict[int, float], rung: int, startup: int = 3, warmup: int = 1) -> list[int]:
    """Trials that go on: from rung `warmup` on, and while there are `startup` trials, those no worse than the median of all that reached the rung."""
    if rung < warmup or len(scores) < startup:
        return sorted(scores)
    middle = statistics.median(scores.values())
    return sorted(t for t, s in scores.items() if s <= middle)


def race(samples: DataFrame, step: str, trials: list[dict], error: Callable[[Callable[[str], Column]], Column], weight: float = 0.0, startup: int = 3, warmup: int = 1, store: str | None = None) -> DataFrame:
    """(trial, rung, error, score, state) of every rung that a trial reached; state is complete, pruned or failed at its last one, else running.

    The values of `step` are the rungs, in order; one job each. A rung's samples are read for the trials that are left. A
    trial without a finite error at a rung has failed. The driver holds a number per trial and rung. With `store`, a
    folder that outlives the application, each rung's errors are published there, and a race of the same trials that
    begins again reads what it finds and goes on as it would have.
    """
    spark, alive = samples.sparkSession, dict(enumerate(trials))
    rungs = [r[0] for r in samples.select(step).filter(F.col(step).isNotNull()).distinct().orderBy(step).collect()]
    errors: dict[int, list[float]] = {n: [] for n in alive}
    rows = []
    for k, value in enumerate(rungs):
        if not alive:
            break
        got = _stored(spark, f"{store}/rung-{k}", alive) if store else None
        if got is None:
            got = dict(rung_errors(samples.filter(F.col(step) == F.lit(value)), alive, error).collect())
            if store:
                found = spark.createDataFrame([(n, repr(p), got.get(n)) for n, p in alive.items()], "trial int, parameters string, error double")
                artefacts.publish(spark, f"{store}/rung-{k}", {"errors": found})
        failed = [n for n in alive if got.get(n) is None or not math.isfinite(got[n])]
        for n in set(alive) - set(failed):
            errors[n].append(got[n])
        scores = {n: running(errors[n], weight) for n in alive if n not in failed}
        on = set(survivors(scores, k, startup, warmup))
        last = k == len(rungs) - 1
        for n in sorted(alive):
            state = "failed" if n in failed else "pruned" if n not in on else "complete" if last else "running"
            rows.append((n, k, got.get(n), scores.get(n), state))
        alive = {n: p for n, p in alive.items() if n in on}
    return spark.createDataFrame(rows, SCORES)


def _stored(spark: SparkSession, path: str, alive: dict[int, dict]) -> dict[int, float] | None:
    """The errors of a rung that an earlier race of these trials published, if it did."""
    if not artefacts.versions(spark, path):
        return None
    rows = artefacts.table(spark, path, "errors").collect()
    if {(r.trial, r.parameters) for r in rows} != {(n, repr(p)) for n, p in alive.items()}:
        raise ValueError(f"{path} holds another race")
    return {r.trial: r.error for r in rows}


def staged(samples: DataFrame, base: dict, stages: list[dict[str, list]], error: Callable[[Callable[[str], Column]], Column]) -> tuple[dict, DataFrame]:
    """(best configuration, (stage, trial, error, is_best, <key>...)): coordinate search, each stage's grid scored in one pass over the samples.

    A stage tries the grid of some keys with the rest held, and its best, the first of several, is carried on; a
    configuration without a finite error is never the best.
    """
    best, rows, names = dict(base), [], list(base)
    for number, stage in enumerate(stages):
        tried = [best | change for change in grid(stage)]
        got = dict(rung_errors(samples, dict(enumerate(tried)), error).collect())
        errors = [got.get(k) if got.get(k) is not None and math.isfinite(got[k]) else math.inf for k in range(len(tried))]
        first = min(range(len(tried)), key=lambda k: (errors[k], k))
        rows += [(number, k, got.get(k), k == first, *(float(t[n]) for n in names)) for k, t in enumerate(tried)]
        best = tried[first]
    return best, samples.sparkSession.createDataFrame(rows, "stage int, trial int, error double, is_best boolean, " + ", ".join(f"`{n}` double" for n in names))


def confirmed(samples: DataFrame, seed: str, trials: list[dict], error: Callable[[Callable[[str], Column]], Column], baseline: Column, weight: float = 1.0, penalty: float = 1.0) -> DataFrame:
    """(trial, mean, std, gain, score, place): candidates over all seeds in one pass, those that gain on the baseline first, then by spread score.

    mean and std are over the seeds' mean errors, gain is the mean of how much less they are than the baseline's.
    """
    literals = F.array(*(F.struct(F.lit(n).alias("trial"), *(F.lit(v).alias(k) for k, v in p.items())) for n, p in enumerate(trials)))
    each = samples.withColumn("_base", finite(baseline)).withColumn("_trial", F.explode(literals))
    by_seed = each.groupBy(F.col("_trial.trial").alias("trial"), seed).agg(F.avg(finite(error(lambda k: F.col(f"_trial.{k}")))).alias("error"), F.avg("_base").alias("base"))
    own = by_seed.groupBy("trial").agg(F.avg("error").alias("mean"), F.coalesce(F.stddev_samp("error"), F.lit(0.0)).alias("std"), F.avg(F.col("base") - F.col("error")).alias("gain"))
    own = own.withColumn("score", spread_score(F.col("mean"), F.col("std"), weight, F.col("gain"), penalty))
    order = [F.coalesce(F.col("gain") > 0, F.lit(False)).desc(), F.asc_nulls_last("score"), F.asc("trial")]
    return own.withColumn("place", F.row_number().over(W.orderBy(*order)))  # a row per candidate
