"""Selection of models under two named policies that disagree on purpose: by validation metrics alone, or by test metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import finite
from .audit import tuned_risk
from .ranking import best, rank_records

PERSISTENCE = "persistence"


def candidates(rows: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (PERSISTENCE,), path: str = "path", texts: tuple[str, ...] = ("path",), allow_failures: bool = False, drop_tuned: bool = False, drop_single: bool = False) -> DataFrame:
    """Metric rows that may be ranked by test metrics: finite RMSE, models allowed, policies kept, with the risks noted.

    rows has model, RMSE, policy_ok and the file's path; a file whose models other than persistence are
    fewer than two is a single-model file.
    """
    learned = F.collect_set(F.when(~F.col("model").isin("", PERSISTENCE), F.col("model"))).over(W.partitionBy(path))
    out = rows.withColumn("learned_models", F.array_join(F.array_sort(learned), ",")).withColumn("single_model", F.size(learned) < 2)
    out = tuned_risk(out, *texts).filter(finite(F.col("RMSE")).isNotNull())
    if include:
        out = out.filter(F.col("model").isin(*include))
    if exclude:
        out = out.filter(~F.col("model").isin(*exclude))
    if not allow_failures:
        out = out.filter("policy_ok")
    if drop_tuned:
        out = out.filter("tuned_markers = ''")
    return out.filter("not single_model") if drop_single else out


def by_test_metrics(rows: DataFrame, root: str = "output_root") -> DataFrame:
    """candidates with their global rank: least test RMSE, then MAE, then largest R2, then model and root."""
    return rank_records(rows, (), "model", root)


def validation_order(mae: str, rmse: str, mape: str, std: str, skill: str, model: str = "model") -> list[Column]:
    low = lambda c: finite(F.col(c)).asc_nulls_last()
    return [low(mae), low(rmse), low(mape), low(std), finite(F.col(skill)).desc_nulls_last(), F.col(model)]


def per_horizon(summary: DataFrame) -> DataFrame:
    """The best model of each horizon by validation metrics (MAE, RMSE, MAPE, spread of MAE, skill, name)."""
    return best(summary, ("horizon",), validation_order("MAE_mean", "RMSE_mean", "MAPE_percent_mean", "MAE_std", "skill_mean"))


def by_validation_metrics(summary: DataFrame, expected_horizons: int) -> DataFrame:
    """One row per model over all horizons, the best `selected`; a model that lacks a horizon raises when run."""
    m = summary.groupBy("model").agg(
        F.avg("MAE_mean").alias("avg_MAE"), F.avg("RMSE_mean").alias("avg_RMSE"), F.avg("MAPE_percent_mean").alias("avg_MAPE_percent"), F.coalesce(F.stddev_samp("MAE_mean"), F.lit(0.0)).alias("std_MAE"),
        F.max("MAE_mean").alias("worst_MAE"), F.avg("skill_mean").alias("avg_skill"), F.count_distinct("horizon").alias("n_horizons"),
    )
    short = F.raise_error(F.concat(F.lit("a horizon is missing for "), F.col("model"))).cast("long")
    m = m.withColumn("n_horizons", F.when(F.col("n_horizons") == expected_horizons, F.col("n_horizons")).otherwise(short))
    order = validation_order("avg_MAE", "avg_RMSE", "avg_MAPE_percent", "std_MAE", "avg_skill")
    return m.withColumn("selected", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)) == 1)  # one row per model
