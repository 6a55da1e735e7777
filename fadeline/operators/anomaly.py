"""Anomaly scores: robust z of residual and slope (and a latent score, if given) against the validation part.

Medians, deviations and the threshold are exact and are found when an operator is called, by passes that
leave a few numbers each; what they are applied to stays lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip_low, row_mean
from ..session import checkpointed
from .quantiles import quantiles
from .windows import slope

TO_SIGMA, GUARD, QUANTILE = 1.4826, 1e-8, 0.975


def centre_and_spread(reference: DataFrame, *columns: str) -> dict[str, tuple[float | None, float | None]]:
    """column -> (median, median absolute deviation) of its finite values."""
    medians = quantiles(reference, {c: (F.col(c), 0.5) for c in columns})
    mads = quantiles(reference, {c: (F.abs(F.col(c) - F.lit(medians[c])), 0.5) for c in columns})
    return {c: (medians[c], mads[c]) for c in columns}


def scaled(rows: DataFrame, fitted: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """rows with <column>_z: (x - median) / (1.4826 * (MAD + 1e-8))."""
    return rows.withColumns({f"{c}_z": (F.col(c) - F.lit(median)) / (TO_SIGMA * (F.lit(mad) + GUARD)) for c, (median, mad) in fitted.items()})


def robust_z(rows: DataFrame, reference: DataFrame, *columns: str) -> DataFrame:
    """rows with <column>_z by the reference's median and deviation."""
    return scaled(rows, centre_and_spread(reference, *columns))


def quantile(rows: DataFrame, column: str, q: float = QUANTILE) -> DataFrame:
    """One row: the linearly interpolated quantile of the finite values."""
    return rows.sparkSession.createDataFrame([(quantiles(rows, {column: (F.col(column), q)})[column],)], "threshold double")


def anomaly_flags(test: DataFrame, validation: DataFrame, key: str = "cell_id", order: str = "target_cycle", residual: str = "residual", latent: str | None = None) -> DataFrame:
    """test with slope, <score>_z, anomaly_score and is_anomaly (above the validation scores' quantile).

    A latent score belongs to its row (by key, never by place). z below 0 counts as 0; a missing one is
    left out of the mean.
    """
    scores = [residual, "slope", *([latent] if latent else [])]
    val = checkpointed(slope(validation, key, order, residual).select(*scores))
    fitted = centre_and_spread(val, *scores)
    scored = lambda rows: scaled(rows, fitted).withColumn("anomaly_score", row_mean(*(clip_low(F.col(f"{c}_z")) for c in scores)))
    limit = quantiles(scored(val), {"limit": (F.col("anomaly_score"), QUANTILE)})["limit"]
    return scored(slope(test, key, order, residual)).withColumn("threshold", F.lit(limit)).withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") > F.col("threshold"), F.lit(False)))
