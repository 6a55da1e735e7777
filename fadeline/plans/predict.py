"""Predictors by name. Persistence is native; others are functions on Arrow batches, or tables of predictions made elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, positions, windows

# Names of the models in their usual order.
MODEL_ORDER = (
    "persistence", "cpmlp", "cpmlp_gru_fusion", "cpgru", "cpmlp_cpgru_fusion", "cpmlp_dsconv_fusion", "cpmlp_dsconv_nogru", "cpdsconv", "cpmlp_cpdsconv_fusion",
    "cpmlp_gru_residual", "flatten_mlp", "curve_cnn", "gru_only", "gru_dsconv",
)

_registered: dict[str, tuple[Callable, str]] = {}


def register(name: str, predict: Callable, schema: str) -> None:
    """A predictor: an iterator of Arrow batches to an iterator of batches in `schema`."""
    _registered[name] = (predict, schema)


_tables: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {}


def register_table(name: str, predict: Callable[[DataFrame], DataFrame], needs: list[str]) -> None:
    """A predictor as a function of a table that adds `pred`, such as a trained network; needs are the columns that it reads."""
    _tables[name] = (predict, needs)


def parse_models(text: str) -> list[str]:
    """Names of a comma-separated list, each once; `all` is every known one. Unknown names are an error."""
    names = list(dict.fromkeys(filter(None, (x.strip() for x in text.split(",")))))
    known = [*MODEL_ORDER, *(n for n in (*_registered, *_tables) if n not in MODEL_ORDER)]
    if names == ["all"]:
        return known
    if lacking := [n for n in names if n not in known]:
        raise ValueError(f"unknown models: {', '.join(lacking)}")
    return names


def predict(name: str, samples: DataFrame, lookback: int | None = None, horizon: int | None = None, external: DataFrame | None = None, key: str = "sample_id", by_place: str | None = None) -> DataFrame:
    """samples with `pred`: native persistence, a registered function, or an external table joined by key.

    Where predictions come without a key, `by_place` names the column of both tables that `positions` gave them; tables
    of different lengths raise.
    """
    if external is not None and by_place:
        return positions.zipped(samples, external.select(by_place, "pred"), by_place)
    if external is not None:
        return samples.join(external.select(key, "pred"), key)
    if name in _tables:
        function, needs = _tables[name]
        if lacking := [c for c in needs if c not in samples.columns]:
            raise ValueError(f"{name} needs {', '.join(lacking)}")
        return function(samples)
    if name in _registered:
        function, schema = _registered[name]
        return samples.mapInArrow(function, schema)
    if name == "persistence":
        if lookback is None or horizon is None:
            raise ValueError("persistence needs the look-back and horizon")
        return windows.persistence(samples, lookback, horizon)
    raise ValueError(f"{name} has no runtime here: register a function or pass its predictions")


def evaluate(name: str, samples: DataFrame, by: tuple[str, ...] = ("seed", "horizon"), actual: str = "actual", **how) -> DataFrame:
    """(by, model, n, RMSE, MAE, MAPE_percent, R2) of one predictor for each run of samples, such as (seed, horizon); a table without a finite pair raises when run."""
    scored = metrics.strict_regression_metrics(predict(name, samples, **how), by, actual, "pred")
    return scored.select(*by, F.lit(name).alias("model"), "n", "RMSE", "MAE", "MAPE_percent", "R2")
