"""Schemas of the data model: nested cell files, exploded cycles, samples, predictions, metric rows."""

from __future__ import annotations

from pyspark.sql import types as T

_floats = T.ArrayType(T.FloatType())

CYCLE = T.StructType([
    T.StructField("cycle_number", T.IntegerType()),
    T.StructField("voltage_in_V", _floats),
    T.StructField("current_in_A", _floats),
    T.StructField("discharge_capacity_in_Ah", _floats),
])

#: One row per device file.
CELL_FILE = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("cell_id", T.StringType()),
    T.StructField("nominal_capacity_in_Ah", T.DoubleType()),
    T.StructField("cycle_data", T.ArrayType(CYCLE)),
])

#: Metric rows of an experiment: known columns first, extras behind them.
METRIC_COLUMNS = ("model", "val_RMSE", "val_MAE", "val_MAPE_percent", "val_R2", "val_EOL_Error_cycles", "RMSE", "MAE", "MAPE_percent", "R2", "EOL_Error_cycles")
METRICS = T.StructType([T.StructField(c, T.StringType() if c == "model" else T.DoubleType()) for c in METRIC_COLUMNS])

#: A prediction with its sample's metadata.
PREDICTION = T.StructType([
    T.StructField("sample_id", T.LongType(), False),
    *(T.StructField(c, T.StringType()) for c in ("file", "cell_id", "sample_split", "battery_domain", "experiment_condition")),
    *(T.StructField(c, T.IntegerType()) for c in ("input_start_cycle", "input_end_cycle", "target_cycle", "horizon", "split_gap_samples")),
    *(T.StructField(c, T.DoubleType()) for c in ("actual_soh", "pred_soh", "residual", "baseline_soh", "model_output", "model_target", "actual_delta_soh", "pred_delta_soh")),
])

SCENARIO = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("lookback_cycles", T.IntegerType()),
    T.StructField("horizon", T.IntegerType()),
    T.StructField("description", T.StringType()),
])
