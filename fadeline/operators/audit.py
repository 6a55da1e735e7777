"""Audits: split policies, purity, completeness, header checks. Violations are rows; a clean table gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels

# Datasets of the lithium-ion policy, and those it excludes.
LIION = ("CALB", "CALCE", "HNEI", "HUST", "ISU_ILCC", "MATR", "MICH", "MICH_EXP", "RWTH", "SDU", "SNL", "Stanford", "Stanford_2", "Tongji", "UL_PUR", "XJTU")
EXCLUDED = ("NA-ion", "ZN-coin")
# What marks outputs of tuned configurations in a path or name.
TUNED_MARKERS = ("tuned", "optuna", "tuning_outputs", "optimization_outputs", "refine", "adaptive", "successive", "locked_test", "final_hybrid", "final_delta_hybrid")
# What a header that speaks of a metric holds, and the one key about tests that a selection must have.
METRIC_TOKENS = ("mae", "rmse", "mape", "r2", "skill", "metric")
HONEST = "test_metrics_used"


def _listed(items: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(items)), ", ")


def split_policy(splits: DataFrame, liion_only: bool = True) -> DataFrame:
    """splits (split_mode, split_gap, early_cycle, <split>_files, optionally <split>_conditions) with failures, warnings, policy_ok.

    One row per split description; null lists count as empty, a null mode as file-level.
    """
    files = {s: F.coalesce(F.col(f"{s}_files"), F.expr("cast(array() as array<string>)")) for s in ("train", "val", "test")}
    every = F.array_distinct(F.concat(*files.values()))
    datasets = F.transform(every, lambda f: labels.dataset(f, F.lit("unknown")))
    excluded = F.filter(datasets, lambda d: d.isin(*EXCLUDED))
    outside = F.filter(datasets, lambda d: ~d.isin(*LIION))
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    repeated = F.concat(*(F.array_intersect(files[a], files[b]) for a, b in pairs))
    again = F.size(repeated) > 0
    mode, gap, early = F.coalesce("split_mode", F.lit("file-level")), F.coalesce("split_gap", F.lit(0)), F.coalesce("early_cycle", F.lit(0))
    gapped = mode == "condition-gap-within-file"
    checks = []
    if liion_only:
        checks.append(F.when(F.size(excluded) > 0, F.concat(F.lit("split uses excluded datasets: "), _listed(excluded))))
        checks.append(F.when(F.size(outside) > 0, F.concat(F.lit("split uses datasets outside the policy: "), _listed(outside))))
    checks.append(F.when(again & gapped & (gap < 20), F.concat(F.lit("condition-gap split needs a gap of 20, has "), gap.cast("string"))))
    checks.append(F.when(again & gapped & (early > 20), F.concat(F.lit("condition-gap split takes 20 cycles at most, has "), early.cast("string"))))
    checks.append(F.when(again & ~gapped, F.lit("files stand in several splits outside condition-gap mode")))
    checks.append(F.when(mode == "chronological-within-file", F.lit("chronological-within-file is no final split policy")))
    checks.append(F.when(again & mode.isin("battery", "file-level"), F.lit("file-level split has overlapping files")))
    if {f"{s}_conditions" for s in files} <= set(splits.columns):
        shared = F.concat(*(F.array_intersect(f"{a}_conditions", f"{b}_conditions") for a, b in pairs))
        checks.append(F.when((mode == "condition-group") & (F.size(shared) > 0), F.concat(F.lit("condition-group split has overlapping conditions: "), _listed(shared))))
    checks.append(F.when(F.size(files["test"]) == 0, F.lit("no test files")))
    kept = lambda found: F.filter(F.array(*found), lambda x: x.isNotNull())
    warned = [F.when(F.array_contains(datasets, "unknown"), F.lit("some files belong to no known dataset"))]
    if "train_conditions" not in splits.columns:
        warned.append(F.lit("no conditions are given, so that none can be audited"))
    out = splits.withColumn("failures", kept(checks)).withColumn("warnings", kept(warned))
    return out.withColumn("policy_ok", F.size("failures") == 0)


def tuned_risk(rows: DataFrame, *texts: str) -> DataFrame:
    """rows with tuned_markers: those found in the texts (paths, names), comma-separated; empty if none."""
    return rows.withColumn("tuned_markers", labels.markers_in([F.col(t) for t in texts], TUNED_MARKERS))


def inventory(files: DataFrame, expected: list[str], excluded: tuple[str, ...] = EXCLUDED, path: str = "path") -> DataFrame:
    """(dataset, n, status): datasets of the files present, allowed or excluded or unexpected, and the expected ones missing."""
    seen = files.groupBy(labels.dataset(F.col(path), F.lit("unknown")).alias("dataset")).agg(F.count("*").alias("n"))
    wanted = files.sparkSession.createDataFrame([(x,) for x in expected], "expected string")
    both = seen.join(wanted, F.col("dataset") == F.col("expected"), "full_outer")
    status = F.when(F.col("dataset").isNull(), "missing").when(F.col("dataset").isin(*excluded), "excluded").when(F.col("expected").isNull(), "unexpected").otherwise("allowed")
    return both.select(F.coalesce("dataset", "expected").alias("dataset"), F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def impure(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is not allowed, null included."""
    return rows.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def completeness(rows: DataFrame, by: tuple[str, ...], column: str, expected: int) -> DataFrame:
    """(by, n, complete): distinct values against the number expected."""
    return rows.groupBy(*by).agg(F.count_distinct(column).alias("n")).withColumn("complete", F.col("n") == expected)


def validate_outputs(
    files: DataFrame, prefix: str, splits: DataFrame, fitted: DataFrame, selected: DataFrame, headers: DataFrame, results: DataFrame, horizons: list[int], baseline: str = "persistence"
) -> DataFrame:
    """(check, violations, examples): what a validation run must hold, a row for each check; 0 violations if it does.

    files (path): all of one dataset, by prefix of the name. splits (run, key, split): no key in two splits of
    a run. fitted (name, fitted_split, key, split): normalisers, fitted on train, whose keys are in no other split
    of theirs. selected (key, value): the chosen model's fields, with test_metrics_used false and no other that
    begins with test_. headers (column): no test metrics. results (model, horizon): the baseline at every
    horizon. Null keys are left out. Examples are the first three in order.
    """
    name = labels.name_of(F.col("path"))
    mixed = splits.filter("key is not null and split is not null").groupBy("run", "key").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    own = fitted.filter(F.col("key").isNotNull())
    shared = own.groupBy("name", "key").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") != "train").alias("b")).filter("a > 0 and b > 0")
    said = selected.filter(F.col("key") == HONEST).agg(F.count_if(F.lower(F.col("value").cast("string")) == "false").alias("n")).filter("n = 0")
    wanted = results.sparkSession.createDataFrame([(h,) for h in horizons], "horizon long")
    have = results.filter(F.col("model") == baseline).select(F.col("horizon").cast("long").alias("horizon")).distinct()
    found = {
        "one dataset": files.filter(~F.coalesce(name.startswith(prefix), F.lit(False))).select(name.alias("x")),
        "splits are disjoint": mixed.select(F.concat_ws("/", "run", "key").alias("x")),
        "normalisers are fitted on train": fitted.filter(~F.coalesce(F.col("fitted_split") == "train", F.lit(False))).select(F.col("name").alias("x")).distinct(),
        "normaliser keys are train's alone": shared.select(F.concat_ws("/", "name", "key").alias("x")),
        "test_metrics_used is false": said.select(F.lit(HONEST).alias("x")),
        "no test field is selected": selected.filter(F.lower("key").startswith("test_") & (F.col("key") != HONEST)).select(F.col("key").alias("x")),
        "no test metric in headers": test_metric_columns(headers).select(F.col("column").alias("x")),
        "baseline at every horizon": wanted.join(have, "horizon", "left_anti").select(F.col("horizon").alias("x")),
    }
    checks = files.sparkSession.createDataFrame([(c,) for c in found], "check string")
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("check"), F.col("x").cast("string").alias("x")) for c, df in found.items()))
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("check").orderBy("x"))).filter("place <= 3").groupBy("check").agg(F.array_join(F.sort_array(F.collect_list("x")), ", ").alias("examples"))
    counts = rows.groupBy("check").agg(F.count("*").alias("violations"))
    return checks.join(counts, "check", "left").join(first, "check", "left").select("check", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("examples", F.lit("")).alias("examples"))


def empty_splits(rows: DataFrame, name: str = "split", required: tuple[str, ...] = ("train", "val", "test")) -> list[str]:
    """Names of the required splits without a row. An action over a small aggregate."""
    return [r[0] for r in without_rows(rows, (), name, required).orderBy(name).collect()]


def without_rows(rows: DataFrame, by: tuple[str, ...], name: str = "split", required: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(by, split): the required splits that a group has no row of; without groups, that the table has none of."""
    wanted = rows.sparkSession.createDataFrame([(s,) for s in required], f"{name} string")
    every = rows.select(*by).distinct().crossJoin(F.broadcast(wanted)) if by else wanted  # a few names
    seen = rows.select(*by, name).distinct()
    return every.join(seen, [every[c].eqNullSafe(seen[c]) for c in (*by, name)], "left_anti")


def is_test_metric(column: Column) -> Column:
    """Whether a header names a metric of a test: it holds `test` and the name of a metric, in any case."""
    low = F.lower(column)
    return F.contains(low, F.lit("test")) & F.exists(F.array(*map(F.lit, METRIC_TOKENS)), lambda t: F.contains(low, t))


def test_metric_columns(headers: DataFrame, column: str = "column") -> DataFrame:
    """The rows of a table of headers that name test metrics."""
    return headers.filter(is_test_metric(F.col(column)))


def test_columns(columns: list[str]) -> list[str]:
    """Those of the columns of a validation output that name test metrics."""
    return [c for c in columns if "test" in c.lower() and any(t in c.lower() for t in METRIC_TOKENS)]


def reconstruction_violations(rows: DataFrame, pred: str = "pred", baseline: str = "baseline", delta: str = "pred_delta", tolerance: float = 1e-6) -> DataFrame:
    """Rows that break pred = baseline + delta."""
    return rows.filter(F.abs(F.col(pred) - (F.col(baseline) + F.col(delta))) > tolerance)


def dishonest(configs: DataFrame, flag: str = HONEST) -> DataFrame:
    """Rows of locked configurations that do not say that no test metric was used to choose them; null counts as not saying."""
    return configs.filter(~F.coalesce(~F.col(flag), F.lit(False)))


def check_locked(config: dict) -> None:
    """Raise unless a locked configuration says that no test metric was used to choose it."""
    if config.get(HONEST) is not False:
        raise ValueError("a locked configuration must state test_metrics_used: false")
