"""Reference operators against values worked out by hand, numpy or pandas."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fadeline import sinks
from fadeline.functions import arrays, labels, numbers
from fadeline.operators import anomaly, audit, isolation, metrics, normalize, ranking, rollup, sets, splits, windows
from fadeline.plans import experiments, predict

NAN = float("nan")


def one(df):
    return df.collect()[0]


# --- splits ---


@pytest.mark.parametrize(("gap", "want"), [
    (0, {3: (1, 1, 1), 5: (3, 1, 1), 10: (6, 2, 2), 20: (14, 3, 3), 30: (22, 4, 4), 37: (25, 6, 6), 50: (34, 8, 8), 2: (None,) * 3}),
    (5, {20: (6, 2, 2), 30: (14, 3, 3), 37: (19, 4, 4), 50: (28, 6, 6), 10: (None,) * 3, 12: (None,) * 3, 13: (1, 1, 1)}),
])
def test_split_counts(spark, gap, want):
    rows = spark.createDataFrame([(n,) for n in want], "n int").select("n", *splits.counts(F.col("n"), gap=gap)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == want


def test_gap_split_and_report(spark):
    s = spark.createDataFrame([("a", k, k) for k in range(20)] + [("b", k, k) for k in range(5)], "file string, target_cycle int, input_end_cycle int")
    out = splits.chronological(s, gap=5)
    got = [r.segment for r in out.filter("file = 'a'").orderBy("target_cycle").collect()]
    assert got == ["train"] * 6 + ["gap_train_val"] * 5 + ["val"] * 2 + ["gap_val_test"] * 5 + ["test"] * 2
    report = {r.file: r for r in splits.split_report(out, 5).collect()}
    assert report["a"].status == "used" and report["a"].train_last == 5 and report["b"].status == "skipped" and report["b"].reason == "needs 13 samples, has 5"


@pytest.mark.parametrize(("n", "want"), [(3, (1, 1, 1)), (5, (3, 1, 1)), (10, (6, 2, 2)), (13, (7, 3, 3))])
def test_battery_split_sizes(n, want):
    got = splits.by_battery([f"b{k}" for k in range(n)], 42)
    assert tuple(sum(s == name for s in got.values()) for name in splits.SPLITS) == want


def test_shuffled_splits_follow_the_seed():
    files = [f"f{k}" for k in range(10)]
    order = list(files)
    random.Random(42).shuffle(order)
    got = splits.by_file(files, 42)
    assert [got[f] for f in order] == ["train"] * 6 + ["val"] * 2 + ["test"] * 2
    cond = splits.by_condition({f: f"c{k % 4}" for k, f in enumerate(files)}, 1)
    assert all(cond[a] == cond[b] for k, a in enumerate(files) for b in files[k % 4 :: 4])
    dom = splits.by_domain({f: "big" if k < 4 else f"d{k}" for k, f in enumerate(files)}, 7)
    assert {dom[f] for f in files[:4]} == {"val", "test"} and {dom[f] for f in files[4:]} == {"train"}
    assert splits.by_domain({"a": "X", "b": "X", "c": "y"}, 7, "x")["c"] == "train"
    for bad in (lambda: splits.by_file(["a", "b"], 1), lambda: splits.by_domain({"a": "x", "b": "x"}, 1), lambda: splits.check_gap("audit", 19, [20]), lambda: splits.check_gap("search", 18, [20])):
        with pytest.raises(ValueError):
            bad()
    splits.check_gap("search", 19, [20])
    with pytest.raises(ValueError):
        splits.check_gap("experiments", 19, [20])


def test_assignment_and_overlap(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "file string")
    got = splits.assign(rows, {"a": "train", "b": "val"})
    assert sorted((r.file, r.split) for r in got.collect()) == [("a", "train"), ("b", "val"), ("b", "val")]
    assert splits.overlaps(got).collect() == [] and splits.assign(rows, {}).collect() == []
    assert one(splits.overlaps(got.unionByName(spark.createDataFrame([("a", "test")], "file string, split string")))).splits == ["test", "train"]


# --- arrays ---


def kernels(spark, a, *columns):
    return one(spark.createDataFrame([(a,)], "a array<double>").select(*columns))


@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=30), st.integers(1, 20))
@settings(max_examples=20, deadline=None)
def test_kernels_against_numpy(spark, a, length):
    g, r = kernels(spark, a, arrays.gradient(F.col("a")), arrays.resample_linear(F.col("a"), length))
    assert np.allclose(g, np.gradient(a)) and np.allclose(r, np.interp(np.linspace(0, 1, length), np.linspace(0, 1, len(a)), a))


def test_kernel_values(spark):
    a = F.col("a")
    got = kernels(spark, [3.0, 3.5, 3.2, 4.0, 4.0], arrays.gradient(a), arrays.resample_linear(a, 3), arrays.resample_linear(a, 4))
    assert np.allclose(got[0], [0.5, 0.1, 0.25, 0.4, 0]) and np.allclose(got[1], [3, 3.2, 4]) and np.allclose(got[2], [3, 3.4, 3.7333333, 4])
    assert tuple(kernels(spark, [1.0], arrays.gradient(a), arrays.resample_linear(a, 3))) == (None, None)
    assert kernels(spark, [1.0, None, NAN, math.inf, 2.0], arrays.finite_points(a))[0] == [1.0, 2.0]
    assert kernels(spark, [0.5, 0.9, 0.7, 0.8, NAN], arrays.capacity_soh(a, F.lit(1.0)))[0] is None
    assert kernels(spark, [0.5, 0.9, 0.7, 0.8, 0.1], arrays.capacity_soh(a, F.lit(1.0)))[0] == 0.9
    assert kernels(spark, [0.5, 1.6, 0.7, 0.8, 0.1], arrays.capacity_soh(a, F.lit(1.0)))[0] is None


def test_usable_cycles(spark):
    v, q = [3.0, 3.1, 3.2, 3.3, 3.4, 3.5], [0.1, 0.2, 0.5, 0.8, 1.0, 1.1]
    cycle = lambda n, k=1.0: (n, v, v[::-1], [x * k for x in q])
    cells = [("x_1.pkl", None, None, [cycle(2, 0.9), cycle(1), cycle(None, 0.8), (3, v[:3], v, q)]), ("y.pkl", "id", 2.2, [cycle(1)])]
    got = sorted(arrays.usable_cycles(spark.createDataFrame(cells, "file string, cell_id string, nominal_capacity_in_Ah double, cycle_data array<struct<cycle_number:int, voltage_in_V:array<float>, current_in_A:array<float>, discharge_capacity_in_Ah:array<float>>>"), 4).collect())
    assert [(r.file, r.cell_id, r.cycle_number) for r in got] == [("x_1.pkl", "x_1", 1), ("x_1.pkl", "x_1", 2), ("x_1.pkl", "x_1", 4), ("y.pkl", "id", 1)]
    reference = 1.1 * (1 + 0.9 + 1 + 0.8) / 4
    assert [r.soh for r in got] == pytest.approx([1.1 / reference, 0.99 / reference, 0.88 / reference, 0.5], rel=1e-5)
    assert len(got[0].feature.v) == 4 and got[0].feature.x == pytest.approx([0.1] * 4, abs=1e-5)


# --- labels ---


def label(spark, text, f):
    return one(spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))))[0]


@pytest.mark.parametrize(("text", "want"), [("MATR_b1c2", "MATR"), ("CALCE_CX2_37", "CALCE_CX2"), ("XJTU_2C_battery-1", "XJTU_2C"), ("foo_a", "foo"), ("foo_bar", "foo_bar"), ("d/foo_12.pkl", "foo"), ("foo_12345", "foo_12345")])
def test_conditions(spark, text, want):
    assert label(spark, text, labels.condition) == want


@pytest.mark.parametrize(("text", "want"), [("MICH_MCForm1.pkl", "MICH"), ("MICH_1.pkl", "MICH_EXP"), ("Stanford_Nova_Regular_Ref_1.pkl", "Stanford"), ("Stanford_Nova_Regular_1.pkl", "Stanford_2"), ("Tongji1_x.pkl", "Tongji"), ("new_x.pkl", "new")])
def test_datasets(spark, text, want):
    assert label(spark, text, labels.dataset) == want


def test_texts(spark):
    assert label(spark, " A b.c__d! ", labels.slug) == "a_bpc_d" and label(spark, "!!", labels.slug) == "item"
    assert label(spark, " A b.c ", lambda c: labels.slug(c, dots=False, otherwise="scenario")) == "a_b.c"
    assert label(spark, "A b.c_", lambda c: labels.slug(c, tidy=False)) == "A_bpc"
    assert label(spark, "1, 2,,3 ", lambda c: labels.listed(c, "int")) == [1, 2, 3]
    assert label(spark, "runs/Optuna_tuned/x", lambda c: labels.markers_in([c], audit.TUNED_MARKERS)) == "optuna,tuned"
    assert label(spark, "a/b.c/d.tar.gz", labels.stem_of) == "d.tar" and label(spark, "a/b", labels.parent_of) == "a" and label(spark, "b", labels.parent_of) == "."
    assert label(spark, "x", labels.stem_of) == "x"


# --- numbers ---


def test_guards(spark):
    df = spark.createDataFrame([(0.95,), (0.90,), (0.85,), (0.80,), (0.79,), (NAN,)], "x double")
    assert [r[0].split("_")[0] for r in df.select(numbers.soh_band(F.col("x"))).collect()] == ["early", "early", "mid", "mid", "late", "late"]
    x = lambda *e: tuple(one(spark.range(1).select(*e)))
    assert x(numbers.improvement(F.lit(2.0), F.lit(NAN)), numbers.improvement_percent(F.lit(0.0), F.lit(1.0)), numbers.improvement_percent(F.lit(4.0), F.lit(1.0))) == (None, None, 75.0)
    got = x(numbers.skill(F.lit(1.0), F.lit(4.0)), numbers.skill(F.lit(1.0), F.lit(0.0)), numbers.skill(F.lit(1.0), F.lit(math.inf)))
    assert got[0] == 0.75 and math.isnan(got[1]) and math.isnan(got[2])
    assert x(numbers.row_mean(F.lit(1.0), F.lit(NAN), F.lit(3.0)), numbers.clip_low(F.lit(-2.0)), numbers.clip_low(F.lit(NAN)), numbers.number(F.lit("x")), numbers.or_inf(F.lit(NAN))) == (2.0, 0.0, None, None, math.inf)
    for mode in ("absolute", "delta"):
        t = numbers.delta_target(F.lit(0.8), F.lit(0.9), mode, 10.0)
        assert x(numbers.delta_restore(t, F.lit(0.9), mode, 10.0))[0] == pytest.approx(0.8)
    assert x(numbers.loss_target(F.lit(0.9), F.lit(0.8), 10.0))[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        numbers.delta_target(F.lit(1), F.lit(1), "other")


def test_average_rank(spark):
    got = spark.createDataFrame([(k, x) for k, x in enumerate([1.0, 2.0, 2.0, 4.0, NAN])], "k int, x double").select("k", numbers.average_rank(F.col("x")).alias("r")).orderBy("k").collect()
    assert [r.r for r in got] == [1, 2.5, 2.5, 4, None]


# --- windows ---


def test_windows(spark):
    seq = spark.createDataFrame([("f", k, 2 * k, float(k)) for k in range(1, 7)] + [("g", 1, 2, 9.0)], "file string, ord int, cycle_number int, soh double")
    s = sorted(windows.sliding_samples(seq, 3, 2, history=("soh",)).collect())
    assert [(r.input_start_cycle, r.input_end_cycle, r.target_cycle, r.target, r.history_soh) for r in s] == [(2, 6, 10, 5.0, [1, 2, 3]), (4, 8, 12, 6.0, [2, 3, 4])]
    h0 = sorted(windows.persistence(seq, 2, 0).collect())
    assert [(r.target, r.pred) for r in h0] == [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    horizons = spark.createDataFrame([(2,), (4,), (5,)], "horizon int")
    f = sorted((r.horizon, r.current, r.target) for r in windows.fixed_origin_samples(seq, 4, horizons).collect())
    assert f == [(2, 2.0, 3.0), (4, 2.0, 4.0)]  # by number: cycle 9 does not exist
    x = spark.createDataFrame([("c", 1, 1.0), ("c", 2, 0.98), ("c", 3, NAN), ("c", 4, 0.9)], "cell_id string, target_cycle int, residual double")
    assert [r.slope for r in windows.slope(x).orderBy("target_cycle").collect()] == pytest.approx([0, -0.02, 0, 0])


# --- metrics ---


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.95, 0.97), (0.9, 0.85), (0.79, 0.8), (NAN, 1.0), (None, 1.0), (1.0, math.inf)], "actual double, pred double")
    r = one(metrics.regression_metrics(df))
    assert (r.n, r.RMSE, r.MAE, r.MAPE_percent, r.R2) == (4, pytest.approx(0.0273861, abs=1e-6), pytest.approx(0.02), pytest.approx(2.23166, abs=1e-4), pytest.approx(0.876033, abs=1e-5))
    assert one(metrics.accuracy_within(df.limit(4))).accuracy == 1.0
    assert one(metrics.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "actual double, pred double"))).R2 is None
    with pytest.raises(Exception, match="no finite pair"):
        metrics.strict_regression_metrics(df.filter("isnan(actual)")).collect()


def test_end_of_life(spark):
    rows = [("c", k + 1, a, p) for k, (a, p) in enumerate([(0.9, 0.95), (0.8, 0.85), (0.7, 0.8), (0.6, 0.7)])] + [("d", 1, 0.9, 0.7), (None, 1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "cell_id string, target_cycle int, actual double, pred double")
    r = one(metrics.eol_error(df))
    assert (r.n_cells, r.EOL_Error_cycles) == (1, 1.0)
    assert one(metrics.eol_error(df.filter("cell_id = 'd'"))).EOL_Error_cycles is None
    groups = metrics.group_metrics(df.withColumn("g", F.lit(None).cast("string")).withColumn("h", F.col("cell_id")), ("g", "h")).collect()
    assert {(r.group_by, r.group_value, r.n_samples) for r in groups} == {("g", None, 6), ("h", "c", 4), ("h", "d", 1), ("h", None, 1)}


def test_anomalies(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 4.0, 10.0)], "x double")
    z = sorted(r.x_z for r in anomaly.robust_z(df, df, "x").collect())
    assert z == pytest.approx([-0.674491, 0, 0, 1.348982, 5.395926], abs=1e-5)
    assert one(anomaly.quantile(df, "x")).threshold == pytest.approx(9.4)
    rows = spark.createDataFrame([("c", k, x) for k, x in enumerate([0.1, 0.2, 0.1, 0.15, 5.0])], "cell_id string, target_cycle int, residual double")
    flags = anomaly.anomaly_flags(rows, rows.filter("target_cycle < 4")).orderBy("target_cycle").collect()
    assert [r.is_anomaly for r in flags][-1] is True and sum(r.is_anomaly for r in flags) <= 2


def plain_isolation(row, forest, sample):
    """One row's score: down each tree by hand."""
    depths = []
    for feature, cut, left, right, depth in forest:
        node = 0
        while left[node] != node:
            node = left[node] if row[feature[node]] <= cut[node] else right[node]
        depths.append(depth[node])
    usual = 2 * (math.log(sample - 1) + 0.5772156649015329) - 2 * (sample - 1) / sample
    return 2 ** (-sum(depths) / len(depths) / usual)


def test_isolation_trees():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.standard_normal((120, 3)), np.zeros((80, 3)), [[1e308, -1e308, 0.0]]))
    feature, cut, left, right, depth = tree = isolation.grow(x, rng)
    held = {}
    for k, row in enumerate(x):
        node, level = 0, 0
        while left[node] != node:
            node, level = (left[node] if row[feature[node]] <= cut[node] else right[node]), level + 1
        held.setdefault((int(node), level), []).append(k)
    assert sum(map(len, held.values())) == len(x) and len({node for node, _ in held}) == (left == np.arange(len(left))).sum()
    for (node, level), rows in held.items():  # a leaf holds one row, equal rows, or is as deep as trees go
        assert level <= 8 and (len(rows) == 1 or level == 8 or (x[rows] == x[rows[0]]).all())
        assert depth[node] == pytest.approx(level + float(isolation.expected_depth(len(rows))))
    forest = [tree, isolation.grow(x, rng)]
    got = isolation.walk(x, forest, float(isolation.expected_depth(len(x))))
    assert got == pytest.approx([plain_isolation(row, forest, len(x)) for row in x])
    assert [float(isolation.expected_depth(n)) for n in (0, 1, 2)] == [0, 0, 1]


def test_isolation_scores(spark):
    rng = np.random.default_rng(5)
    vecs = rng.standard_normal((400, 4)).tolist()
    rows = [(k, v, "c") for k, v in enumerate(vecs)] + [(1000 + k, [40.0 + k, -40.0, 40.0, -40.0], "far") for k in range(3)]
    rows += [(2000, None, "x"), (2001, [], "x"), (2002, [1.0, None, 0.0, 0.0], "x"), (2003, [NAN, 0.0, 0.0, 0.0], "x"), (2004, [1.0], "x"), (0, vecs[0], "c")]
    df = spark.createDataFrame(rows, "id long, v array<double>, latent string")
    reference = df.filter("latent = 'c'")
    got = isolation.with_latent(df, reference, "v", ["id"], trees=50).select("id", "latent", "latent_score").collect()
    assert len(got) == len(rows)
    assert all((r.latent_score is None) == (r.latent == "x") for r in got)
    ordered = sorted((r for r in got if r.latent != "x"), key=lambda r: -r.latent_score)
    assert {r.id for r in ordered[:3]} == {1000, 1001, 1002} and ordered[3].latent_score < ordered[2].latent_score
    again = isolation.with_latent(df.repartition(5), reference.repartition(3), "v", ["id"], trees=50).select("id", "latent", "latent_score").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    drawn = isolation.with_latent(df, reference, "v", ["id"], trees=20, sample=16, pool=64).filter("latent = 'far'").agg(F.min("latent_score")).first()[0]
    assert drawn > 0.6
    assert isolation.with_latent(df, reference.limit(0), "v", ["id"]).filter("latent_score is not null").isEmpty()
    one_row = isolation.with_latent(df, reference.filter("id = 7"), "v", ["id"], trees=3).filter("latent = 'far'").collect()
    assert [r.latent_score for r in one_row] == [1.0] * 3
    scored = df.filter("latent <> 'x'").select(F.lit("cell").alias("cell_id"), F.monotonically_increasing_id().alias("target_cycle"), F.lit(0.1).alias("residual"), "v", "id")
    flags = anomaly.anomaly_flags(isolation.with_latent(scored, reference, "v", ["id"], trees=50), isolation.with_latent(scored.filter("id < 1000"), reference, "v", ["id"], trees=50), latent="latent_score")
    assert {r.id for r in flags.filter("is_anomaly").collect()} >= {1000, 1001, 1002}


def test_normalisation_counts_windows(spark):
    n, lookback, horizon = 12, 4, 2
    values = [float(k * k) for k in range(n)]
    laid_out = [v for e in range(lookback, n - horizon + 1) for v in values[e - lookback : e]]
    df = spark.createDataFrame([(k + 1, n, [v]) for k, v in enumerate(values)], "place int, n int, v array<double>")
    df = df.withColumn("w", normalize.multiplicity(F.col("place"), F.col("n"), lookback, horizon))
    r = one(normalize.fit_channels(df, {"v": "v"}, "w"))
    assert (r.n, r.mean, r.std) == (len(laid_out), pytest.approx(np.mean(laid_out)), pytest.approx(np.std(laid_out) + 1e-8))
    out = normalize.apply_channels(df, normalize.fit_channels(df, {"v": "v"}), {"v": "v"})
    assert np.mean([r.v[0] for r in out.collect()]) == pytest.approx(0, abs=1e-9)


# --- roll-ups and ranks ---


def test_rollups_follow_pandas(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.choice((10, 50)), rng.random() if rng.random() > 0.1 else NAN) for _ in range(200)]
    df, p = spark.createDataFrame(rows, "model string, seed int, horizon int, mae double"), pd.DataFrame(rows, columns=["model", "seed", "horizon", "mae"])
    l1 = rollup.by_seed(df, ("model", "seed", "horizon"), means=("mae",))
    l2 = rollup.by_horizon(l1, ("model", "horizon"), ("mae",))
    l3 = {r.model: (r.n_horizons, r.mae_avg, r.mae_std, r.mae_worst) for r in rollup.overall(l2, ("model",), ("mae",)).collect()}
    q = p.groupby(["model", "seed", "horizon"]).mae.mean().groupby(["model", "horizon"]).mean().groupby("model").agg(["nunique", "mean", "std", "max"])
    for m, r in q.iterrows():
        assert l3[m] == (2, pytest.approx(r["mean"]), pytest.approx(r["std"]), pytest.approx(r["max"]))
    single = one(rollup.overall(l2.filter("horizon = 10 and model = 'a'"), ("model",), ("mae",)))
    assert single.mae_std == 0.0
    assert one(rollup.stats(df.limit(1), (), ("mae",))).mae_std is None


def test_mean_std_sentinels(spark):
    df = spark.createDataFrame([("none", NAN), ("one", 2.0), ("one", math.inf), ("two", 1.0), ("two", 3.0)], "k string, x double")
    got = {r.k: (r.n, r.mean, r.std) for r in rollup.mean_std(df, ("k",), "x").collect()}
    assert got == {"none": (0, math.inf, math.inf), "one": (1, 2.0, 0.0), "two": (2, 2.0, pytest.approx(2**0.5))}
    assert experiments.mean_std([NAN]) == (math.inf, math.inf) and experiments.mean_std([2.0, None]) == (2.0, 0.0)


def test_baselines(spark):
    df = spark.createDataFrame([(1, "base", 2.0), (1, "m", 1.0), (None, "base", 4.0), (None, "m", 5.0), (2, "m", 1.0), (3, "base", 0.0), (3, "m", 1.0)], "h int, model string, mae double")
    got = {(r.h, r.model): (r.gain, r.gain_percent) for r in rollup.against_baseline(df, ("h",), "mae", "base").collect()}
    assert got[(1, "m")] == (1.0, 50.0) and got[(None, "m")] == (-1.0, -25.0) and got[(2, "m")] == (None, None) and got[(3, "m")] == (-1.0, None)
    gaps = {(r.h, r.model): (r.mae_gap, r.mae_ratio) for r in rollup.gaps(df, ("h",), ("mae",), "base").collect()}
    assert gaps[(1, "m")] == (-1.0, 0.5) and gaps[(3, "m")] == (1.0, None)
    pair = {r.h: r.mae_gain for r in rollup.pivot_pair(df, ("h",), ("mae",), "m", "base").collect()}
    assert pair == {1: 1.0, None: -1.0, 2: None, 3: -1.0}


def test_ranks_and_dedup(spark):
    df = spark.createDataFrame([("a", 1.0, None, 0.5), ("b", 1.0, 2.0, 0.9), ("c", NAN, 0.1, 0.9), ("d", 1.0, 2.0, NAN)], "model string, RMSE double, MAE double, R2 double")
    ranked = ranking.rank_records(df, (), "model").orderBy("rank").collect()
    assert [r.model for r in ranked] == ["b", "d", "a", "c"] and [r.is_best for r in ranked] == [True, False, False, False]
    rows = spark.createDataFrame([("k", 1, None, "p"), ("k", 2, 0.5, None), ("k", 3, 0.5, "p"), ("k", 4, NAN, "p"), ("j", 5, None, None)], "key string, ord int, val double, path string")
    assert sorted(r.ord for r in ranking.keep_best_then_latest(rows, ("key",), ("val", "path"), "ord").collect()) == [3, 5]
    assert [r.model for r in ranking.sorted_rows(df, ["R2", "absent", "model"], ("R2",)).collect()] == ["b", "c", "a", "d"]
    assert one(ranking.duplicates(rows, "key")).n == 4


def test_ranks_of_all_rows_come_from_many_tasks(spark):
    rng = random.Random(5)
    rows = [(f"m{k}", rng.choice([0.1, 0.2, NAN]), rng.choice([1.0, None]), rng.choice([0.5, NAN])) for k in range(3000)]
    df = spark.createDataFrame(rows, "model string, RMSE double, MAE double, R2 double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranking.rank_records(df, (), "model")
        shares = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
        got = {r.model: r["rank"] for r in ranked.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    low = lambda v: math.inf if v is None or v != v else v
    want = sorted(rows, key=lambda r: (low(r[1]), low(r[2]), low(-r[3]), r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)} and max(shares) < len(rows) / 2
    assert ranking.rank_records(df.filter("false"), (), "model").count() == 0


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string"), spark.createDataFrame([(2, 5.0)], "k int, d double")
    assert sorted((r.k, r.s, r.d) for r in sets.union_all(a, b).collect() if r.s) == [(1, "x", None), (2, "y", None)] and sets.union_all(a, b).columns == ["k", "s", "d"]
    assert [r.k for r in sets.pending(a, b, ["k"]).collect()] == [1] and [r.k for r in sets.used(a, b, ["k"]).collect()] == [2]
    r = one(sets.has_all(a, (), "s", ["x", "y", "z"]))
    assert r.lacking == ["z"] and not r.complete


# --- audits ---


def test_policies(spark):
    schema = "name string, split_mode string, split_gap int, early_cycle int, train_files array<string>, val_files array<string>, test_files array<string>, train_conditions array<string>, val_conditions array<string>, test_conditions array<string>"
    rows = [
        ("ok", None, None, None, ["MATR_1"], ["MATR_2"], ["MATR_3"], [], [], []),
        ("gap", "condition-gap-within-file", 20, 20, ["MATR_1"], ["MATR_1"], ["MATR_1"], [], [], []),
        ("early", "condition-gap-within-file", 20, 30, ["MATR_1"], ["MATR_1"], ["MATR_1"], [], [], []),
        ("group", "condition-group", None, None, ["MATR_1"], ["MATR_2"], ["foo_1"], ["c"], ["c"], ["d"]),
        ("chrono", "chronological-within-file", 0, 0, None, None, None, [], [], []),
    ]
    got = {r.name: r for r in audit.split_policy(spark.createDataFrame(rows, schema)).collect()}
    assert got["ok"].policy_ok and got["gap"].policy_ok and len(got["early"].failures) == 1
    assert [f.split(":")[0] for f in got["group"].failures] == ["split uses datasets outside the policy", "condition-group split has overlapping conditions"] and len(got["group"].warnings) == 1
    assert len(got["chrono"].failures) == 2
    assert audit.test_columns(["val_RMSE", "test_RMSE", "Test MAE", "latest"]) == ["test_RMSE", "Test MAE"]
    with pytest.raises(ValueError):
        audit.check_locked({})
    files = spark.createDataFrame([("a/MATR_1.pkl",), ("NA-ion_1.pkl",), ("odd.pkl",)], "path string")
    assert {(r.dataset, r.status) for r in audit.inventory(files, ["MATR", "CALB"]).collect()} == {("MATR", "allowed"), ("NA-ion", "excluded"), ("unknown", "unexpected"), ("CALB", "missing")}


# --- plans ---


def test_scenarios_and_configs(spark):
    assert experiments.parse_scenarios("10:50, 20:100:big,10:50") == [{"name": "lb10_h50", "lookback_cycles": 10, "horizon": 50}, {"name": "big", "lookback_cycles": 20, "horizon": 100}]
    assert [s["name"] for s in experiments.scenarios([1, 2], [3, 3])] == ["lb1_h3", "lb2_h3"]
    assert experiments.choose_scenarios(None, "1:2", [1], [1], [])[0]["horizon"] == 2
    assert experiments.normalise_config({"dropout": "0.3", "zero_output_init": "Yes", "model_hidden": 128.0})["zero_output_init"] is True
    assert list(experiments.configs_by_model({"a": [{}], "*": [{"lr": 1}]}, ["a", "b"])) == ["a", "b"]
    with pytest.raises(ValueError):
        experiments.configs_by_model({"a": [{}]}, ["a", "b"])
    with pytest.raises(ValueError):
        experiments.configs_by_horizon({"10": {"horizon": 20}}, [10])
    assert experiments.first_given(None, 0, 5) == 0
    config = {"b": 1, "a": "x"}
    assert one(spark.range(1).select(experiments.config_hash({"b": F.lit(1), "a": F.lit("x")})))[0] == experiments.config_hash(config)
    odd = {"a": 'q"\\ \n\r\t\b\f\x00\x7f é 日 😀', "b": None, "c": True}
    assert one(spark.range(1).select(experiments.config_hash({"a": F.lit(odd["a"]), "b": F.lit(None), "c": F.lit(True)})))[0] == experiments.config_hash(odd)


def test_searches(spark):
    best, history = experiments.staged_search({"x": 0, "y": 0}, [{"x": [0, 1, 2]}, {"y": [0, 3]}], lambda c: (c["x"] - 1) ** 2 + (c["y"] - 3) ** 2)
    assert best == {"x": 1, "y": 3} and len(history) == 5
    ranked = experiments.confirm([{"n": 1}, {"n": 2}], [1, 2], lambda c, s: (1.0 / c["n"], 1.0 if c["n"] == 1 else -1.0))
    assert [r["n"] for r in ranked] == [1, 2]
    plan = experiments.plan(spark.createDataFrame([(1,), (2,), (3,)], "k int"))

    def trial(row):
        if row["k"] == 3:
            raise RuntimeError("no")
        return {"mae": 1.0}

    done = spark.createDataFrame([(1,)], "k int")
    assert [(r["k"], r["status"]) for r in experiments.run_trials(plan, done, ["k"], trial, 2)] == [(2, "done"), (3, "failed")]


def test_predictors(spark):
    assert predict.parse_models("cpmlp, persistence,cpmlp") == ["cpmlp", "persistence"] and len(predict.parse_models("all")) >= 14
    with pytest.raises(ValueError):
        predict.parse_models("nonsense")
    samples = spark.createDataFrame([(1, 0.9), (2, 0.8)], "sample_id long, actual double")
    external = spark.createDataFrame([(2, 0.7), (1, 0.6)], "sample_id long, pred double")
    assert {(r.sample_id, r.pred) for r in predict.predict("cpmlp", samples, external=external).collect()} == {(1, 0.6), (2, 0.7)}
    with pytest.raises(ValueError):
        predict.predict("cpmlp", samples)


# --- sinks ---


def test_texts_of_sinks(spark, tmp_path):
    assert sinks.markdown_table([{"a": 1.23456789, "b": "x|y\nz"}, {"a": None}], ["a", "b", "c"]) == "| a | b |\n|---|---|\n| 1.23457 | x\\|y z |\n|  |  |\n"
    assert sinks.jsonable({1: [NAN, np.float64(2.0), (3,)], "k": {"x": math.inf}}) == {"1": [None, 2.0, [3]], "k": {"x": None}}
    assert sinks.yaml_text({"a": {"b": [1, "x: y"], "c": []}, "d": True, "e": None}) == 'a:\n  b:\n    - 1\n    - "x: y"\n  c: []\nd: true\ne: null\n'
    assert sinks.command_text(["python", "a b", "it's"]) == "python 'a b' 'it''s'"
    rows = spark.createDataFrame([(1, NAN), (2, 0.5)], "k int, x double")
    assert sorted(r.line for r in sinks.json_rows(rows).collect()) == ['{"k":1,"x":null}', '{"k":2,"x":0.5}']
    assert sinks.write_union_csv([], str(tmp_path / "no")) is False
    sinks.write_union_csv([rows, spark.createDataFrame([("z",)], "s string")], str(tmp_path / "u"))
    assert spark.read.option("header", True).csv(str(tmp_path / "u")).columns == ["k", "x", "s"]


def test_presets():
    from fadeline.plans.presets import CATALOGUE, presets

    assert [len(presets(m)) for m in CATALOGUE] == [29, 33, 36]
    assert all(len({experiments.config_hash(c) for c in presets(m)}) == len(presets(m)) for m in CATALOGUE)
    assert [len(presets(m, "smoke")) for m in CATALOGUE] == [1, 1, 1]
    assert [c["name"] for c in presets("cpmlp_cpdsconv_fusion", "quick")] == ["base", "drop015", "lr5e4", "dsconv96", "wide_lowdrop", "mlp_strong_dsconv48", "compact_low_lr", "zero_init_lr5e4", "zero_init_scale10"]


def test_search(tmp_path):
    from fadeline.plans import search

    space = {"size_preset": ["small", "large"], "lr": (1e-5, 1e-1), "dropout": [0.1, 0.2, 0.3]}
    score = lambda c: abs(math.log10(c["lr"]) + 3) + c["dropout"] + (c["model_hidden"] == 128)
    trials = search.study(space, score, 40, seed=1)
    values = [t["value"] for t in trials]
    assert len(trials) == 40 and search.best_trial(trials)["value"] == min(values) < 0.5
    assert sum(values[20:]) / 20 < sum(values[:10]) / 10
    assert search.should_stop([[1.0, 1.0]] * 3, [1.0, 2.0]) and not search.should_stop([[1.0]] * 3, [1.0, 2.0]) and not search.should_stop([[1.0, 1.0]] * 3, [2.0])


def test_studies_resume_and_prune(tmp_path):
    from fadeline.plans import search

    space, calls = {"x": (0.1, 10.0)}, []

    def steps(c):
        for k in range(4):
            calls.append(c["x"])
            yield abs(c["x"] - 1) + k * 0.0

    store = str(tmp_path / "study.jsonl")
    whole = search.study(space, steps, 25, seed=3, prune=True)
    search.study(space, steps, 9, seed=3, store=store, prune=True)
    calls.clear()
    assert search.study(space, steps, 25, seed=3, store=store, prune=True) == whole and len(set(calls)) == 16
    pruned = [t for t in whole if t["state"] == "pruned"]
    assert pruned and all(len(t["steps"]) == 2 and t["value"] is None for t in pruned) and search.best_trial(whole)["state"] == "complete"

    def fails(c):
        raise RuntimeError("no")

    assert [(t["state"], t["reason"]) for t in search.study(space, fails, 2)] == [("failed", "no")] * 2
    with pytest.raises(ValueError):
        search.best_trial(search.study(space, lambda c: math.inf, 2))


@pytest.mark.parametrize("largest", [1, 7, 10_000])
def test_quantiles_of_whole_tables(spark, largest):
    from fadeline.operators.quantiles import quantiles

    rng = np.random.default_rng(5)
    x = np.concatenate((rng.standard_normal(400), np.full(300, 0.25), [7.0] * 3, rng.standard_normal(57) * 1e6))
    rows = spark.createDataFrame([(float(v), float(-v)) for v in x] + [(NAN, math.inf), (None, None)], "a double, b double").repartition(5)
    for q in (0.0, 0.31, 0.5, 0.975, 1.0):
        got = quantiles(rows, {"a": (F.col("a"), q), "b": (F.col("b"), q), "none": (F.lit(None).cast("double"), q)}, largest)
        assert got["a"] == pytest.approx(np.quantile(x, q)) and got["b"] == pytest.approx(np.quantile(-x, q)) and got["none"] is None


def test_ranges_count_as_windows_do(spark):
    from fadeline.functions.numbers import average_rank
    from fadeline.operators import ranking

    rows = spark.createDataFrame([(k % 3 if k % 7 else None, k, [1.0, 2.0, NAN, None, 0.5][k % 5]) for k in range(400)], "g int, k int, x double").repartition(6)
    got = {r.k: r.place for r in ranking.numbered_by_ranges(rows, ("g",), [F.desc("k")]).collect()}
    assert got == {r.k: r.place for r in ranking.numbered(rows, ("g",), [F.desc("k")]).collect()} and len(got) == 400
    got = {r.k: r.r for r in ranking.average_rank_by_ranges(rows, ("g",), "x", "r").collect()}
    assert got == {r.k: r.r for r in rows.withColumn("r", average_rank(F.col("x"), "g")).collect()}


def test_normaliser_of_large_values(spark):
    from fadeline.operators import normalize

    rows = spark.createDataFrame([([1e9 - 1, 1e9 + 1],), ([1e9],)], "v array<double>")
    (got,) = normalize.fit_channels(rows, {"v": "v"}).collect()
    assert got["mean"] == 1e9 and got["std"] == pytest.approx((2 / 3) ** 0.5)


def test_command_and_templates():
    from fadeline.plans import reports

    assert reports.command(["x"], {"a_b": 1, "on": True, "off": False, "none": None, "empty": "", "many": [1, 2]}) == ["x", "--a-b", "1", "--on", "--many", "1,2"]
    assert "--split-gap" in reports.trial_command(["x"], "m", 1, {}, {"split_mode": "condition-gap-within-file", "split_gap": 20})
    assert reports.filled("# {name}\n{table:top}\n{unknown} {horizons}", {"name": "N", "horizons": [1, 2]}, {"top": "| a |\n"}) == "# N\n| a |\n{unknown} 1, 2"


def test_what_sources_refuse(spark, tmp_path):
    from fadeline.sources import cells

    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(ValueError):
        cells.find_files(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError):
        cells.dataset_files(spark.createDataFrame([("CALB.pkl",)], "name string"), "MATR")
    used = lambda *names: spark.createDataFrame([(n, "used") for n in names] + [("z", "skipped")], "file string, status string")
    cells.check_records(used("a", "b", "c"))
    with pytest.raises(ValueError, match="duplicate ids: a"):
        cells.check_records(used("a", "a", "b", "c"))
    with pytest.raises(ValueError, match="needs 3 usable files, has 2"):
        cells.check_records(used("a", "b"))


def test_reports():
    from fadeline.plans import reports

    text = reports.selection_report([{"rank": 1, "model": "m", "RMSE": 0.5}], "test metrics")
    assert "`m` is selected by test metrics" in text and "| 1 | m | 0.5 |" in text
    text = reports.experiment_report("T", [{"k": 1}, {"k": 2}], [{"k": 1, "mae": 0.1, "status": "done"}, {"k": 2, "status": "failed", "reason": "no"}], ("mae",))
    assert "2 planned, 1 done, 1 failed." in text and "| 2 | no |" in text
    assert reports.command_file([["a", "b c"]]) == "a 'b c'\n"


def test_projections(spark):
    from fadeline.operators import projections, selection

    rows = spark.createDataFrame([(1, None), (2, "x")], "k int, path string")
    plan = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k int, lr double")
    assert sorted((r.k, r.lr) for r in projections.enriched(rows, plan, ["k"]).collect()) == [(1, 0.1), (2, 0.2)]
    files = spark.createDataFrame([("f1",)], "path string")
    got = projections.filled_path(rows, "path", files, F.concat(F.lit("f"), F.col("k").cast("string")))
    assert sorted((r.k, r.path) for r in got.collect()) == [(1, "f1"), (2, "x")]
    short = spark.createDataFrame([("m", 10, 1.0, 1.0, 1.0, 0.0, 0.0)], "model string, horizon int, MAE_mean double, RMSE_mean double, MAPE_percent_mean double, MAE_std double, skill_mean double")
    with pytest.raises(Exception, match="a horizon is missing for m"):
        selection.by_validation_metrics(short, 2).collect()
