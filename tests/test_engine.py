"""Splits, files that differ, the cell source, places, states, artefacts, configurations, rungs, training and windows in blocks against plain versions."""

import hashlib
import json
import math
import os
import pickle
import random
import statistics
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fadeline import artefacts
from fadeline.functions import arrays
from fadeline.operators import positions, splits, state, windows
from fadeline.plans import experiments, rungs, training
from fadeline.sources import cells, cellsource, configs, results, tables

# --- splits ---


def order_of(keys, seed):
    return sorted(set(keys), key=lambda k: (hashlib.sha256(f"{seed}/{k}".encode()).hexdigest(), k))


def sizes(n, val, test):
    t, v = max(1, round(n * test)), max(1, round(n * val))
    return (n - t - v, v) if n - t - v >= 1 else (1, 1)


def cut(keys, seed, val=0.15, test=0.15):
    own = order_of(keys, seed)
    a, b = sizes(len(own), val, test)
    return {k: "train" if i < a else "val" if i < a + b else "test" for i, k in enumerate(own)}


@pytest.mark.parametrize("n", [3, 4, 7, 100])
def test_random_and_group_splits(spark, n):
    keys = [f"k{i}" for i in range(n)]
    rows = spark.createDataFrame([(k, f"g{i % 5}") for i, k in enumerate(keys * 3)] + [(None, "g1"), ("x", None)], "key string, grp string")
    assert dict(splits.random_split(rows.filter("grp is not null"), "key", 9).collect()) == cut(keys, 9)
    again = rows.filter("grp is not null").repartition(7).orderBy(F.rand(1))
    assert dict(splits.battery_split(again, "key", 9).collect()) == cut(keys, 9, 0.2, 0.2)
    groups = cut([f"g{i}" for i in range(5)], 4)
    got = {(r.key, r.grp): r.split for r in splits.group_split(rows, "key", "grp", 4).collect()}
    assert got == {(k, f"g{i % 5}"): groups[f"g{i % 5}"] for i, k in enumerate(keys * 3)}


def test_quota_split_deals_whole_groups_by_size(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("abcdefghijkl")) for k in range(300)] + [(k, "hot") for k in range(300, 700)]
    of = {}
    for k, g in rows:
        of.setdefault(g, set()).add(k)
    n_test = n_val = max(1, round(len(rows) * 0.15))
    want, filled, left = {}, 0, "test"
    for g in order_of(of, 5):
        if left == "test" and filled >= n_test:
            left, edge = "val", filled + n_val
        if left == "val" and filled >= edge:
            left = "train"
        want[g] = left
        filled += len(of[g])
    got = splits.quota_split(spark.createDataFrame(rows, "key int, grp string").repartition(5), "key", "grp", 5).collect()
    assert {r.grp: r.split for r in got} == want and len(got) == len(rows)
    with pytest.raises(ValueError):
        splits.quota_split(spark.createDataFrame([(1, "a"), (2, "b")], "key int, grp string"), "key", "grp", 1)


def test_domain_split(spark):
    rows = spark.createDataFrame([(k, d) for d, n in (("A", 9), ("b", 9), ("c", 2)) for k in range(100 * ord(d), 100 * ord(d) + n)] * 2, "key int, domain string")
    got = {r.key: r.split for r in splits.domain_split(rows, "key", "domain", 3, "B").collect()}
    own = order_of(range(9800, 9809), 3)
    assert {k: s for k, s in got.items() if s != "train"} == {k: "val" if i < 4 else "test" for i, k in enumerate(own)} and len(got) == 20
    largest = {r.domain for r in splits.domain_split(rows, "key", "domain", 3).collect() if r.split != "train"}
    assert largest == {order_of(["A", "b"], 3)[0]}
    for bad in ("none", "c"):
        with pytest.raises(ValueError):
            splits.domain_split(rows.filter("domain = 'c'"), "key", "domain", 3, bad)
    with pytest.raises(ValueError):
        splits.random_split(rows.limit(2), "key", 1)


def test_chronological_by_ranges_is_chronological(spark):
    rows = spark.createDataFrame([(f, c, c) for f, n in (("hot", 900), ("b", 40), ("c", 9)) for c in range(n)], "file string, target_cycle int, input_end_cycle int")
    for gap in (0, 3):
        a, b = (sorted(map(tuple, s(rows, gap=gap).collect()), key=repr) for s in (splits.chronological, splits.chronological_by_ranges))
        assert a == b


# --- files that differ ---


def test_tables_of_other_columns(spark, tmp_path):
    texts = {
        "a b/x.csv": "key,price,status\n1,2.5,o\n2,,p\n", "a b/[1]/y.csv": "status,key\nq,3\n", "z.csv": '﻿price,key,"more\nlines",KEY,price,\n9.5,4,text,k,8.5,e\nbad,5,,,,\n'.encode().decode(),
        "empty.csv": "", "head.csv": "key,price\n", "skip/w.csv": "key\n99\n", "note.txt": "key\n7\n",
    }
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(text, encoding="utf-8")
    known = T.StructType.fromDDL("key long, price double, status string")
    rows = tables.read_tables(spark, [str(tmp_path), f"{tmp_path}/a b", str(tmp_path)], known, exclude=f"{tmp_path}/skip").orderBy("key").collect()
    assert [(r.key, r.price, r.status) for r in rows] == [(1, 2.5, "o"), (2, None, "p"), (3, None, "q"), (4, 9.5, None), (5, None, None)]
    assert [r.extras for r in rows[:3]] == [{}, {}, {}] and rows[3].extras == {"more\nlines": "text", "KEY": "k", "": "e"}
    heads = {r.path.rpartition("/")[2]: r.header for r in tables.headers(tables.listed(spark, [str(tmp_path)], "*.csv")).collect()}
    assert heads["z.csv"] == ["price", "key", "more\nlines", "KEY", "price", ""] and "empty.csv" not in heads and heads["y.csv"] == ["status", "key"]
    assert tables.read_tables(spark, [f"{tmp_path}/head.csv"], known).collect() == []


def test_metrics_of_files_that_lack_and_swap_columns(spark, tmp_path):
    for run, text in (("a", "MAE,model,RMSE\n1,cpmlp,2\n"), ("b", "model,R2,note\npersistence,0.5,hm\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / results.METRIC_FILE).write_text(text)
    rows = {r.model: r for r in results.find_metrics(spark, [str(tmp_path)]).collect()}
    assert (rows["cpmlp"].MAE, rows["cpmlp"].RMSE, rows["cpmlp"].R2) == (1, 2, None)
    assert (rows["persistence"].MAE, rows["persistence"].R2, rows["persistence"].extras) == (None, 0.5, {"note": "hm"})


def test_only_the_first_line_is_read():
    class Source:
        def __init__(self):
            self.parts = [b'"a,\nb",c', b",d\r\nrest", b"never"]

        def read(self, n):
            return self.parts.pop(0)

    source = Source()
    assert tables.first_line(source) == '"a,\nb",c,d' and source.parts == [b"never"]


# --- cells ---


def curve(top, n=6):
    return [top * k / n for k in range(1, n)] + [top]


def one_cell(caps, numbers, **more):
    return {"cycle_data": [{**({} if n is None else {"cycle_number": n}), "voltage_in_V": curve(4.0), "current_in_A": curve(-1.0), "discharge_capacity_in_Ah": curve(c)} for c, n in zip(caps, numbers, strict=True)], "nominal_capacity_in_Ah": 2.0, **more}


def test_last_label_of_a_repeated_number_counts(spark, tmp_path):
    cell = one_cell([1.9, 1.8, 1.7, 1.6, 9.0, 1.5], [1, 2, 2, 5, 5, None])
    (tmp_path / "MATR_a.pkl").write_bytes(pickle.dumps(cell))
    (tmp_path / "MATR_b.pkl").write_bytes(pickle.dumps(one_cell([9.0] * 7 + [1.9], range(1, 9), cell_id="b")))
    cellsource.register(spark)
    rows = {r.file: r for r in cells.fixed_origin_records(spark.read.format("cells").load(str(tmp_path)), 2, [3, 4, 3], 4).collect()}
    a, b = rows["MATR_a.pkl"], rows["MATR_b.pkl"]
    assert a.origin_soh == pytest.approx(0.85) and a.targets == {3: pytest.approx(0.8), 4: pytest.approx(0.75)} and a.status == "used" and a.n_cycles == 6
    assert a.soh_errors == ["cycle 5: no label"] and a.feature_errors == []
    assert b.soh_errors == [f"cycle {k}: no label" for k in range(1, 6)] and b.status == "skipped"


def test_errors_of_features_and_labels_are_kept_apart(spark, tmp_path):
    cell = one_cell([1.9] * 8, range(1, 9))
    for c in cell["cycle_data"][:7]:
        c["voltage_in_V"] = [1.0]
        c["discharge_capacity_in_Ah"] = []
    (tmp_path / "MATR_a.pkl").write_bytes(pickle.dumps(cell))
    cellsource.register(spark)
    (r,) = cells.fixed_origin_records(spark.read.format("cells").load(str(tmp_path)), 7, [1], 4).collect()
    assert r.feature_errors == [f"cycle {k}: no feature" for k in range(1, 6)] and r.soh_errors == [f"cycle {k}: no label" for k in range(1, 6)]


def test_cell_source_round_trip(spark, tmp_path):
    cellsource.register(spark)
    rows = [(f"MATR_{k}.pkl", f"c{k}", None if k % 2 else 2.5, [(n, [1.5, 2.5], None if n == 1 else [0.5], []) for n in (3, 1, None)]) for k in range(20)]
    table = spark.createDataFrame(rows, cells.CELL_FILE)
    table.repartition(4).write.format("cells").mode("append").save(f"{tmp_path}/own/deep")
    assert sorted(os.listdir(f"{tmp_path}/own/deep")) == sorted(r[0] for r in rows)
    back = spark.read.format("cells").load(f"{tmp_path}/own")
    got = {r.file: r for r in back.collect()}
    for f, c, n, cycles in rows:
        assert (got[f].cell_id, got[f].nominal_capacity_in_Ah) == (c, n)
        assert [(x.cycle_number, x.voltage_in_V, x.current_in_A, x.discharge_capacity_in_Ah) for x in got[f].cycle_data] == [(x[0], x[1], x[2] or [], x[3]) for x in cycles]
    size = os.path.getsize(f"{tmp_path}/own/deep/MATR_0.pkl")
    small = spark.read.format("cells").option("taskBytes", str(3 * size)).load(f"{tmp_path}/own")
    assert small.rdd.getNumPartitions() == 7 and small.count() == 20
    assert [r.file for r in spark.read.format("cells").option("pattern", "*_7.pkl").load(f"{tmp_path}/own").collect()] == ["MATR_7.pkl"]
    assert spark.read.format("cells").option("recursive", "false").load(f"{tmp_path}/own").collect() == []
    assert arrays.usable_cycles(back, 4).collect() == []  # curves of two points are none
    (tmp_path / "own" / "bad.pkl").write_bytes(pickle.dumps(os.system))
    with pytest.raises(Exception, match="bad.pkl"):
        spark.read.format("cells").load(f"{tmp_path}/own").collect()
    assert cellsource.dealt([("a", 5), ("b", 90), ("c", 5), ("d", 5)], 10) == [["a"], ["b"], ["c", "d"]]


# --- places ---


def test_rows_meet_by_place_however_they_are_read(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("a"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("b"))
    rows.repartitionByRange(3, "a").sortWithinPartitions("a").select("a").write.csv(f"{tmp_path}/a")
    rows.repartitionByRange(7, "a").sortWithinPartitions("a").select("b").write.csv(f"{tmp_path}/b")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # several blocks of each file
        left = positions.as_read(spark.read.schema("a long").csv(f"{tmp_path}/a"))
        assert left.agg(F.count_distinct("a")).first()[0] == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    right = positions.as_read(spark.read.schema("b string").csv(f"{tmp_path}/b"))
    met = positions.zipped(left, right).collect()
    assert len(met) == 2000 and all(r.b == f"text {r.a}" and r.position == r.a for r in met)
    with pytest.raises(ValueError, match="1999"):
        positions.zipped(left.filter("position < 1999"), right)
    with pytest.raises(ValueError, match="no place"):
        positions.zipped(left.filter("position <> 5"), right)
    with pytest.raises(ValueError, match="both"):
        positions.zipped(left, right.withColumnRenamed("b", "A"))
    assert positions.zipped(left.limit(0), right.limit(0)).collect() == []


# --- states and artefacts ---


def plain_summary(rows):
    out = {}
    for k in {r[0] for r in rows}:
        for m, at in (("x", 1), ("y", 2)):
            v = [r[at] for r in rows if r[0] == k and r[at] is not None and math.isfinite(r[at])]
            out[k, m] = (len(v), statistics.fmean(v) if v else None, statistics.stdev(v) if len(v) > 1 else None, min(v, default=None), max(v, default=None))
    return out


def summaries(spark, path):
    return {(r.k, r.metric): (r.n, r["mean"], r["std"], r["min"], r["max"]) for r in state.summary(state.delivered(spark, path), ("k",)).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [x is None for x in a[k]] == [x is None for x in b[k]]
        assert [x for x in a[k] if x is not None] == pytest.approx([x for x in b[k] if x is not None], rel=1e-7)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_states_merge_to_the_whole(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("abc"), 1e9 + rng.random(), rng.choice((None, float("nan"), float("inf"), 1.0, 2.5))) for _ in range(200)] + [("d", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    path = f"{tmp_path}/states"
    assert state.delivered(spark, path) is None
    deal = [rng.randrange(parts) for _ in rows]
    for p in range(parts):
        own = spark.createDataFrame([r for r, d in zip(rows, deal, strict=True) if d == p], df.schema)
        state.deliver(own, ("k",), ("x", "y"), path, f"b{p}")
        if p % 2:
            state.deliver(own, ("k",), ("x", "y"), path, f"b{p}")  # again
        if p == 3:
            assert state.compact(spark, path, ("k",)) == 1
    same(summaries(spark, path), plain_summary(rows))
    state.compact(spark, path, ("k",))
    same(summaries(spark, path), plain_summary(rows))
    left = [r for r, d in zip(rows, deal, strict=True) if d]
    state.deliver(df.limit(0), ("k",), ("x", "y"), path, "b0")  # a batch that was compacted comes again, with other rows
    same({k: v for k, v in summaries(spark, path).items()}, plain_summary(left))


def test_a_version_is_whole_or_absent(spark, tmp_path):
    path = f"{tmp_path}/artefact"
    one, two = (spark.createDataFrame([(k,)], "v int") for k in (1, 2))
    assert artefacts.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        artefacts.table(spark, path, "t")
    assert artefacts.publish(spark, path, {"t": one}, {"name": "first", "bad": float("nan")}) == 1
    staged = artefacts.stage(spark, path, {"t": two}, {"name": "second"})  # the writer dies here
    assert artefacts.versions(spark, path) == [1] and artefacts.table(spark, path, "t").first().v == 1
    other = artefacts.stage(spark, path, {"t": two})
    assert {artefacts.commit(spark, path, staged), artefacts.commit(spark, path, other)} == {2, 3}
    assert artefacts.table(spark, path, "t").first().v == 2 and artefacts.table(spark, path, "t", 1).first().v == 1
    assert json.loads(artefacts.document(spark, path, 1).first().value) == {"name": "first", "bad": None}
    assert artefacts.damaged(spark, path, 2).collect() == []
    folder = f"{path}/v000002/content/t"
    for f in os.listdir(folder):
        if f.startswith("part"):
            os.remove(f"{folder}/{f}")
    with open(f"{folder}/more.parquet", "wb") as f:
        f.write(b"x")
    assert {(r.file.endswith("more.parquet"), r.fault) for r in artefacts.damaged(spark, path, 2).collect()} == {(True, "added"), (False, "missing")}


# --- configurations ---


def plain_coerced(raw, defaults):
    out = dict(defaults)
    for k, d in defaults.items():
        if raw.get(k) is not None:
            v = raw[k]
            out[k] = (v.strip().lower() in ("1", "true", "yes", "y") if isinstance(v, str) else bool(v)) if isinstance(d, bool) else type(d)(v)
    return out


def test_configurations_of_three_forms(spark):
    models, base = ["cpmlp", "cpgru"], experiments.BASE_CONFIG
    entries = [{"model": "cpmlp", "name": "a", "lr": "0.5", "model_hidden": 7.9, "zero_output_init": "YES"}, {"lr": 1, "zero_output_init": 0, "dropout": None}, {"model": "", "gru_hidden": " 12 ", "zero_output_init": True}, {"model": "other"}]
    docs = {
        "list": entries, "configs": {"configs": entries, "more": 1}, "under": {"cpmlp": entries[1:3], "cpgru": [{"model": "*", "name": "w"}], "note": "x"}, "faults": [5, {"lr": "fast"}, {"model_hidden": "3.5"}, {"target_scale": 0}], "number": 7, "none": [],
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("broken", "{"), ("null", None)]
    got = configs.configurations(spark.createDataFrame(rows, "path string, value string"), models, base).collect()
    for path, own in (("list", entries), ("configs", entries), ("under", [{"model": "cpmlp", **e} for e in entries[1:3]] + [{"model": "*", "name": "w"}])):
        want = []
        for k, e in enumerate(own):
            for m in models if e.get("model") in (None, "", "*") else [e["model"]] if e["model"] in models else []:
                want.append((k + 1, m, e.get("name") or f"custom_{k + 1:03d}", *plain_coerced(e, base).values(), None))
        own = [(r.number, r.model, r["name"], *(r[k] for k in base), r.fault) for r in got if r.path == path and r.fault is None]
        if path == "under":  # the order of an object's keys is not kept
            own, want = ([x[1:2] + x[3:] for x in t] for t in (own, want))
        assert sorted(own, key=repr) == sorted(want, key=repr)
    faults = lambda p: sorted(((r.number, r.model, r.fault) for r in got if r.path == p and r.fault), key=repr)
    assert {f for n, _, f in faults("faults") if n} == {"entry is no object", "no fit: lr", "no fit: model_hidden", "target_scale is not positive"}
    assert {m for n, m, f in faults("faults") if f == "no configuration"} == set(models)
    for p in ("number", "broken", "null"):
        assert [r.fault for r in got if r.path == p] == ["no document of configurations"]
    horizons = configs.by_horizon(spark.createDataFrame([("p", json.dumps({"10": {"lr": 1}, " 20": {"horizon": "20"}, "30": {"horizon": 31}, "x": {}, "40": 1, "50": {"model": "z"}}))], "path string, value string"), "cpmlp").collect()
    assert {(r.horizon, r.fault) for r in horizons} == {(10, None), (20, None), (30, "another horizon inside"), (None, "horizon is no number"), (40, "config is no object"), (50, "another model")}


# --- rungs ---


def test_rungs_against_the_plain_rule(spark):
    rng = random.Random(7)
    rows = [(k % 4, rng.random(), rng.random()) for k in range(400)]
    trials = [{"a": k / 6, "b": float(k % 3)} for k in range(9)]
    got = rungs.race(spark.createDataFrame(rows, "rung int, x double, y double"), "rung", trials, lambda p: F.abs(F.col("y") - p("a") * F.col("x") - p("b") / 10), weight=0.5).collect()
    alive, history, want = list(range(9)), {n: [] for n in range(9)}, []
    for k in range(4):
        for n in alive:
            history[n].append(statistics.fmean(abs(y - trials[n]["a"] * x - trials[n]["b"] / 10) for r, x, y in rows if r == k))
        score = {n: statistics.fmean(history[n]) + (0.5 * statistics.stdev(history[n]) if k else 0) for n in alive}
        on = [n for n in alive if k == 0 or len(alive) < 3 or score[n] <= statistics.median(score.values())]
        want += [(n, k, history[n][-1], score[n], "pruned" if n not in on else "complete" if k == 3 else "running") for n in alive]
        alive = on
    assert [(r.trial, r.rung, r.state) for r in sorted(got)] == [(n, k, s) for n, k, _, _, s in sorted(want)]
    assert [x for r in sorted(got) for x in (r.error, r.score)] == pytest.approx([x for r in sorted(want) for x in r[2:4]])
    bad = rungs.race(spark.createDataFrame([(0, None)], "rung int, x double"), "rung", [{"a": 1.0}], lambda p: F.col("x") * p("a")).collect()
    assert [(r.state, r.error) for r in bad] == [("failed", None)]


def test_a_race_goes_on_where_it_ended(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, k / 60, (k * 7 % 60) / 60) for k in range(60)], "rung int, x double, y double")
    trials, calls = [{"a": k / 4} for k in range(6)], []

    def error(p):
        calls.append(1)
        return F.abs(F.col("y") - p("a") * F.col("x"))

    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(rungs.race(rows, "rung", trials, error))
    rungs.race(rows.filter("rung < 2"), "rung", trials, error, store=f"{tmp_path}/race")  # ends early
    calls.clear()
    assert key(rungs.race(rows, "rung", trials, error, store=f"{tmp_path}/race")) == want and len(calls) == 1
    with pytest.raises(ValueError, match="another race"):
        rungs.race(rows, "rung", trials[:4], error, store=f"{tmp_path}/race")


# --- training ---


def plain_forward(net, flat, x):
    """One sample, written out."""
    h, half, at, p = net.hidden, net.hidden // 2, 0, []
    for size in (net.inputs * h, h, h, h, h * half, half, half, 1):
        p.append(flat[at : at + size])
        at += size
    gelu = lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2)))
    a = [sum(x[i] * p[0][i * h + j] for i in range(net.inputs)) + p[1][j] for j in range(h)]
    mean = sum(a) / h
    spread = math.sqrt(sum((v - mean) ** 2 for v in a) / h + 1e-5)
    h1 = [gelu((v - mean) / spread * p[2][j] + p[3][j]) for j, v in enumerate(a)]
    h2 = [gelu(sum(h1[i] * p[4][i * half + j] for i in range(h)) + p[5][j]) for j in range(half)]
    return sum(h2[j] * p[6][j] for j in range(half)) + p[7][0], h2


def plain_huber(e, delta):
    return 0.5 * e * e if abs(e) <= delta else delta * (abs(e) - 0.5 * delta)


def plain_training(rows, net, epochs, lr, decay, patience, delta, clip, lr_patience, seed, reconstruct=False, scale=1.0, batches=1):
    """The loop written out, with gradients by central differences."""
    loss = (lambda e: e * e) if delta is None else (lambda e: plain_huber(e, delta))
    learn, val = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    mean_loss = lambda p, own: statistics.fmean(loss(plain_forward(net, p, x)[0] - y) for _, x, y, *_ in own)
    p = net.start(seed).tolist()
    m, v, best, best_p, waited, history, plateau, bad, step = [0.0] * len(p), [0.0] * len(p), math.inf, p, 0, [], math.inf, 0, 0
    parts = [own for k in range(batches) if (own := [r for r in learn if zlib.crc32(f"{seed}/{r[0]}".encode()) % batches == k])]
    for epoch in range(1, epochs + 1):
        losses = []
        for own in (parts[k] for k in random.Random(f"{seed}/{epoch}").sample(range(len(parts)), len(parts))):
            losses.append(mean_loss(p, own))
            g, step = [], step + 1
            for k in range(len(p)):
                up, down = p[:], p[:]
                up[k] += 1e-5
                down[k] -= 1e-5
                g.append((mean_loss(up, own) - mean_loss(down, own)) / 2e-5)
            norm = math.sqrt(sum(x * x for x in g))
            g = [x * min(1, clip / (norm + 1e-6)) + decay * w for x, w in zip(g, p, strict=True)]
            m = [0.9 * a + 0.1 * b for a, b in zip(m, g, strict=True)]
            v = [0.999 * a + 0.001 * b * b for a, b in zip(v, g, strict=True)]
            p = [w - lr * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8) for w, a, b in zip(p, m, v, strict=True)]
        train_loss = statistics.fmean(losses)
        value = statistics.fmean(abs(t - (c - plain_forward(net, p, x)[0] / scale)) for _, x, _, _, c, t in val) if reconstruct else mean_loss(p, val)
        plateau, bad = (value, 0) if value < plateau * (1 - 1e-4) else (plateau, bad + 1)
        if lr_patience and bad > lr_patience:
            lr, bad = lr / 2, 0
        history.append((train_loss, value, lr))
        if value < best:
            best, best_p, waited, best_epoch = value, p, 0, epoch
        else:
            waited += 1
        if patience and waited >= patience:
            break
    return history, best_p, best_epoch


SAMPLES = "sample_id long, x array<double>, y double, is_val boolean, current double, target double"


def training_rows(n=60, inputs=3):
    rng = random.Random(11)
    out = []
    for k in range(n):
        x = [rng.uniform(-1, 1) for _ in range(inputs)]
        y = math.sin(2 * x[0]) - 0.5 * x[1] * x[2] + rng.gauss(0, 0.3)
        out.append((k, x, y, k % 3 == 0, 1.0 + x[0], 1.0 + x[0] - y / 2))
    return out


@pytest.mark.parametrize("how", ["huber", "reconstruct", "batches"])
def test_training_equals_the_plain_loop(spark, how):
    rows, net = training_rows(), training.Net(3, 4, zero_output=how == "batches")
    assert not net.zero_output or not net.start(5)[-3:].any() and net.start(5)[:12].all()
    options = dict(epochs=4, lr=0.08, patience=0, seed=5, huber_delta=0.3, lr_patience=1, batches=5) if how == "batches" else dict(epochs=25, lr=0.08, patience=3, seed=5) | (dict(huber_delta=0.3, lr_patience=1) if how == "huber" else dict(huber_delta=None, reconstruct=True, scale=2.0))
    odd = [(900, None, 1.0, False, 0.0, 0.0), (901, [1.0], 1.0, False, 0.0, 0.0), (902, [1.0, 2.0, float("nan")], 1.0, True, 0.0, 0.0), (903, [1.0, 2.0, 3.0], None, True, 0.0, 0.0)]
    model = training.train(spark.createDataFrame(rows + odd, SAMPLES), net, tasks=20, weight_decay=1e-3, clip_grad_norm=0.5, **options)
    history, p, best = plain_training(rows, net, options["epochs"], 0.08, 1e-3, options["patience"], options["huber_delta"], 0.5, options.get("lr_patience", 0), 5, how == "reconstruct", options.get("scale", 1.0), options.get("batches", 1))
    assert len(model.history) == len(history) and model.best_epoch == best and (how == "batches" or best < len(history) <= 25)
    decides = "val_mae" if how == "reconstruct" else "val_loss"
    assert [x for h in model.history for x in (h["train_loss"], h[decides], h["lr"])] == pytest.approx([x for h in history for x in h], abs=1e-5)
    assert model.parameters == pytest.approx(p, abs=1e-4)


def test_gradient_with_dropout_and_any_number_of_tasks(spark):
    rows, net = training_rows(40), training.Net(3, 8, dropout=0.3)
    df = spark.createDataFrame(rows, SAMPLES)
    models = [training.train(df.repartition(n), net, epochs=3, tasks=n, lr=0.05) for n in (1, 9)]
    assert models[0].parameters == pytest.approx(models[1].parameters, abs=1e-12)
    x, ids, flat = np.array([r[1] for r in rows]), np.arange(40), net.start(3)
    kept = net.kept(ids, 2, 9)
    assert 0.55 < np.mean(np.concatenate([k.ravel() for k in kept]) > 0) < 0.85
    g, _ = net.gradient(x, flat, lambda o: o, kept)
    for k in range(0, len(flat), 7):
        d = np.zeros(len(flat))
        d[k] = 1e-5
        up, down = (0.5 * np.sum(net.forward(x, flat + s * d, kept)["out"] ** 2) for s in (1, -1))
        assert g[k] == pytest.approx((up - down) / 2e-5, rel=1e-5, abs=1e-7)


def test_layer_as_a_column(spark):
    net = training.Net(3, 6)
    model = training.Model(net, net.start(1))
    rows = training_rows(30) + [(77, None, 0.0, False, 0.0, 0.0), (78, [1.0, None, 2.0], 0.0, False, 0.0, 0.0)]
    got = training.applied(spark.createDataFrame(rows, SAMPLES), model, layer="h2").collect()
    assert len(got) == 32
    for r in got:
        if r.sample_id in (77, 78):
            assert r.pred is None and r.hidden is None
        else:
            out, hidden = plain_forward(net, model.parameters.tolist(), r.x)
            assert r.pred == pytest.approx(out) and r.hidden == pytest.approx(hidden)
    with pytest.raises(ValueError):
        training.train(spark.createDataFrame(rows[:1], SAMPLES), net)


# --- windows in blocks ---


def test_a_hot_device_is_cut_into_blocks(spark):
    rng = random.Random(1)
    rows = [(f, k, 2 * k + (k > 50), rng.random()) for f, n in (("hot", 900), ("b", 60), ("c", 30), ("d", 5)) for k in range(n)]
    seq = spark.createDataFrame(rows, "file string, ord int, cycle_number int, soh double").repartition(5)
    sizes = []

    def run(s, key):
        sizes.append(s.groupBy(key).count().agg(F.max("count")).first()[0])
        return windows.persistence(s, 8, 3, key=key)

    want = windows.persistence(seq, 8, 3)
    got = windows.in_blocks(seq, run, 7, 3, block=40)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and max(sizes) <= 50
    slopes = windows.in_blocks(seq, lambda s, key: windows.slope(s, key, "ord", "soh"), 1, 0, block=40)
    plain = windows.slope(seq, "file", "ord", "soh")
    assert sorted(map(tuple, slopes.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        windows.in_blocks(seq, run, 7, 3, block=5)


# --- texts and plans of any size ---


def test_lines_and_documents_of_any_number_of_rows(spark, tmp_path):
    from fadeline import sinks
    from fadeline.plans import reports

    rows = [(k, f"it's {k}" if k % 3 else "a|b\nc", k / 3 if k % 2 else float("nan"), [k, 1] if k % 4 else []) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, name string, x double, list array<int>").repartition(5)
    lines = [r.line for r in sinks.markdown_lines(df, ["k", "gone", "name", "x"], [F.col("k")]).orderBy("place").collect()]
    assert "\n".join(lines) + "\n" == sinks.markdown_table([dict(zip(("k", "name", "x"), r, strict=False)) for r in rows], ["k", "gone", "name", "x"])
    plan = df.withColumn("flag", F.col("k") % 2 == 0)
    commands = reports.command_lines(plan, ["py", "a b.py"], {"the_name": "name", "flag": "flag", "list": "list"}, [F.col("k")]).orderBy("place").collect()
    assert [r.line for r in commands] == [sinks.command_text(reports.command(["py", "a b.py"], {"the_name": n, "flag": k % 2 == 0, "list": v})) for k, n, _, v in rows]
    sinks.write_lines(spark.createDataFrame([(r.place, str(r.place)) for r in commands], "place long, line string").repartition(4), f"{tmp_path}/lines")
    read = positions.as_read(spark.read.text(f"{tmp_path}/lines"))
    assert [r.value for r in read.orderBy("position").collect()] == [str(k) for k in range(1, 301)]
    yaml = {r.k: r.text for r in sinks.yaml_documents(df.limit(50), "k").collect()}
    assert all(text == sinks.yaml_text({"name": rows[k][1], "x": rows[k][2], "list": rows[k][3]}) for k, text in yaml.items())
    assert json.loads(sinks.json_document(df.select("k", "x"), "k").first().value) == [{"k": k, "x": None if math.isnan(x) else x} for k, _, x, _ in rows]


def test_the_last_line_of_a_key_counts(spark, tmp_path):
    for name, text in (("a.csv", "model,v\nx,1\ny,2\nx,3\n"), ("b.csv", "model,v\ny,4\n,5\n")):
        (tmp_path / name).write_text(text)
    assert {r.model: r.v for r in results.keyed_rows(spark, str(tmp_path), ["model", "v"]).collect()} == {"x": "3", "y": "4"}


def test_trials_run_where_their_rows_lie(spark):
    def trial(row):
        if row["k"] == 3:
            raise ValueError("three")
        return {"twice": 2 * row["k"]}

    plan, done = spark.range(6).select(F.col("id").alias("k")), spark.createDataFrame([(1,)], "k long")
    got = {r.k: (r.twice, r.status, r.reason) for r in experiments.run_on_executors(plan, done, ["k"], trial, "twice long", tasks=3).collect()}
    assert got == {k: (2 * k, "done", None) for k in (0, 2, 4, 5)} | {3: (None, "failed", "three")}
    assert experiments.run_on_executors(plan, done, ["k"], trial, "twice long", force=True).count() == 6


def test_searches_in_passes_equal_the_plain_ones(spark):
    rng = random.Random(3)
    rows = [(k % 3, rng.random(), rng.random()) for k in range(90)]
    df = spark.createDataFrame(rows, "seed int, x double, y double")
    error = lambda p: F.abs(F.col("y") - p("a") * F.col("x") - p("b"))
    plain = lambda c: statistics.fmean(abs(y - c["a"] * x - c["b"]) for _, x, y in rows)
    best, table = rungs.staged(df, {"a": 0.0, "b": 0.0}, [{"a": [0.0, 0.5, 1.0]}, {"b": [0.0, 0.2, 0.4]}, {"a": [0.1, 0.3], "b": [0.2, 0.3]}], error)
    want, history = experiments.staged_search({"a": 0.0, "b": 0.0}, [{"a": [0.0, 0.5, 1.0]}, {"b": [0.0, 0.2, 0.4]}, {"a": [0.1, 0.3], "b": [0.2, 0.3]}], plain)
    assert best == want and [r.error for r in table.orderBy("stage", "trial").collect()] == pytest.approx([h["score"] for h in history])
    trials = [{"a": 0.5, "b": 0.2}, {"a": 0.0, "b": 0.5}, {"a": 3.0, "b": 1.0}]
    by_seed = lambda c, s: statistics.fmean(abs(y - c["a"] * x - c["b"]) for k, x, y in rows if k == s)
    base = {s: statistics.fmean(abs(y - x) for k, x, y in rows if k == s) for s in range(3)}
    own = experiments.confirm(trials, [0, 1, 2], lambda c, s: (by_seed(c, s), base[s] - by_seed(c, s)), 0.7, 1.5)
    got = rungs.confirmed(df, "seed", trials, error, F.abs(F.col("y") - F.col("x")), 0.7, 1.5).orderBy("place").collect()
    assert [trials[r.trial] for r in got] == [{"a": o["a"], "b": o["b"]} for o in own]
    assert [x for r in got for x in (r["mean"], r["std"], r.gain, r.score)] == pytest.approx([o[k] for o in own for k in ("mean", "std", "gain", "score")])


def test_a_saved_network_is_the_same(spark, tmp_path):
    df = spark.createDataFrame(training_rows(30), SAMPLES)
    model = training.train(df, training.Net(3, 4, dropout=0.2), epochs=3)
    path = f"{tmp_path}/net"
    assert training.save(spark, model, path, {"split": df.select("sample_id", "is_val")}, {"gap": 20}) == 1
    again = training.load(spark, path)
    assert again.net == model.net and (again.parameters == model.parameters).all() and again.best_epoch == model.best_epoch
    assert [h["val_loss"] for h in again.history] == [h["val_loss"] for h in model.history]
    assert artefacts.table(spark, path, "split").count() == 30
    (part,) = (f for f in os.listdir(f"{path}/v000001/content/document.json") if f.startswith("part"))
    os.remove(f"{path}/v000001/content/document.json/{part}")
    with pytest.raises(ValueError, match="missing"):
        training.load(spark, path)


def test_predictions_without_a_key_meet_by_place(spark):
    from fadeline.plans import predict

    samples = positions.ordered(spark.createDataFrame([(k, f"s{k}") for k in range(50)], "k int, name string"), "k")
    pred = positions.ordered(spark.createDataFrame([(float(k),) for k in range(50)], "pred double").repartition(7), "pred")
    assert all(r.pred == r.k for r in predict.predict("any", samples, external=pred, by_place="position").collect())
    with pytest.raises(ValueError):
        predict.predict("any", samples, external=pred.filter("position < 9"), by_place="position")


def test_a_trained_network_is_a_predictor(spark):
    from fadeline.plans import predict

    rows = training_rows(40)
    df = spark.createDataFrame(rows, SAMPLES)
    model = training.Model(training.Net(3, 4), training.Net(3, 4).start(2))
    training.register("own_mlp", model, df)
    assert "own_mlp" in predict.parse_models("all")
    assert [r.pred for r in predict.predict("own_mlp", df).orderBy("sample_id").collect()] == pytest.approx([plain_forward(model.net, model.parameters.tolist(), r[1])[0] for r in rows])
    with pytest.raises(ValueError):
        predict.predict("own_mlp", df.drop("x"))
    runs = [{"seed": s, "horizon": h} for s in (1, 2) for h in (5, 6)]
    both = df.withColumn("horizon", F.lit(5)).unionByName(df.withColumn("horizon", F.lit(6)).withColumn("y", F.col("y") * 2))
    table = training.train_and_evaluate(both, runs, training.Net(3, 4), epochs=3, huber_delta=None).collect()
    assert sorted((r.seed, r.horizon, r.n) for r in table) == [(s, h, 14) for s in (1, 2) for h in (5, 6)] and all(r.n_epochs == 3 and r.MAE > 0 for r in table)
