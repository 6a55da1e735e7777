"""Registered queries of splits by permutation, files that differ, places, states, artefacts, configurations, rungs and training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import artefacts, sinks
from ..functions import arrays
from ..operators import anomaly, isolation, normalize, positions, ranking, splits, state, windows
from ..sources import cells, cellsource, configs, results, tables
from . import experiments, reports, rungs, training
from .queries import HORIZON, LOOKBACK, SEQ, TRIALS, query, sequence, trials
from .source_queries import CELLS, _new_path, cell_table

# --- splits ----------------------------------------------------------------------------------------


def _place(keys: str, key: str, seed: int = 42) -> str:
    return f"SELECT k AS {key}, row_number() OVER (ORDER BY sha256('{seed}/' || k), k) AS place, count(*) OVER () AS n FROM ({keys}) WHERE k IS NOT NULL"


def _cut(val: float, test: float) -> str:
    k = lambda share: f"greatest(1, CAST(round_even(n * {share}, 0) AS BIGINT))"
    return f"CASE WHEN place <= n - {k(test)} - {k(val)} THEN 'train' WHEN place <= n - {k(test)} THEN 'val' ELSE 'test' END"


@query(f"WITH p AS ({_place('SELECT p_partkey AS k FROM part', 'p_partkey')}) SELECT p_partkey, {_cut(0.15, 0.15)} AS split FROM p")
def file_split_assign(read):
    """Which part goes where."""
    return splits.random_split(read("part"), "p_partkey", 42)


@query(f"WITH p AS ({_place('SELECT DISTINCT o_custkey AS k FROM orders', 'o_custkey')}) SELECT o_custkey, {_cut(0.2, 0.2)} AS split FROM p")
def battery_split_assign(read):
    return splits.battery_split(read("orders"), "o_custkey", 42)


@query(f"WITH p AS ({_place('SELECT DISTINCT p_brand AS k FROM part', 'p_brand')}) SELECT p_partkey, part.p_brand, {_cut(0.15, 0.15)} AS split FROM part JOIN p ON p.p_brand = part.p_brand")
def condition_split_assign(read):
    """Brands go whole."""
    return splits.group_split(read("part"), "p_partkey", "p_brand", 42)


@query(f"""WITH k AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), s AS (SELECT l_suppkey, count(*) AS m FROM k GROUP BY 1), p AS ({_place('SELECT l_suppkey AS k FROM s', 'l_suppkey')}),
u AS (SELECT l_suppkey, m, sum(m) OVER (ORDER BY place) - m AS before, sum(m) OVER (ORDER BY place) AS upto, sum(m) OVER () AS total FROM s JOIN p USING (l_suppkey)), t AS (SELECT *, greatest(1, round_even(total * 0.15, 0)) AS q FROM u),
e AS (SELECT max(upto) AS tested FROM t WHERE before < q) SELECT l_orderkey, k.l_suppkey, CASE WHEN before < q THEN 'test' WHEN before < tested + q THEN 'val' ELSE 'train' END AS split FROM k JOIN t ON t.l_suppkey = k.l_suppkey, e""")
def quota_split_assign(read):
    """Suppliers go whole, dealt by how many orders they have."""
    return splits.quota_split(read("lineitem"), "l_orderkey", "l_suppkey", 42)


@query(f"""WITH z AS (SELECT c_mktsegment AS d, count(*) AS m FROM customer GROUP BY 1), f AS (SELECT d, m FROM z ORDER BY m DESC, sha256('7/' || d), d LIMIT 1), p AS ({_place("SELECT c_custkey AS k FROM customer, f WHERE c_mktsegment = f.d", 'c_custkey', 7)})
SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment <> f.d THEN 'train' WHEN (SELECT place FROM p WHERE p.c_custkey = customer.c_custkey) <= f.m // 2 THEN 'val' ELSE 'test' END AS split FROM customer, f""")
def domain_split_assign(read):
    """The largest segment is held out and halved."""
    return splits.domain_split(read("customer"), "c_custkey", "c_mktsegment", 7)


@query(f"WITH {SEQ}, c AS (SELECT file, cycle_number, count(*) OVER (PARTITION BY file) AS n, row_number() OVER (PARTITION BY file ORDER BY cycle_number) AS place FROM seq), k AS (SELECT *, greatest(1, CAST(round_even((n - 10) * 0.15, 0) AS BIGINT)) AS p FROM c) SELECT file, cycle_number, CASE WHEN n - 10 < 3 THEN NULL WHEN place <= n - 10 - 2 * p THEN 'train' WHEN place <= n - 5 - 2 * p THEN 'gap_train_val' WHEN place <= n - 5 - p THEN 'val' WHEN place <= n - p THEN 'gap_val_test' ELSE 'test' END AS segment FROM k")
def gap_split_by_ranges(read):
    """The gapped split of sequences, without a file in one task."""
    s = sequence(read).select("file", "cycle_number")
    return splits.chronological_by_ranges(s, gap=5, order=("cycle_number",))


@query(f"""WITH {SEQ}, win AS (SELECT *, lag(cycle_number, {LOOKBACK - 1}) OVER w AS input_start_cycle, lead(cycle_number, {HORIZON}) OVER w AS target_cycle, lead(soh, {HORIZON}) OVER w AS target, row_number() OVER w AS place FROM seq WINDOW w AS (PARTITION BY file ORDER BY cycle_number))
SELECT file, input_start_cycle, cycle_number AS input_end_cycle, target_cycle, round(target, 6) AS target, round(soh, 6) AS pred FROM win WHERE place >= {LOOKBACK} AND target IS NOT NULL""")
def persistence_in_blocks(read):
    """Samples and baseline of sequences cut into blocks of 64 rows, with what windows see of their neighbours."""
    run = lambda s, key: windows.persistence(s, LOOKBACK, HORIZON, key=key)
    out = windows.in_blocks(sequence(read), run, LOOKBACK - 1, HORIZON, block=64)
    return out.select("file", "input_start_cycle", "input_end_cycle", "target_cycle", "target", "pred")


# --- files that differ, cells, places ----------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS priority FROM orders")
def tables_by_header(read):
    """Orders in three files' worth of columns: whole, without the price and in another order, with a further column."""
    o = read("orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    path = _new_path(o.sparkSession, "tables")
    for k, columns in enumerate((["key", "price", "status"], ["status", "key"], ["priority", "price", "key"])):
        sinks.write_csv(o.filter(F.col("key") % 3 == k).select(*columns), f"{path}/run-{k}")
    known = "key long, price double, status string"
    rows = tables.read_tables(o.sparkSession, [path, f"{path}/run-1"], _schema(o, known))
    return rows.select(F.col("key").alias("o_orderkey"), "price", "status", F.col("extras")["priority"].alias("priority"))


def _schema(df: DataFrame, text: str):
    return df.sparkSession.createDataFrame([], text).schema


@query("WITH h AS (SELECT l_suppkey % 8 AS model, l_linenumber AS run, avg(l_discount) AS mae, avg(l_tax) AS rmse FROM lineitem GROUP BY ALL) SELECT run::BIGINT AS run, model::VARCHAR AS model, CASE WHEN run % 2 = 0 THEN round(mae, 6) END AS mae, round(rmse, 6) AS rmse FROM h")
def metrics_by_header(read):
    """Metric files of runs, some without a column, found below a folder."""
    t = trials(read).groupBy("model", F.col("seed").alias("run")).agg(F.avg("mae").alias("MAE"), F.avg("rmse").alias("RMSE"))
    path = _new_path(t.sparkSession, "metrics")
    for odd, columns in ((0, ["RMSE", "model", "run", "MAE"]), (1, ["model", "run", "RMSE"])):
        sinks.write_csv(t.filter(F.col("run") % 2 == odd).select(*columns), f"{path}/{odd}")
    rows = results.find_metrics(t.sparkSession, [path], name="*.csv")
    return rows.select(F.col("extras")["run"].cast("long").alias("run"), "model", F.col("MAE").alias("mae"), F.col("RMSE").alias("rmse"))


@query("WITH n(k, names) AS (VALUES (0, 's_suppkey,s_name'), (1, 's_name,s_acctbal,s_suppkey')) SELECT k::BIGINT AS run, names, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = k) AS n_rows FROM n")
def header_inventory(read):
    """The headers of files alone, and the rows under each."""
    s = read("supplier")
    path = _new_path(s.sparkSession, "headers")
    for k, columns in ((0, ["s_suppkey", "s_name"]), (1, ["s_name", "s_acctbal", "s_suppkey"])):
        sinks.write_csv(s.filter(F.col("s_suppkey") % 2 == k).select(*columns), f"{path}/{k}")
    run = lambda c: F.regexp_extract(c, r"/(\d)/[^/]*$", 1).cast("long")
    heads = tables.headers(tables.listed(s.sparkSession, [path], "*.csv")).filter(F.size("header") > 0).select(run("path").alias("run"), F.array_join("header", ",").alias("names")).distinct()
    rows = tables.read_tables(s.sparkSession, [path], _schema(s, "s_suppkey long")).groupBy(run("path").alias("run")).agg(F.count("*").alias("n_rows"))
    return heads.join(rows, "run")


@query(f"WITH {CELLS} SELECT 'MATR_b1c' || user_id || '.pkl' AS file, 'MATR_b1c' || user_id AS cell_id, n AS cycle_number, row_number() OVER (PARTITION BY user_id ORDER BY n) AS place, round(soh, 6) AS soh FROM cy WHERE soh IS NOT NULL AND has_feature")
def usable_cycles_of_pickles(read):
    """Every cell of events written as a pickled file and read back by the data source, then sorted, referenced, labelled and reduced to features in one go."""
    table = cell_table(read)
    spark = table.sparkSession
    path = _new_path(spark, "pickles")
    cellsource.register(spark)
    table.write.format("cells").mode("append").save(path)
    found = arrays.usable_cycles(spark.read.format("cells").load(path), 4)
    place = F.row_number().over(W.partitionBy("file").orderBy("ord"))
    return found.filter(F.size("feature.v") == 4).select("file", "cell_id", "cycle_number", place.alias("place"), "soh")


@query("SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice + 1 AS pred FROM orders")
def zipped_by_place(read):
    """Metadata and predictions in files of different numbers, in one order: they meet by place alone."""
    o = read("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") + 1).alias("pred"))
    path = _new_path(o.sparkSession, "places")
    for name, columns, n in (("meta", ["key", "status"], 3), ("pred", ["pred"], 5)):
        sinks.write_csv(o.repartitionByRange(n, "key").sortWithinPartitions("key").select(*columns), f"{path}/{name}")
    meta = positions.as_read(results.read_csv(o.sparkSession, f"{path}/meta", "key long, status string"))
    pred = positions.as_read(results.read_csv(o.sparkSession, f"{path}/pred", "pred double"))
    return positions.zipped(meta, pred).select("key", "status", "pred")


@query("SELECT round(avg(abs(o_totalprice - p)), 6) AS mae, count(*) AS n FROM (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p IS NOT NULL")
def errors_by_place(read):
    """Every price against the one before it, by place in an order."""
    o = positions.ordered(read("orders").select("o_orderkey", F.col("o_totalprice").alias("actual")), "o_orderkey")
    before = o.select((F.col("position") + 1).alias("position"), F.col("actual").alias("pred"))
    met = o.join(before, "position")
    return met.agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae"), F.count("*").alias("n"))


# --- states and artefacts ----------------------------------------------------------------------------


@query(f"WITH {TRIALS}, e AS (SELECT model, horizon, unnest(['mae', 'rmse']) AS metric, unnest([mae, rmse]) AS x FROM trials) SELECT model, horizon, metric, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max FROM e GROUP BY ALL")
def merged_rollup(read):
    """Summaries out of states: trials come in seven batches, one of them twice; four are compacted before the others come."""
    t, by = trials(read), ("model", "horizon")
    spark = t.sparkSession
    path = _new_path(spark, "states")
    for seed in (1, 2, 3, 4, 2):
        state.deliver(t.filter(F.col("seed") == seed), by, ("mae", "rmse"), path, f"seed-{seed}")
    state.compact(spark, path, by)
    for seed in (5, 6, 7):
        state.deliver(t.filter(F.col("seed") == seed), by, ("mae", "rmse"), path, f"seed-{seed}")
    return state.summary(state.delivered(spark, path), by)


@query("SELECT 'acctbal' AS channel, round(avg(s_acctbal), 6) AS mean, round(stddev_pop(s_acctbal) + 1e-8, 6) AS std, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS n_keys, 20 AS lookback, 2 AS version, 0 AS damaged FROM supplier WHERE s_suppkey % 3 = 0")
def artefact_versions(read):
    """Constants, keys and a document published twice; the newest version is read, whole."""
    s = read("supplier").select("s_suppkey", F.array("s_acctbal").alias("acctbal"))
    spark = s.sparkSession
    path = _new_path(spark, "artefact")
    for rest in (1, 0):
        own = s.filter(F.col("s_suppkey") % 3 == rest)
        number = artefacts.publish(spark, path, {"constants": normalize.fit_channels(own, {"acctbal": "acctbal"}), "split": own.select("s_suppkey")}, {"lookback": LOOKBACK})
    keys = artefacts.table(spark, path, "split").agg(F.count("*").alias("n_keys"))
    told = artefacts.document(spark, path).select(F.from_json("value", "lookback long")["lookback"].alias("lookback"))
    hurt = artefacts.damaged(spark, path).agg(F.count("*").alias("damaged"))
    out = artefacts.table(spark, path, "constants").select("channel", "mean", "std")
    for one_row in (keys, told, hurt):
        out = out.crossJoin(F.broadcast(one_row))
    return out.withColumn("version", F.lit(number))


# --- configurations ----------------------------------------------------------------------------------

MODELS = ["cpmlp", "cpgru"]


def config_documents(read) -> DataFrame:
    """(path, value): a document for each part, in one of the three forms, or broken, by its size."""
    p = read("part")
    size = F.col("p_size")
    entry = F.format_string(
        '{"model": %s, "lr": %s, "model_hidden": %s, "zero_output_init": %s, "target_scale": %s}', F.when(size % 2 == 0, '"cpmlp"').otherwise('"*"'), F.when(size % 7 == 0, "null").otherwise(F.concat(F.lit("0.0"), size.cast("string"))),
        F.when(size % 5 == 0, "64.9").when(size % 5 == 1, '"96"').otherwise("128"), F.when(size % 3 == 0, '"Yes"').when(size % 3 == 1, "false").otherwise("1"), F.when(size % 11 == 0, "-1").otherwise("2"),
    )
    under = F.regexp_replace(entry, r'"model": "[^"]*", ', "")
    form = F.when(size % 13 == 0, "{broken").when(size % 4 == 0, F.concat(F.lit("["), entry, F.lit(", 5]"))).when(size % 4 == 1, F.concat(F.lit('{"configs": ['), entry, F.lit("]}"))).otherwise(F.concat(F.lit('{"cpgru": ['), under, F.lit('], "note": "x"}')))
    return p.select(F.col("p_partkey").cast("string").alias("path"), form.alias("value"))


_VALUES = "CASE WHEN p_size % 7 = 0 THEN 0.001 ELSE CAST('0.0' || p_size AS DOUBLE) END AS lr, CASE WHEN p_size % 5 = 0 THEN 64 WHEN p_size % 5 = 1 THEN 96 ELSE 128 END AS model_hidden, p_size % 3 <> 1 AS zero_output_init, CASE WHEN p_size % 11 = 0 THEN 'target_scale is not positive' END AS fault"


@query(f"""WITH m AS (SELECT unnest(['cpmlp', 'cpgru']) AS model), d AS (SELECT *, CASE WHEN p_size % 13 = 0 THEN 'broken' WHEN p_size % 4 = 0 THEN 'list' WHEN p_size % 4 = 1 THEN 'configs' ELSE 'under' END AS form FROM part),
g AS (SELECT p_partkey, 1 AS number, model, {_VALUES} FROM d, m WHERE form <> 'broken' AND CASE WHEN form = 'under' THEN model = 'cpgru' WHEN p_size % 2 = 0 THEN model = 'cpmlp' ELSE true END),
x AS (SELECT p_partkey, number, model, lr, model_hidden, zero_output_init, fault FROM g UNION ALL SELECT p_partkey, NULL, NULL, 0.001, 256, false, 'no document of configurations' FROM d WHERE form = 'broken' UNION ALL SELECT p_partkey, 2, NULL, 0.001, 256, false, 'entry is no object' FROM d WHERE form = 'list'
UNION ALL SELECT p_partkey, NULL, m.model, NULL, NULL, NULL, 'no configuration' FROM d, m WHERE form <> 'broken' AND NOT EXISTS (SELECT 1 FROM g WHERE g.p_partkey = d.p_partkey AND g.model = m.model AND g.fault IS NULL))
SELECT CAST(p_partkey AS VARCHAR) AS path, number, model, lr, model_hidden, zero_output_init, fault FROM x""")
def configuration_documents(read):
    """Configurations and faults out of a document per part."""
    return configs.configurations(config_documents(read), MODELS, experiments.BASE_CONFIG).select("path", "number", "model", "lr", "model_hidden", "zero_output_init", "fault")


@query("""WITH d AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS c, o_custkey % 40 AS h FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN c IN (0, 1, 2) THEN h END AS horizon, CASE WHEN c = 0 THEN o_custkey END AS lookback, CASE c WHEN 1 THEN CASE WHEN h <> 7 THEN 'another horizon inside' END WHEN 2 THEN 'config is no object' WHEN 3 THEN 'horizon is no number' WHEN 4 THEN 'no document of configurations' END AS fault FROM d""")
def horizon_documents(read):
    """Documents keyed by horizon, a few of each fault."""
    o = read("orders").withColumn("h", (F.col("o_custkey") % 40).cast("string"))
    own = lambda inner: F.concat(F.lit('{"'), F.col("h"), F.lit('": '), inner, F.lit("}"))
    case = F.col("o_orderkey") % 5
    value = F.when(case == 0, own(F.concat(F.lit('{"lookback": '), F.col("o_custkey").cast("string"), F.lit(', "model": "cpmlp"}')))).when(case == 1, own(F.lit('{"horizon": "7"}'))).when(case == 2, own(F.lit("[1]"))).when(case == 3, '{"ten": {}}').otherwise("[]")
    rows = configs.by_horizon(o.select(F.col("o_orderkey").cast("string").alias("path"), value.alias("value")), "cpmlp")
    return rows.select("path", "horizon", F.try_variant_get("config", "$.lookback", "long").alias("lookback"), "fault")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE WHEN s_nationkey % 3 = 0 THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END AS dropout, CASE WHEN s_nationkey % 3 = 1 THEN 48 ELSE 64 END AS gru_hidden, CASE WHEN s_nationkey % 3 = 2 THEN 'no fit: lr' END AS fault FROM supplier")
def merged_configs(read):
    """One object each over the defaults."""
    n = F.col("s_nationkey") % 3
    text = F.when(n == 0, '{"dropout": "0.25"}').when(n == 1, '{"gru_hidden": 48.7, "dropout": null}').otherwise('{"lr": "fast"}')
    return configs.merged(read("supplier").select(F.col("s_suppkey").cast("string").alias("path"), text.alias("value")), experiments.BASE_CONFIG).select("path", "dropout", "gru_hidden", "fault")


# --- rungs and training ------------------------------------------------------------------------------

ALPHAS = [k / 8 for k in range(16)]
_LAGS = f"{SEQ}, b AS (SELECT file % 5 AS rung, soh, lag(soh) OVER w AS before, lead(soh) OVER w AS target FROM seq WINDOW w AS (PARTITION BY file ORDER BY cycle_number))"


def _race_sql() -> str:
    text = f"WITH {_LAGS}, e AS (SELECT t.k AS trial, rung, avg(abs(target - (soh * t.k / 8 + before * (1 - t.k / 8)))) AS error FROM b, range(16) t(k) WHERE before IS NOT NULL AND target IS NOT NULL GROUP BY ALL), s AS (SELECT trial, rung, error, avg(error) OVER w + 0.5 * coalesce(stddev_samp(error) OVER w, 0) AS score FROM e WINDOW w AS (PARTITION BY trial ORDER BY rung)), a0 AS (SELECT trial FROM s WHERE rung = 0)"
    for k in range(5):
        rule = f"NOT (SELECT count(*) >= 3 FROM a{k}) OR score <= (SELECT median(score) FROM s JOIN a{k} USING (trial) WHERE rung = {k})" if k else "true"
        text += f", a{k + 1} AS (SELECT trial FROM s JOIN a{k} USING (trial) WHERE rung = {k} AND ({rule}))"
    each = [f"SELECT trial, {k} AS rung, round(error, 6) AS error, round(score, 6) AS score, CASE WHEN trial NOT IN (SELECT trial FROM a{k + 1}) THEN 'pruned' WHEN {k} = 4 THEN 'complete' ELSE 'running' END AS state FROM s JOIN a{k} USING (trial) WHERE rung = {k}" for k in range(5)]
    return f"{text} {' UNION ALL '.join(each)}"


@query(_race_sql())
def rung_survivors(read):
    """Sixteen weights of the last two values as a forecast, five groups of sequences as rungs, half of the trials pruned after each but the first."""
    w = W.partitionBy("file").orderBy("ord")
    s = sequence(read).select((F.col("file") % 5).alias("rung"), "soh", F.lag("soh").over(w).alias("before"), F.lead("soh").over(w).alias("target"))
    error = lambda p: F.abs(F.col("target") - (F.col("soh") * p("a") + F.col("before") * (1 - p("a"))))
    return rungs.race(s, "rung", [{"a": a} for a in ALPHAS], error, weight=0.5)


def training_samples(read) -> DataFrame:
    """(sample_id, x, y, is_val, current, target, cell_id, target_cycle): eight values and the change to the one ten places on, all over a hundred."""
    s = windows.sliding_samples(sequence(read), 8, HORIZON, history=("soh",))
    current, target = F.col("soh") / 100, F.col("target") / 100
    return s.select((F.col("file") * 1_000_000 + F.col("input_end_cycle")).alias("sample_id"), F.transform("history_soh", lambda v: v / 100).alias("x"), (current - target).alias("y"), (F.col("file") % 5 == 0).alias("is_val"), current.alias("current"), target.alias("target"), F.col("file").alias("cell_id"), "target_cycle")


def _trained(read, epochs: int = 6) -> training.Model:
    return training.train(training_samples(read), training.Net(8, 16, dropout=0.1), epochs=epochs, lr=0.01, huber_delta=None, reconstruct=True, patience=3, lr_patience=2)


@query(None)
def mlp_training(read):
    """History of a flat MLP that learns changes and is selected by the error of the values rebuilt."""
    return training.history(read("events").sparkSession, _trained(read))


@query(None)
def mlp_predictions(read):
    """(cell_id, target_cycle, actual, pred) of validation sequences by the trained network."""
    model = _trained(read, 3)
    rows = training.applied(training_samples(read).filter("is_val"), model, name="change")
    return rows.select("cell_id", "target_cycle", F.col("target").alias("actual"), (F.col("current") - F.col("change")).alias("pred"))


@query(f"WITH {SEQ}, w AS (SELECT file, row_number() OVER v AS place, lead(soh, {HORIZON}) OVER v AS target FROM seq WINDOW v AS (PARTITION BY file ORDER BY cycle_number)) SELECT CASE WHEN file % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, true AS same, 1 AS version FROM w WHERE place >= 8 AND target IS NOT NULL GROUP BY 1")
def mlp_checkpoint(read):
    """A trained network published with the split that it was trained on, read back, and held against itself on every sample."""
    samples = training_samples(read)
    spark, model = samples.sparkSession, _trained(read, 2)
    path = _new_path(spark, "network")
    split = samples.select("sample_id", F.when(F.col("is_val"), "val").otherwise("train").alias("split"))
    number = training.save(spark, model, path, {"split": split}, {"lookback": 8, "horizon": HORIZON})
    both = training.applied(training.applied(samples, model, name="own"), training.load(spark, path), name="read")
    met = both.join(artefacts.table(spark, path, "split"), "sample_id")
    return met.groupBy("split").agg(F.count("*").alias("n"), F.bool_and(F.col("own") == F.col("read")).alias("same")).withColumn("version", F.lit(number))


@query(None)
def mlp_latent_flags(read):
    """Anomalies by residual, slope and how odd the trained network's hidden layer is against that of other sequences."""
    model = _trained(read, 2)
    rows = training.applied(training_samples(read).filter("is_val"), model, name="change", layer="h2")
    rows = rows.withColumn("residual", F.abs(F.col("target") - (F.col("current") - F.col("change"))))
    reference, own = (rows.filter((F.col("cell_id") % 10 == 0) == (k == 0)) for k in (0, 1))
    score = isolation.latent_score(reference, "hidden", ["sample_id"], trees=50)
    reference, own = (t.withColumn("latent", score(F.col("hidden"))) for t in (reference, own))
    return anomaly.anomaly_flags(own, reference, latent="latent").select("cell_id", "target_cycle", "anomaly_score", "is_anomaly")


_GRID = "e AS (SELECT s, t, avg(abs(target - (soh * s / 4.0 + before * t / 4.0))) AS error FROM b, range(5) x(s), range(5) y(t) WHERE before IS NOT NULL AND target IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_LAGS}, {_GRID}, one AS (SELECT 0 AS stage, s AS trial, error, s, 0 AS t FROM e WHERE t = 0), o AS (SELECT s FROM one ORDER BY error, trial LIMIT 1), two AS (SELECT 1 AS stage, t AS trial, error, e.s, t FROM e, o WHERE e.s = o.s),
every AS (SELECT * FROM one UNION ALL SELECT * FROM two), r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY error, trial) AS pl FROM every) SELECT stage::BIGINT AS stage, trial::BIGINT AS trial, round(error, 6) AS error, pl = 1 AS is_best, (s / 4.0)::DOUBLE AS a, (t / 4.0)::DOUBLE AS c FROM r""")
def staged_search(read):
    """Coordinate search over two weights, a pass per stage."""
    w = W.partitionBy("file").orderBy("ord")
    s = sequence(read).select("soh", F.lag("soh").over(w).alias("before"), F.lead("soh").over(w).alias("target"))
    error = lambda p: F.abs(F.col("target") - (F.col("soh") * p("a") + F.col("before") * p("c")))
    steps = [k / 4 for k in range(5)]
    return rungs.staged(s.dropna(), {"a": 0.0, "c": 0.0}, [{"a": steps}, {"c": steps}], error)[1]


@query(f"""WITH {_LAGS}, e AS (SELECT t.k AS trial, rung, avg(abs(target - (soh * t.k / 8 + before * (1 - t.k / 8)))) AS error, avg(abs(target - soh)) AS base FROM b, range(16) t(k) WHERE before IS NOT NULL AND target IS NOT NULL GROUP BY ALL),
m AS (SELECT trial, avg(error) AS mean, stddev_samp(error) AS std, avg(base - error) AS gain FROM e GROUP BY 1), c AS (SELECT *, mean + std + CASE WHEN gain < 0 THEN 2 * abs(gain) ELSE 0 END AS score FROM m)
SELECT trial, round(mean, 6) AS mean, round(std, 6) AS std, round(gain, 6) AS gain, round(score, 6) AS score, row_number() OVER (ORDER BY gain > 0 DESC, score, trial) AS place FROM c""")
def confirmed_candidates(read):
    """Sixteen weights over five groups of sequences in one pass."""
    w = W.partitionBy("file").orderBy("ord")
    s = sequence(read).select((F.col("file") % 5).alias("rung"), "soh", F.lag("soh").over(w).alias("before"), F.lead("soh").over(w).alias("target")).dropna()
    error = lambda p: F.abs(F.col("target") - (F.col("soh") * p("a") + F.col("before") * (1 - p("a"))))
    return rungs.confirmed(s, "rung", [{"a": a} for a in ALPHAS], error, F.abs(F.col("target") - F.col("soh")), weight=1.0, penalty=2.0)


@query(None)
def mlp_by_seed_and_horizon(read):
    """Metrics of one flat MLP per seed and horizon."""
    parts = []
    for h in (HORIZON, 2 * HORIZON):
        s = windows.sliding_samples(sequence(read), 8, h, history=("soh",))
        current, target = F.col("soh") / 100, F.col("target") / 100
        parts.append(s.select((F.col("file") * 1_000_000 + F.col("input_end_cycle")).alias("sample_id"), F.lit(h).alias("horizon"), F.transform("history_soh", lambda v: v / 100).alias("x"), (current - target).alias("y"), (F.col("file") % 5 == 0).alias("is_val"), current.alias("current"), target.alias("target")))
    runs = [{"seed": s, "horizon": h} for s in (1, 2) for h in (HORIZON, 2 * HORIZON)]
    return training.train_and_evaluate(parts[0].unionByName(parts[1]), runs, training.Net(8, 8), epochs=2, lr=0.01, huber_delta=None)


# --- texts, files and plans of any size ----------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS place, 'python run.py --models ' || CASE WHEN regexp_matches(o_orderpriority, '^[A-Za-z0-9_./:=-]+$') THEN o_orderpriority ELSE '''' || o_orderpriority || '''' END || ' --seed ' || o_orderkey || CASE WHEN o_custkey % 2 = 0 THEN ' --zero-output-init' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN ' --horizons ''1,' || o_custkey || '''' ELSE '' END AS line FROM orders")
def command_lines(read):
    """A command for every order, in the order of keys, written to text files and read back."""
    o = read("orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("seed"), (F.col("o_custkey") % 2 == 0).alias("zero"), F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit(1).cast("long"), "o_custkey")).alias("horizons"))
    lines = reports.command_lines(o, ["python", "run.py"], {"models": "model", "seed": "seed", "zero_output_init": "zero", "horizons": "horizons"}, [F.col("seed")])
    path = _new_path(o.sparkSession, "commands")
    sinks.write_lines(lines, path)
    return positions.as_read(o.sparkSession.read.text(path)).select((F.col("position") + 1).alias("place"), F.col("value").alias("line"))


@query("SELECT CAST(-1 AS BIGINT) AS place, '| p_partkey | p_name | size |' AS line UNION ALL SELECT 0, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY p_partkey), '| ' || p_partkey || ' | ' || p_name || ' | ' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE (p_size // 2) || '.5' END || ' |' FROM part")
def markdown_table_lines(read):
    """A Markdown table of every part."""
    p = read("part").select("p_partkey", "p_name", (F.col("p_size") / 2).alias("size"))
    return sinks.markdown_lines(p, ["p_partkey", "p_name", "absent", "size"], [F.col("p_partkey")])


@query(f"""WITH {TRIALS}, m AS (SELECT 'm' || model || '-' || horizon AS model, avg(mae) AS mae FROM trials GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY mae, model) AS rank FROM m)
SELECT unnest([-9, -8, -7, -6, -4, -3, -2, -1, 0])::BIGINT AS place, unnest(['# Model selection', '', '## Selected', '', '', '## Ranking', '', '| rank | model |', '|---|---|']) AS line UNION ALL SELECT -5, '`' || model || '` is selected by least error.' FROM r WHERE rank = 1 UNION ALL SELECT rank, '| ' || rank || ' | ' || model || ' |' FROM r""")
def selection_report_lines(read):
    """The selection report of all models and years."""
    t = trials(read).groupBy(F.concat(F.lit("m"), F.col("model").cast("string"), F.lit("-"), F.col("horizon").cast("string")).alias("model")).agg(F.avg("mae").alias("mae"))
    ranked = positions.ordered(t, "mae", "model", name="rank").withColumn("rank", F.col("rank") + 1)
    return reports.selection_lines(ranked, "least error", ["rank", "model"])


@query("SELECT p_partkey, 'brand: ' || CASE WHEN regexp_matches(p_brand, '^[A-Za-z_./][A-Za-z0-9_./ -]*$') THEN p_brand ELSE '\"' || p_brand || '\"' END || chr(10) || 'sizes:' || chr(10) || '  - ' || p_size || chr(10) || '  - 1' || chr(10) || 'flag: ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'null' END || chr(10) AS text FROM part")
def yaml_documents(read):
    """A YAML document for every part."""
    p = read("part").select("p_partkey", F.col("p_brand").alias("brand"), F.array(F.col("p_size").cast("int"), F.lit(1)).alias("sizes"), F.when(F.col("p_size") % 2 == 0, True).alias("flag"))
    return sinks.yaml_documents(p, "p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'fails at ' || o_orderkey END AS reason, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 2, 6) END AS error FROM orders WHERE o_orderkey % 4 <> 0")
def trials_on_executors(read):
    """A plan of all orders of which a quarter is completed; trials run in tasks, some fail, and the others go on."""

    def trial(row: dict) -> dict:
        if row["o_orderkey"] % 7 == 0:
            raise RuntimeError(f"fails at {row['o_orderkey']}")
        return {"error": row["o_totalprice"] / 2}

    o = read("orders").select("o_orderkey", "o_totalprice")
    done = o.filter("o_orderkey % 4 = 0").select("o_orderkey")
    return experiments.run_on_executors(o, done, ["o_orderkey"], trial, "error double").select("o_orderkey", "status", "reason", "error")


@query("SELECT 'MATR_b1c' || user_id || '.pkl' AS name, row_number() OVER (ORDER BY 'MATR_b1c' || user_id || '.pkl') AS place FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 10 <> 3")
def found_files(read):
    """Files below a folder by path, those of some names left out."""
    table = cell_table(read)
    spark = table.sparkSession
    path = _new_path(spark, "found")
    cellsource.register(spark)
    table.write.format("cells").mode("append").save(f"{path}/deep")
    files = cells.chosen_files(cells.find_files(spark, path), "MATR", r"3\.pkl$")
    return positions.ordered(files.select("name"), "name", name="place").withColumn("place", F.col("place") + 1)


@query("SELECT o_orderkey AS sample_id, 'm' || o_custkey % 3 AS model, o_totalprice AS pred FROM orders")
def prediction_files(read):
    """Prediction files whose names have their model."""
    o = read("orders").select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), F.col("o_totalprice").alias("pred"))
    path = _new_path(o.sparkSession, "predictions")
    for k in range(3):
        sinks.write_csv(o.filter(F.col("model") == f"m{k}").drop("model"), f"{path}/m{k}_predictions.csv")
    rows = results.predictions(o.sparkSession, f"{path}/*/*.csv", r"([^/]+?)_predictions\.csv/")
    return rows.select(F.col("sample_id").cast("long").alias("sample_id"), "model", "pred")


@query("SELECT l_suppkey % 8 AS run, l_linenumber AS model, count(*) AS n, CASE WHEN l_suppkey % 8 < 4 THEN 'gap-' || l_suppkey % 8 END AS split FROM lineitem GROUP BY ALL")
def sidecar_documents(read):
    """Metric files of eight runs, four with a document beside them that says how they were split."""
    t = read("lineitem").groupBy((F.col("l_suppkey") % 8).alias("run"), F.col("l_linenumber").cast("string").alias("model")).agg(F.count("*").cast("double").alias("MAE"))
    spark, path = t.sparkSession, _new_path(t.sparkSession, "runs")
    sinks.write_csv(t, f"{path}/all")
    for k in range(8):
        sinks.write_csv(t.filter(F.col("run") == k).select("model", "MAE"), f"{path}/run-{k}")
        if k < 4:
            spark.createDataFrame([(f'{{"split": "gap-{k}"}}',)], "value string").coalesce(1).write.mode("append").text(f"{path}/run-{k}")
    info = results.sidecars(spark, [f"{path}/run-{k}" for k in range(8)], "split string", "*.txt")
    rows = results.find_metrics(spark, [path], exclude=f"{path}/all", name="*.csv")
    met = results.with_sidecars(rows, info)
    return met.select(F.regexp_extract("folder", r"run-(\d)$", 1).cast("long").alias("run"), F.col("model").cast("long").alias("model"), F.col("MAE").cast("long").alias("n"), F.col("info.split").alias("split"))


@query("SELECT p_partkey, p_size >= 20 - 1 AS search, p_size >= 20 AS experiments, p_size >= 20 AS audit, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END, CASE WHEN p_size % 2 = 0 THEN 0 END, -1) AS given FROM part")
def gap_policies(read):
    """Whether a gap fits under each policy; the first value given, an explicit 0 counted."""
    size = F.col("p_size")
    own = [splits.gap_fits(p, size, F.lit(20)).alias(p) for p in ("search", "experiments", "audit")]
    return read("part").select("p_partkey", *own, F.coalesce(F.when(size % 3 != 0, size), F.when(size % 2 == 0, 0), F.lit(-1)).alias("given"))


@query(f"WITH {CELLS}, u AS (SELECT 'MATR_b1c' || user_id || '.pkl' AS file FROM rs WHERE reason = '' UNION ALL SELECT 'MATR_b1c' || user_id || '.pkl' FROM rs WHERE reason = '' AND user_id % 3 = 0) SELECT file, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1")
def repeated_cells(read):
    """Usable cells of a name that comes twice."""
    used = cells.fixed_origin_records(cell_table(read), LOOKBACK, [5, 10, 40], 8).filter("status = 'used'").select("file")
    again = used.filter(F.regexp_extract("file", r"(\d+)\.pkl$", 1).cast("long") % 3 == 0)
    return ranking.duplicates(used.unionByName(again), "file")
