"""Registered queries of sources, sinks, splits of names, audits and searches, each with its DuckDB text.

What a sink writes goes to a folder of its own below the session's shared one, and is read back by the source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import sinks
from ..functions import labels, numbers
from ..operators import anomaly, audit, projections, ranking, rollup, sets, splits
from ..schemas import CELL_FILE
from ..session import application_folder
from ..sources import cells, results
from . import experiments, predict, reports, search
from .queries import BASE, FILES_SQL, LOOKBACK, PRED, REG, TRIALS, Z, by_model, part_files, predictions, query, trials


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- cell files ------------------------------------------------------------------------------------

CELLS = f"""ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, CAST(CAST(value AS FLOAT) AS DOUBLE) AS top FROM events),
ref AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 100 ELSE avg(top) FILTER (n <= 5 AND event_id % 17 <> 0) END AS reference FROM ev GROUP BY user_id),
cy AS (SELECT ev.*, event_id % 13 <> 0 AS has_feature, CASE WHEN event_id % 17 <> 0 AND top / reference > 0 AND top / reference < 1.5 THEN top / reference END AS soh FROM ev JOIN ref USING (user_id)),
er AS (SELECT user_id, {", ".join(f"string_agg('cycle ' || n || ': no {w}', '|' ORDER BY n) FILTER ({c} AND {c}_pl <= 5) AS {k}_errors" for k, w, c in (("feature", "feature", "no_f"), ("soh", "label", "no_l")))} FROM (SELECT user_id, n, no_f, no_l, sum(CAST(no_f AS INT)) OVER w AS no_f_pl, sum(CAST(no_l AS INT)) OVER w AS no_l_pl FROM (SELECT user_id, n, n <= {LOOKBACK} AND NOT has_feature AS no_f, soh IS NULL AS no_l FROM cy) WINDOW w AS (PARTITION BY user_id ORDER BY n)) GROUP BY user_id),
rec AS (SELECT user_id, count(*) AS n_cycles, count(*) FILTER (n <= {LOOKBACK} AND has_feature) AS n_features, max(CASE WHEN n = {LOOKBACK} THEN soh END) AS origin_soh, count(soh) FILTER (n - {LOOKBACK} IN (5, 10, 40)) AS n_targets FROM cy GROUP BY user_id),
rs AS (SELECT *, concat_ws('; ', CASE WHEN n_features < {LOOKBACK} THEN 'needs features of {LOOKBACK} cycles, has ' || n_features END, CASE WHEN origin_soh IS NULL THEN 'no label at cycle {LOOKBACK}' END, CASE WHEN n_targets = 0 THEN 'no label at any horizon' END) AS reason FROM rec)"""


def cell_table(read) -> DataFrame:
    """CELL_FILE rows out of events: a user is a cell, an event a cycle; some curves are too short, odd users give no nominal capacity.

    A row holds a whole file, as CELL_FILE does: bounded by what a cell file holds, not by the table.
    """
    e = read("events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts")))
    curve = lambda x, short: F.transform(F.sequence(F.lit(1), F.when(short, 3).otherwise(6)), lambda k: (x * k / 6).cast("float"))
    top = F.transform(F.sequence(F.lit(1), F.when(F.col("event_id") % 17 == 0, 3).otherwise(6)), lambda k: F.when(k == 2, F.col("value")).otherwise(F.col("value") / 2).cast("float"))
    short = F.col("event_id") % 13 == 0
    cycle = F.struct(F.col("n").alias("cycle_number"), curve(F.lit(4.0), short).alias("voltage_in_V"), curve(F.lit(-1.0), short).alias("current_in_A"), top.alias("discharge_capacity_in_Ah"))
    e = e.groupBy("user_id").agg(F.sort_array(F.collect_list(cycle)).alias("cycle_data"))
    name = F.concat(F.lit("MATR_b1c"), F.col("user_id").cast("string"))
    e = e.select(F.concat(name, F.lit(".pkl")).alias("file"), name.alias("cell_id"), F.when(F.col("user_id") % 2 == 0, 100.0).alias("nominal_capacity_in_Ah"), "cycle_data")
    return e.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CELL_FILE))


def _records(read) -> DataFrame:
    return cells.fixed_origin_records(cell_table(read), LOOKBACK, [5, 10, 40], 8)


@query(f"WITH {CELLS} SELECT 'MATR_b1c' || user_id || '.pkl' AS file, n_cycles, n_features, round(origin_soh, 6) AS origin_soh, n_targets, reason, CASE WHEN reason = '' THEN 'used' ELSE 'skipped' END AS status, coalesce(feature_errors, '') AS feature_errors, coalesce(soh_errors, '') AS soh_errors FROM rs LEFT JOIN er USING (user_id)")
def fixed_origin_records(read):
    r = _records(read)
    return r.select("file", "n_cycles", "n_features", "origin_soh", F.size("targets").alias("n_targets"), "reason", "status", *(F.array_join(c, "|").alias(c) for c in ("feature_errors", "soh_errors")))


@query(f"WITH {CELLS} SELECT n - {LOOKBACK} AS horizon, count(*) AS n FROM cy JOIN rs USING (user_id) WHERE reason = '' AND soh IS NOT NULL AND n - {LOOKBACK} IN (5, 10, 40) GROUP BY 1")
def horizon_counts(read):
    return cells.manifest_counts(_records(read))


@query("SELECT 'MATR_b1c' || user_id || '.pkl' AS file, 'MATR_b1c' || user_id AS cell_id, 'MATR' AS dataset, count(*) AS n_cycles, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 6) AS total FROM events GROUP BY user_id")
def cell_files(read):
    """Written by dataset and read back."""
    table = cell_table(read)
    path = _new_path(table.sparkSession, "cells")
    cells.write_cells(table, path)
    back = cells.read_cells(table.sparkSession, path)
    top = F.aggregate("cycle_data", F.lit(0.0), lambda a, c: a + F.array_max(c["discharge_capacity_in_Ah"]).cast("double"))
    return back.select("file", "cell_id", labels.dataset(F.col("file")).alias("dataset"), F.size("cycle_data").alias("n_cycles"), top.alias("total"))


# --- tables in files -------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(read):
    c = read("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = _new_path(c.sparkSession, "csv")
    sinks.write_csv(c, path)
    return results.read_csv(c.sparkSession, path, c.schema)


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name, NULL AS region FROM region UNION ALL SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) FROM nation")
def union_csv(read):
    """One file of two tables' rows under the union of their columns."""
    a, b = read("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), read("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    path = _new_path(a.sparkSession, "union")
    sinks.write_union_csv([a, b], path)
    return results.read_csv(a.sparkSession, path, "key long, name string, region string")


@query("SELECT p_partkey, p_brand, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS price FROM part")
def json_lines(read):
    """Appended in two goes; NaN becomes null."""
    p = read("part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 4 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("price"))
    path = _new_path(p.sparkSession, "lines")
    for half in (0, 1):
        sinks.append_json_lines(p.filter(F.col("p_partkey") % 2 == half), path)
    return p.sparkSession.read.schema(p.schema).json(path)


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS pl FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE pl = 1")
def latest_facts(read):
    """Facts appended in two goes; of each key the last counts."""
    o = read("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    path = _new_path(o.sparkSession, "facts")
    for half in (0, 1):
        sinks.append_facts(o.filter(F.col("o_orderkey") % 2 == half), path)
    return results.keep_last(o.sparkSession.read.parquet(path), "o_custkey", "o_orderkey")


@query("SELECT 'n_' || n_nationkey AS file, n_name AS dataset FROM nation WHERE n_name IS NOT NULL")
def manifest_document(read):
    """A manifest of the nations as one JSON document, made by an aggregate and read back as rows."""
    n = read("nation").select(F.concat(F.lit("n_"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_name").alias("dataset"))
    path = _new_path(n.sparkSession, "manifest")
    sinks.json_document(n, "file").write.text(path)
    return results.read_manifest(n.sparkSession, path)


@query("SELECT s_suppkey::VARCHAR AS key, s_name AS name FROM supplier")
def keyed_strings(read):
    """Files as text by key, of which some come twice: the last line counts."""
    s = read("supplier").select(F.col("s_suppkey").alias("model"), F.col("s_name").alias("name"))
    path = _new_path(s.sparkSession, "keyed")
    old = s.filter("model % 3 = 0").withColumn("name", F.lit("old"))
    lines = old.withColumn("k", F.lit(0)).unionByName(s.withColumn("k", F.lit(1)))
    sinks.write_csv(lines.repartitionByRange(4, "k", "model").sortWithinPartitions("k", "model").drop("k"), path)
    return results.keyed_rows(s.sparkSession, path, ["model", "name"]).withColumnRenamed("model", "key")


@query(f"WITH {TRIALS}, h AS (SELECT model, horizon FROM trials GROUP BY ALL HAVING count(DISTINCT seed) >= 5) SELECT horizon FROM h WHERE model IN (0, 3, 5) GROUP BY horizon HAVING count(*) = 3")
def completed_keys(read):
    t = trials(read).groupBy("model", "horizon").agg(F.count_distinct("seed").alias("n")).filter("n >= 5")
    return results.completed(t.withColumn("model", F.col("model").cast("string")), ["horizon"], ["0", "3", "5"])


@query(f"WITH {BASE} SELECT horizon, model, CASE WHEN horizon % 2 = 0 THEN 'gap-' || horizon END AS split FROM m")
def sidecar_info(read):
    """Metric rows with what stands beside them, where anything does."""
    rows = by_model(read).withColumn("folder", F.col("horizon").cast("string"))
    info = rows.select("folder").distinct().filter(F.col("folder").cast("int") % 2 == 0).withColumn("info", F.struct(F.concat(F.lit("gap-"), "folder").alias("split")))
    return results.with_sidecars(rows, info).select("horizon", "model", F.col("info.split").alias("split"))


@query("SELECT 'acctbal' AS channel, count(*) AS n, round(avg(s_acctbal), 6) AS mean, round(stddev_pop(s_acctbal) + 1e-8, 6) AS std, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS n_keys FROM supplier WHERE s_suppkey % 3 = 0")
def normaliser_files(read):
    """Constants written beside the keys that they were fitted on."""
    from ..operators import normalize

    s = read("supplier").filter("s_suppkey % 3 = 0").select("s_suppkey", F.array("s_acctbal").alias("acctbal"))
    path = _new_path(s.sparkSession, "normaliser")
    sinks.write_normaliser(normalize.fit_channels(s, {"acctbal": "acctbal"}), s.select("s_suppkey"), path)
    fitted, keys = sinks.read_normaliser(s.sparkSession, path)
    return fitted.withColumn("n", F.col("n").cast("long")).crossJoin(F.broadcast(keys.agg(F.count("*").alias("n_keys"))))  # one row


# --- splits of names -------------------------------------------------------------------------------


def _nations(read) -> DataFrame:
    """(file, region): nations and their regions."""
    return read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("file"), F.col("r_name").alias("region"))


def _split_counts(read, assignment: DataFrame) -> DataFrame:
    rows = read("nation").select(F.col("n_name").alias("file"), "n_regionkey")
    return rows.join(assignment.select("file", "split"), "file").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"), F.count_distinct("n_regionkey").alias("n_regions"))


def _sizes_sql(share: float) -> str:
    k = f"greatest(1, CAST(round_even(n * {share}, 0) AS BIGINT))"
    return f"SELECT unnest(['train', 'val', 'test']) AS split, unnest([n - 2 * {k}, {k}, {k}]) AS n"


@query(f"WITH c AS (SELECT count(*) AS n FROM nation) SELECT split, n, n AS n_files FROM ({_sizes_sql(0.15)} FROM c)")
def file_split(read):
    return _split_counts(read, splits.random_split(_nations(read), "file", 42)).drop("n_regions")


@query(f"WITH c AS (SELECT count(*) AS n FROM nation) SELECT split, n, n AS n_files FROM ({_sizes_sql(0.2)} FROM c)")
def battery_split(read):
    return _split_counts(read, splits.battery_split(_nations(read), "file", 42)).drop("n_regions")


@query(f"WITH c AS (SELECT count(DISTINCT n_regionkey) AS n FROM nation), e AS (SELECT count(*) / count(DISTINCT n_regionkey) AS each FROM nation) SELECT split, CAST(n * each AS BIGINT) AS n, CAST(n * each AS BIGINT) AS n_files, n AS n_regions FROM ({_sizes_sql(0.15)} FROM c), e")
def condition_split(read):
    """Regions go whole, and all have equally many nations."""
    return _split_counts(read, splits.group_split(_nations(read), "file", "region", 42))


@query("WITH c AS (SELECT count(*) AS n, count(*) FILTER (r_name = 'ASIA') AS own, count(DISTINCT n_regionkey) AS r FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT unnest(['train', 'val', 'test']) AS split, unnest([n - own, own // 2, own - own // 2]) AS n, unnest([n - own, own // 2, own - own // 2]) AS n_files, unnest([r - 1, 1, 1]) AS n_regions FROM c")
def domain_split(read):
    return _split_counts(read, splits.domain_split(_nations(read), "file", "region", 42, "asia"))


@query("SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN 'a' ELSE 'b' END AS part FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)")
def subset_and_concatenate(read):
    c = read("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    own = lambda region, name: sets.used(c, read("nation").filter(F.col("n_regionkey") == region).select("n_nationkey"), ["n_nationkey"]).withColumn("part", F.lit(name))
    return sets.union_all(own(1, "a"), own(3, "b")).drop("n_nationkey")


@query("SELECT CASE WHEN doc_id % 10 < 6 THEN 'train' ELSE 'test' END AS split, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1")
def labels_by_split(read):
    d = read("documents").withColumn("split", F.when(F.col("doc_id") % 10 < 6, "train").otherwise("test"))
    return splits.labels_by_split(d, "lang", "source").select("split", F.array_join("langs", ",").alias("langs"), F.array_join("sources", ",").alias("sources"))


# --- audits ----------------------------------------------------------------------------------------

HEADER = "h AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'test_' WHEN 1 THEN 'val_' ELSE 'latest-' END || CASE p_size % 5 WHEN 0 THEN 'MAE' WHEN 1 THEN 'n_samples' WHEN 2 THEN 'R2_score' WHEN 3 THEN 'Skill' ELSE 'cycle' END AS name FROM part)"


def headers(read) -> DataFrame:
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_size") % n + 1).cast("int"))
    return read("part").select("p_partkey", F.concat(pick(3, "test_", "val_", "latest-"), pick(5, "MAE", "n_samples", "R2_score", "Skill", "cycle")).alias("column"))


@query(f"WITH {HEADER} SELECT p_partkey, name AS column FROM h WHERE contains(lower(name), 'test') AND regexp_matches(lower(name), 'mae|rmse|mape|r2|skill|metric')")
def test_metric_headers(read):
    return audit.test_metric_columns(headers(read))


@query(f"""WITH {FILES_SQL}, {HEADER}, {TRIALS},
b AS (SELECT 'one dataset' AS c, name AS x FROM s WHERE NOT starts_with(name, 'MATR') UNION ALL
SELECT 'splits are disjoint', run || '/' || k FROM (SELECT o_orderkey % 5 AS run, o_custkey AS k FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1) UNION ALL
SELECT 'normalisers are fitted on train', name FROM (SELECT DISTINCT s_nationkey::VARCHAR AS name FROM supplier WHERE s_nationkey % 6 = 5) UNION ALL
SELECT 'normaliser keys are train''s alone', s_nationkey || '/' || (s_suppkey % 50) FROM supplier GROUP BY s_nationkey, s_suppkey % 50 HAVING count(*) FILTER (s_acctbal >= 0) > 0 AND count(*) FILTER (s_acctbal < 0) > 0 UNION ALL
SELECT 'no test field is selected', 'test_' || n_name FROM nation WHERE n_nationkey % 9 = 0 UNION ALL
SELECT 'no test metric in headers', name FROM h WHERE contains(lower(name), 'test') AND regexp_matches(lower(name), 'mae|rmse|mape|r2|skill|metric') UNION ALL
SELECT 'baseline at every horizon', CAST(w.h AS VARCHAR) FROM (VALUES (1990), (1995), (1996)) w(h) WHERE w.h NOT IN (SELECT horizon FROM trials WHERE model = 0)),
vn AS (SELECT c, count(*) AS violations FROM b GROUP BY c), vf AS (SELECT c, string_agg(x, ', ' ORDER BY x) AS examples FROM (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY x) AS pl FROM b) WHERE pl <= 3 GROUP BY c)
SELECT q.c AS "check", coalesce(violations, 0) AS violations, coalesce(examples, '') AS examples FROM (SELECT unnest(['one dataset', 'splits are disjoint', 'normalisers are fitted on train', 'normaliser keys are train''s alone', 'test_metrics_used is false', 'no test field is selected', 'no test metric in headers', 'baseline at every horizon']) AS c) q LEFT JOIN vn ON vn.c = q.c LEFT JOIN vf ON vf.c = q.c""")
def output_validation(read):
    """Every check of a validation run over tables that break all but one."""
    o = read("orders").select((F.col("o_orderkey") % 5).alias("run"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("split"))
    s = read("supplier").select(F.col("s_nationkey").cast("string").alias("name"), F.when(F.col("s_nationkey") % 6 == 5, "val").otherwise("train").alias("fitted_split"), (F.col("s_suppkey") % 50).alias("key"), F.when(F.col("s_acctbal") < 0, "test").otherwise("train").alias("split"))
    n = read("nation").select(F.concat(F.when(F.col("n_nationkey") % 9 == 0, "test_").otherwise("own_"), "n_name").alias("key"), F.lit("1").alias("value"))
    chosen = n.union(n.sparkSession.createDataFrame([(audit.HONEST, "false")], n.schema))
    t = trials(read).select(F.when(F.col("model") == 0, "persistence").otherwise("other").alias("model"), "horizon")
    return audit.validate_outputs(part_files(read), "MATR", o, s, chosen, headers(read), t, [1990, 1995, 1996])


@query("SELECT n.c_nationkey::BIGINT AS c_nationkey, w.seg AS c_mktsegment FROM (SELECT DISTINCT c_nationkey FROM customer) n, (SELECT unnest(['BUILDING', 'AUTOMOBILE', 'NONE']) AS seg) w WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.c_nationkey AND c.c_mktsegment = w.seg)")
def groups_without_rows(read):
    return audit.without_rows(read("customer"), ("c_nationkey",), "c_mktsegment", ("BUILDING", "AUTOMOBILE", "NONE"))


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) % 4 <> 1")
def dishonest_configs(read):
    """Configurations as JSON: the flag is false, true, null or missing by k."""
    k = F.from_json("props", "k long")["k"] % 4
    text = F.when(k == 1, '{"test_metrics_used": false}').when(k == 2, '{"test_metrics_used": true}').when(k == 3, '{"test_metrics_used": null}').otherwise("{}")
    return audit.dishonest(read("events").select("event_id", F.from_json(text, "test_metrics_used boolean")["test_metrics_used"].alias("test_metrics_used"))).select("event_id")


# --- rows, roll-ups, searches ----------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, c_mktsegment, CASE WHEN o_orderkey % 3 = 0 THEN 'given' WHEN c_custkey % 2 = 0 THEN 'runs/' || o_custkey END AS path FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def enriched_rows(read):
    """Rows with the columns of their plan row, and a missing path filled in where such a file exists."""
    o = read("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "given").alias("path"))
    met = projections.enriched(o, read("customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"])
    files = read("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("runs/"), F.col("c_custkey").cast("string")).alias("path"))
    return projections.filled_path(met, "path", files, F.concat(F.lit("runs/"), F.col("c_custkey").cast("string"))).drop("c_custkey")


NUMBER_TEXT = "CASE p_size % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'NaN' WHEN 3 THEN '' ELSE CAST(p_retailprice AS VARCHAR) END"


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN p_retailprice END AS number, CASE WHEN p_size % 5 = 4 THEN p_retailprice ELSE 1e300 END AS low, CASE WHEN p_size % 5 = 4 THEN p_retailprice ELSE -1e300 END AS high FROM part")
def number_guards(read):
    """Numbers out of text; sort keys that put what is none last (infinities shown as 1e300)."""
    text = F.element_at(F.array(F.lit("n/a"), F.lit("Infinity"), F.lit("NaN"), F.lit(""), F.col("p_retailprice").cast("string")), (F.col("p_size") % 5 + 1).cast("int"))
    x = numbers.number(text)
    shown = lambda c: F.greatest(F.least(c, F.lit(1e300)), F.lit(-1e300))
    return read("part").select("p_partkey", x.alias("number"), shown(numbers.or_inf(x)).alias("low"), shown(numbers.or_neg_inf(x)).alias("high"))


@query("SELECT o_orderpriority, o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 40")
def sorted_rows(read):
    """By the keys that the table has, NaN last whichever way."""
    o = read("orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 4 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("price"))
    return ranking.sorted_rows(o, ["price", "absent", "o_orderkey"], ("price", "absent")).limit(40).select("o_orderpriority", "o_orderkey")


@query("WITH c AS (SELECT s_nationkey, l_returnflag, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, l_returnflag) AS pl FROM c) SELECT s_nationkey::BIGINT AS s_nationkey, l_returnflag, n FROM r WHERE pl = 1")
def most_frequent(read):
    rows = read("lineitem").join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_returnflag")
    return rollup.most_frequent(rows, "l_returnflag", ("s_nationkey",))


@query("SELECT l_returnflag, round(avg(l_tax) FILTER (l_linenumber > 2), 6) AS tax, round(avg(l_discount) FILTER (l_quantity < 40), 6) AS discount FROM lineitem GROUP BY 1")
def finite_means(read):
    odd = read("lineitem").select("l_returnflag", F.when(F.col("l_linenumber") > 2, F.col("l_tax")).otherwise(float("nan")).alias("tax"), F.when(F.col("l_quantity") < 40, F.col("l_discount")).otherwise(float("inf")).alias("discount"))
    return rollup.finite_means(odd, ("l_returnflag",), "tax", "discount")


@query(f"WITH {TRIALS} SELECT horizon, stage, count(*) AS n_trials, count(DISTINCT seed) AS n_seed, round(avg(mae), 6) AS mae_mean, round(avg(rmse), 6) AS rmse_mean FROM trials GROUP BY ALL")
def means_with_counts(read):
    return rollup.with_counts(trials(read), ("horizon", "stage"), ("mae", "rmse"), "seed")


@query(f"WITH {PRED} SELECT cell_id, target_cycle, round(actual, 6) AS actual, round(actual + 0.5, 6) AS pred FROM pred WHERE cell_id % 3 = 0")
def external_predictions(read):
    """Predictions made elsewhere are joined by sample, never by place."""
    p = predictions(read).withColumn("sample_id", F.col("cell_id") * 1_000_000 + F.col("target_cycle"))
    elsewhere = p.filter("cell_id % 3 = 0").select("sample_id", (F.col("actual") + 0.5).alias("pred")).repartition(3)
    return predict.predict("cpmlp", p.drop("pred"), external=elsewhere).select("cell_id", "target_cycle", "actual", "pred")


@query(f"WITH {PRED}, e AS (SELECT cell_id % 4 AS seed, target_cycle % 2 AS horizon, actual, actual + cell_id % 5 / 10.0 AS pred FROM pred) SELECT seed, horizon, 'shifted' AS model, {REG} FROM e GROUP BY seed, horizon")
def predictor_evaluation(read):
    """A registered function on Arrow batches, evaluated for each (seed, horizon)."""

    def shift(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from table.append_column("pred", pc.add(table["actual"], table["off"])).to_batches()

    p = predictions(read).select((F.col("cell_id") % 4).alias("seed"), (F.col("target_cycle") % 2).alias("horizon"), "actual", (F.col("cell_id") % 5 / 10.0).cast("double").alias("off"))
    predict.register("shifted", shift, "seed long, horizon long, actual double, off double, pred double")
    return predict.evaluate("shifted", p.select(F.col("seed").cast("long").alias("seed"), F.col("horizon").cast("long").alias("horizon"), "actual", "off"))


@query(f"""WITH {PRED}, r AS (SELECT cell_id, target_cycle, abs(actual - pred) AS residual, coalesce(abs(actual - pred) - lag(abs(actual - pred)) OVER (PARTITION BY cell_id ORDER BY target_cycle), 0) AS slope, CASE WHEN target_cycle % 3 = 0 THEN NULL ELSE actual % 7 END AS latent FROM pred),
a AS (SELECT residual AS x FROM r WHERE cell_id % 2 = 0), b AS (SELECT slope AS x FROM r WHERE cell_id % 2 = 0), c AS (SELECT latent AS x FROM r WHERE cell_id % 2 = 0 AND latent IS NOT NULL), {Z.format(n='za', t='a')}, {Z.format(n='zb', t='b')}, {Z.format(n='zc', t='c')},
z AS (SELECT cell_id, target_cycle, greatest((residual - za.med) / (1.4826 * (za.mad + 1e-8)), 0) AS u, greatest((slope - zb.med) / (1.4826 * (zb.mad + 1e-8)), 0) AS v, CASE WHEN latent IS NOT NULL THEN greatest((latent - zc.med) / (1.4826 * (zc.mad + 1e-8)), 0) END AS w FROM r, za, zb, zc),
y AS (SELECT cell_id, target_cycle, CASE WHEN w IS NULL THEN (u + v) / 2 ELSE (u + v + w) / 3 END AS score FROM z), t AS (SELECT quantile_cont(score, 0.975) AS threshold FROM y WHERE cell_id % 2 = 0)
SELECT cell_id, target_cycle, round(score, 6) AS anomaly_score, score > threshold AS is_anomaly FROM y, t WHERE cell_id % 2 = 1""")
def latent_anomaly_flags(read):
    """With a third score that some rows lack."""
    p = predictions(read).withColumn("residual", F.abs(F.col("actual") - F.col("pred"))).withColumn("latent", F.when(F.col("target_cycle") % 3 != 0, F.col("actual") % 7))
    out = anomaly.anomaly_flags(p.filter("cell_id % 2 = 1"), p.filter("cell_id % 2 = 0"), latent="latent")
    return out.select("cell_id", "target_cycle", "anomaly_score", "is_anomaly")


STEPS = f"{TRIALS}, t AS (SELECT model, horizon, seed, avg(mae) AS e, avg(rmse) - avg(mae) AS g FROM trials GROUP BY ALL), q AS (SELECT model, horizon, seed, avg(e) OVER w AS m, coalesce(stddev_samp(e) OVER w, 0) AS s, avg(g) OVER w AS g FROM t WINDOW w AS (PARTITION BY model, horizon ORDER BY seed ROWS UNBOUNDED PRECEDING)), sc AS (SELECT model, horizon, seed, m + 0.5 * s + CASE WHEN g < 0 THEN 2.0 * abs(g) ELSE 0 END AS score FROM q)"


def scored_steps(read) -> DataFrame:
    t = trials(read).groupBy("model", "horizon", "seed").agg(F.avg("mae").alias("e"), (F.avg("rmse") - F.avg("mae")).alias("g"))
    t = t.withColumn("trial", F.concat_ws("/", F.col("model").cast("string"), F.col("horizon").cast("string")))
    return search.running_scores(t, "trial", "seed", "e", "g", 0.5, 2.0)


@query(f"WITH {STEPS} SELECT model, horizon, seed::BIGINT AS seed, round(score, 6) AS running_score FROM sc")
def running_scores(read):
    return scored_steps(read).select("model", "horizon", "seed", "running_score")


@query(f"WITH {STEPS}, l AS (SELECT * FROM sc WHERE seed = 7), r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY score, model) AS pl FROM l WHERE model <> 6) SELECT horizon, model, round(score, 6) AS score FROM r WHERE pl = 1")
def best_completed_trial(read):
    """Trials of one model count as pruned."""
    last = scored_steps(read).filter("seed = 7").select("horizon", F.col("model").alias("number"), F.col("running_score").alias("score"), F.when(F.col("model") == 6, "pruned").otherwise("complete").alias("state"))
    return search.best_completed(last, ("horizon",)).select("horizon", F.col("number").alias("model"), "score")


# --- texts -----------------------------------------------------------------------------------------


@query("SELECT '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || replace(r_name, 'A', '\\|') || ' |' || chr(10), '' ORDER BY r_regionkey) AS text FROM region")
def markdown_report(read):
    rows = read("region").select("r_regionkey", F.replace("r_name", F.lit("A"), F.lit("|")).alias("r_name"))
    lines = sinks.markdown_lines(rows, ["r_regionkey", "absent", "r_name"], [F.col("r_regionkey")])
    return _joined(lines)


def _joined(lines) -> DataFrame:
    """(text): the lines of a small report as one text."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda r: F.concat(r["line"], F.lit("\n")))
    return lines.agg(F.array_join(ordered, "").alias("text"))


@query("SELECT string_agg('python run.py --split-mode file-level --models ' || CASE WHEN n_name LIKE '% %' THEN '''' || n_name || '''' ELSE n_name END || ' --seed ' || n_nationkey || ' --lr 0.001 --zero-output-init' || chr(10), '' ORDER BY n_nationkey) AS text FROM nation")
def trial_commands(read):
    plan = read("nation").select(F.lit("file-level").alias("mode"), F.col("n_name").alias("model"), F.col("n_nationkey").alias("seed"), F.lit("0.001").alias("lr"), F.lit(True).alias("zero"), F.lit(None).cast("string").alias("absent"))
    return _joined(reports.command_lines(plan, ["python", "run.py"], {"split_mode": "mode", "eval_domain": "absent", "models": "model", "seed": "seed", "lr": "lr", "zero_output_init": "zero"}, [F.col("seed")]))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'failed' ELSE 'done' END AS status FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def resumed_trials(read):
    """A plan of all nations of which some are completed; trials of some fail, and the others go on."""

    def trial(row: dict) -> dict:
        if row["n_nationkey"] % 5 == 0:
            raise RuntimeError("fails")
        return {}

    done = read("region").select(F.col("r_regionkey").alias("n_nationkey"))
    return experiments.run_on_executors(read("nation").select("n_nationkey"), done, ["n_nationkey"], trial, "error double").select("n_nationkey", "status")
