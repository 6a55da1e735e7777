"""The registered queries over the test tables, each with its DuckDB text.

Sequences come from `events`: a user is a device, the events in time order are its cycles, the value is
the measured quantity. Doubles are rounded to six places and whole numbers are 64-bit on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import sinks
from ..functions import arrays, labels, numbers
from ..operators import anomaly, audit, isolation, metrics, normalize, projections, ranking, rollup, selection, sets, splits, windows
from ..sources import cells
from . import experiments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LOOKBACK, HORIZON, EOL_VALUE, GAP = 20, 10, 20.0, 5


def query(sql: str | None):
    """Register the function under its name, with the SQL of the same result where SQL can express it."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return run

    return add


def tidy(df: DataFrame) -> DataFrame:
    as_is = {"int": "long", "smallint": "long", "tinyint": "long"}
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c).cast(as_is[t]).alias(c) if t in as_is else F.col(c) for c, t in df.dtypes))


def sequence(read) -> DataFrame:
    """(file, cell_id, ord, cycle_number, soh, kind): one row per event, numbered in its user's time order."""
    e = read("events").select(F.col("user_id").alias("file"), "ts", F.col("value").alias("soh"), F.col("event_type").alias("kind"))
    e = e.withColumn("ord", F.row_number().over(W.partitionBy("file").orderBy("ts")))
    return e.select("file", F.col("file").alias("cell_id"), "ord", F.col("ord").alias("cycle_number"), "soh", "kind")


def gapped(read) -> DataFrame:
    """The sequences without every seventh cycle: cycle numbers keep their gaps, places do not."""
    kept = sequence(read).filter(F.col("cycle_number") % 7 != F.col("file") % 7)
    return kept.withColumn("ord", F.row_number().over(W.partitionBy("file").orderBy("cycle_number")))


def predictions(read, horizon: int = HORIZON) -> DataFrame:
    """(cell_id, target_cycle, input_end_cycle, actual, pred, baseline, kind, cohort) of the persistence baseline."""
    p = windows.persistence(sequence(read), LOOKBACK, horizon)
    return p.select("cell_id", "target_cycle", "input_end_cycle", F.col("target").alias("actual"), "pred", "baseline", "kind", (F.col("cell_id") % 5).alias("cohort"))


# Common table expressions of the SQL texts.
SEQ = "seq AS (SELECT user_id AS file, user_id AS cell_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS cycle_number, value AS soh, event_type AS kind FROM events)"
SAMPLES = f"""{SEQ}, win AS (SELECT *, lag(cycle_number, {LOOKBACK - 1}) OVER w AS input_start_cycle, cycle_number AS input_end_cycle, lead(cycle_number, {HORIZON}) OVER w AS target_cycle,
 lead(soh, {HORIZON}) OVER w AS target, row_number() OVER w AS place FROM seq WINDOW w AS (PARTITION BY file ORDER BY cycle_number)),
samples AS (SELECT * FROM win WHERE place >= {LOOKBACK} AND target IS NOT NULL)"""
PRED = f"{SAMPLES}, pred AS (SELECT cell_id, target_cycle, input_end_cycle, target AS actual, soh AS pred, soh AS baseline, kind, cell_id % 5 AS cohort FROM samples)"
MAPE = "avg(abs(pred - actual) / greatest(abs(actual), 1e-8)) * 100"
TRIALS = """trials AS (SELECT l_suppkey % 8 AS model, l_linenumber AS seed, CAST(year(l_shipdate) AS BIGINT) AS horizon, l_linestatus AS stage, l_discount AS mae, l_tax AS rmse, l_quantity AS mape FROM lineitem)"""


def trials(read) -> DataFrame:
    """Experiment rows out of lineitem: model, seed, horizon, stage and three metrics."""
    return read("lineitem").select((F.col("l_suppkey") % 8).alias("model"), F.col("l_linenumber").alias("seed"), F.year("l_shipdate").cast("long").alias("horizon"), F.col("l_linestatus").alias("stage"), F.col("l_discount").alias("mae"), F.col("l_tax").alias("rmse"), F.col("l_quantity").alias("mape"))


# --- windows and baselines -------------------------------------------------------------------------


@query(f"WITH {SAMPLES} SELECT file, input_end_cycle, round(target, 6) AS target FROM samples")
def sliding_window_samples(read):
    return windows.sliding_samples(sequence(read), LOOKBACK, HORIZON).select("file", "input_end_cycle", "target")


@query(f"WITH {SAMPLES} SELECT file, input_start_cycle, input_end_cycle, target_cycle FROM samples")
def window_bounds(read):
    return windows.sliding_samples(sequence(read), LOOKBACK, HORIZON).select("file", "input_start_cycle", "input_end_cycle", "target_cycle")


@query(f"""WITH {SEQ}, h AS (SELECT file, cycle_number, list(soh ORDER BY cycle_number) OVER (PARTITION BY file ORDER BY cycle_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hist, lead(soh, 2) OVER (PARTITION BY file ORDER BY cycle_number) AS nxt FROM seq)
SELECT file, cycle_number AS input_end_cycle, CAST(len(hist) AS BIGINT) AS n, round(hist[1], 6) AS oldest, round(hist[5], 6) AS latest, round(list_sum(hist), 6) AS total FROM h WHERE len(hist) = 5 AND nxt IS NOT NULL""")
def history_array(read):
    s = windows.sliding_samples(sequence(read), 5, 2, history=("soh",))
    h = F.col("history_soh")
    return s.select("file", "input_end_cycle", F.size(h).alias("n"), h[0].alias("oldest"), h[4].alias("latest"), F.aggregate(h, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""WITH {SEQ} SELECT a.file, h.horizon, a.cycle_number + h.horizon AS target_cycle, round(a.soh, 6) AS current, round(b.soh, 6) AS target
FROM seq a CROSS JOIN (VALUES (CAST(5 AS BIGINT)), (10), (40)) h(horizon) JOIN seq b ON b.file = a.file AND b.cycle_number = a.cycle_number + h.horizon WHERE a.cycle_number = {LOOKBACK} AND a.cycle_number % 7 <> a.file % 7 AND b.cycle_number % 7 <> b.file % 7""")
def fixed_origin_horizon(read):
    """Every seventh cycle is missing, so that numbers and places differ."""
    s = gapped(read)
    horizons = s.sparkSession.createDataFrame([(5,), (10,), (40,)], "horizon int")
    return windows.fixed_origin_samples(s, LOOKBACK, horizons)


@query(f"""WITH {SEQ} SELECT CAST(b.cycle_number - {LOOKBACK} AS BIGINT) AS horizon, count(*) AS n, round(avg(abs(b.soh - a.soh)), 6) AS mae FROM seq a JOIN seq b ON a.file = b.file AND b.cycle_number IN (30, 40) WHERE a.cycle_number = {LOOKBACK} AND a.cycle_number % 7 <> a.file % 7 AND b.cycle_number % 7 <> b.file % 7 GROUP BY 1""")
def fixed_origin_persistence(read):
    s = gapped(read)
    horizons = s.sparkSession.createDataFrame([(10,), (20,)], "horizon int")
    p = windows.fixed_origin_persistence(windows.fixed_origin_samples(s, LOOKBACK, horizons))
    return metrics.regression_metrics(p, ("horizon",), "target", "pred").select("horizon", "n", F.col("MAE").alias("mae"))


@query(f"WITH {SEQ} SELECT file, cycle_number, round(lag(soh) OVER (PARTITION BY file ORDER BY cycle_number), 6) AS previous FROM seq")
def previous_value(read):
    return windows.previous_value(sequence(read)).select("file", "cycle_number", "previous")


@query(f"WITH {SEQ}, l AS (SELECT *, lag(soh) OVER (PARTITION BY file ORDER BY cycle_number) AS pred FROM seq) SELECT file, cycle_number AS target_cycle, round(soh, 6) AS target, round(pred, 6) AS pred FROM l WHERE cycle_number >= 3")
def persistence_h0(read):
    return windows.persistence(sequence(read), 3, 0).select("file", "target_cycle", "target", "pred")


@query(f"WITH {SAMPLES} SELECT file, target_cycle, round(target, 6) AS target, round(soh, 6) AS pred FROM samples")
def persistence_h10(read):
    return windows.persistence(sequence(read), LOOKBACK, HORIZON).select("file", "target_cycle", "target", "pred")


@query(f"WITH {SAMPLES} SELECT file, input_end_cycle, round(soh, 6) AS baseline FROM samples")
def baseline_soh(read):
    return windows.persistence(sequence(read), LOOKBACK, HORIZON).select("file", "input_end_cycle", "baseline")


@query(f"WITH {SEQ} SELECT file, cycle_number, round(coalesce(soh - lag(soh) OVER (PARTITION BY file ORDER BY cycle_number), 0), 6) AS slope FROM seq")
def slope_score(read):
    return windows.slope(sequence(read), "file", "cycle_number", "soh").select("file", "cycle_number", "slope")


@query(f"WITH {SEQ} SELECT cell_id, min(CASE WHEN soh <= {EOL_VALUE} THEN cycle_number END) AS crossing FROM seq WHERE cycle_number % 7 <> file % 7 GROUP BY cell_id")
def first_crossing(read):
    return windows.first_crossing(gapped(read), EOL_VALUE, "soh", cycle="cycle_number")


# --- targets and scores ----------------------------------------------------------------------------


@query(f"WITH {PRED} SELECT cell_id, target_cycle, round((actual - baseline) * 100, 6) AS target, round(actual, 6) AS restored, round(actual * 2, 6) AS absolute FROM pred")
def delta_absolute_roundtrip(read):
    p, a, b = predictions(read), F.col("actual"), F.col("baseline")
    target = numbers.delta_target(a, b, "delta", 100.0)
    return p.select("cell_id", "target_cycle", target.alias("target"), numbers.delta_restore(target, b, "delta", 100.0).alias("restored"), numbers.delta_target(a, b, "absolute", 2.0).alias("absolute"))


@query(f"WITH {PRED} SELECT cell_id, target_cycle, round((baseline - actual) * 10, 6) AS target, round(actual, 6) AS restored FROM pred")
def delta_current_minus_target(read):
    p, a, b = predictions(read), F.col("actual"), F.col("baseline")
    target = numbers.loss_target(b, a, 10.0)
    return p.select("cell_id", "target_cycle", target.alias("target"), numbers.loss_restore(target, b, 10.0).alias("restored"))


@query(f"""WITH {PRED}, m AS (SELECT cohort, avg(abs(pred - actual)) AS mae, avg(abs(actual)) AS base FROM pred GROUP BY cohort)
SELECT cohort, round(base - mae, 6) AS gain, round((base - mae) / nullif(base, 0) * 100, 6) AS gain_percent, round(1 - mae / base, 6) AS skill FROM m""")
def improvement_skill(read):
    m = predictions(read).groupBy("cohort").agg(F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae"), F.avg(F.abs("actual")).alias("base"))
    b, x = F.col("base"), F.col("mae")
    return m.select("cohort", numbers.improvement(b, x).alias("gain"), numbers.improvement_percent(b, x).alias("gain_percent"), numbers.skill(x, b).alias("skill"))


@query(f"""WITH {TRIALS}, s AS (SELECT model, avg(mae) AS m, stddev_samp(mae) AS s, avg(rmse) AS r, avg(mape) AS p FROM trials GROUP BY model)
SELECT model, round(m + 0.5 * s + CASE WHEN m - r < 0 THEN 2.0 * abs(m - r) ELSE 0 END, 6) AS score, round(0.5 * m + 0.3 * r + 0.2 * p, 6) AS weighted FROM s""")
def composite_score(read):
    s = trials(read).groupBy("model").agg(F.avg("mae").alias("m"), F.stddev_samp("mae").alias("s"), F.avg("rmse").alias("r"), F.avg("mape").alias("p"))
    return s.select("model", numbers.spread_score(F.col("m"), F.col("s"), 0.5, F.col("m") - F.col("r"), 2.0).alias("score"), numbers.weighted_score({"m": 0.5, "r": 0.3, "p": 0.2}).alias("weighted"))


@query(f"""WITH {SEQ} SELECT CASE WHEN soh / 500 >= 0.9 THEN 'early_ge_0.90' WHEN soh / 500 >= 0.8 THEN 'mid_0.80_0.90' ELSE 'late_lt_0.80' END AS band, count(*) AS n FROM seq GROUP BY 1""")
def soh_bands(read):
    return sequence(read).groupBy(numbers.soh_band(F.col("soh") / 500).alias("band")).agg(F.count("*").alias("n"))


# --- splits ----------------------------------------------------------------------------------------

COUNTS = "greatest(1, CAST(round_even((n - 2 * {g}) * 0.15, 0) AS BIGINT))"


def _counts_sql(gap: int) -> str:
    k = COUNTS.format(g=gap)
    left = f"(n - 2 * {gap})"
    return f"CASE WHEN {left} >= 3 THEN CASE WHEN {left} - 2 * {k} < 1 THEN 1 ELSE {left} - 2 * {k} END END AS n_train, CASE WHEN {left} >= 3 THEN CASE WHEN {left} - 2 * {k} < 1 THEN 1 ELSE {k} END END AS n_val, CASE WHEN {left} >= 3 THEN CASE WHEN {left} - 2 * {k} < 1 THEN {left} - 2 ELSE {k} END END AS n_test"


def _segments_sql(gap: int) -> str:
    return f"""{SAMPLES}, c AS (SELECT file, target_cycle, row_number() OVER (PARTITION BY file ORDER BY target_cycle, input_end_cycle) AS pl, count(*) OVER (PARTITION BY file) AS n FROM samples),
k AS (SELECT *, {_counts_sql(gap)} FROM c),
segments AS (SELECT file, target_cycle, CASE WHEN n_train IS NULL THEN NULL WHEN pl <= n_train THEN 'train' WHEN pl <= n_train + {gap} THEN 'gap_train_val' WHEN pl <= n_train + {gap} + n_val THEN 'val' WHEN pl <= n_train + 2 * {gap} + n_val THEN 'gap_val_test' ELSE 'test' END AS segment FROM k)"""


@query(f"WITH t AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT l_partkey, n, {_counts_sql(0)} FROM t), b AS (SELECT l_partkey, {_counts_sql(GAP)} FROM t) SELECT l_partkey, a.n, a.n_train, a.n_val, a.n_test, b.n_train AS gap_train, b.n_val AS gap_val, b.n_test AS gap_test FROM a JOIN b USING (l_partkey)")
def chrono_split_counts(read):
    """Sizes for the line items of every part."""
    n = read("lineitem").groupBy("l_partkey").agg(F.count("*").cast("int").alias("n"))
    plain, gapped = splits.counts(F.col("n")), splits.counts(F.col("n"), gap=GAP)
    return n.select("l_partkey", "n", *(c.alias(f"n_{s}") for c, s in zip(plain, splits.SPLITS, strict=True)), *(c.alias(f"gap_{s}") for c, s in zip(gapped, splits.SPLITS, strict=True)))


def _samples(read):
    return windows.sliding_samples(sequence(read), LOOKBACK, HORIZON)


@query(f"WITH {_segments_sql(0)} SELECT * FROM segments")
def chrono_split_assign(read):
    return splits.chronological(_samples(read)).select("file", "target_cycle", "segment")


@query(f"WITH {_segments_sql(GAP)} SELECT * FROM segments")
def gap_split_assign(read):
    return splits.chronological(_samples(read), gap=GAP).select("file", "target_cycle", "segment")


@query(f"WITH {_segments_sql(GAP)} SELECT file, segment, count(*) AS n, min(target_cycle) AS first_cycle, max(target_cycle) AS last_cycle FROM segments WHERE segment IS NOT NULL GROUP BY 1, 2")
def split_ranges(read):
    return splits.segment_ranges(splits.chronological(_samples(read), gap=GAP))


@query(f"""WITH {_segments_sql(18)} SELECT file, count(*) AS total_samples, CASE WHEN count(segment) > 0 THEN 'used' ELSE 'skipped' END AS status,
CASE WHEN count(segment) = 0 THEN 'needs 39 samples, has ' || count(*) END AS reason, count(*) FILTER (segment = 'train') AS train_samples, count(*) FILTER (segment = 'test') AS test_samples FROM segments GROUP BY file""")
def split_report(read):
    out = splits.split_report(splits.chronological(_samples(read), gap=18), 18)
    return out.select("file", "total_samples", "status", "reason", "train_samples", "test_samples")


@query(f"WITH {_segments_sql(GAP)} SELECT segment AS split, {HORIZON}::BIGINT AS horizon, count(*) AS n, count(DISTINCT file) AS n_files FROM segments WHERE segment IS NOT NULL GROUP BY 1")
def split_manifest(read):
    s = splits.chronological(_samples(read), gap=GAP).filter("segment is not null").select("file", F.col("segment").alias("split"), F.lit(HORIZON).alias("horizon"))
    return splits.manifest_sizes(s).withColumnRenamed("n_keys", "n_files")


@query("SELECT CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY 1")
def assigned_split(read):
    """A named assignment (ten names) joined onto the rows."""
    rows = read("documents").select((F.col("doc_id") % 10).cast("string").alias("file"))
    names = {str(k): "train" if k < 6 else "val" if k < 8 else "test" for k in range(10)}
    return splits.assign(rows, names).groupBy("split").agg(F.count("*").alias("n"))


# --- normalisation and array kernels ---------------------------------------------------------------

POINTS = "p AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v, len(embedding) AS n, embedding FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding))"


@query(f"WITH {POINTS} SELECT 'v' AS channel, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-8, 6) AS std FROM p")
def channel_norm_fit(read):
    e = read("embeddings").select("vec_id", F.col("embedding").alias("v"))
    return normalize.fit_channels(e, {"v": "v"}).select("channel", "mean", "std")


@query(f"WITH {POINTS}, s AS (SELECT avg(v) AS m, stddev_pop(v) + 1e-8 AS d FROM p) SELECT vec_id, round(sum((v - m) / d * i), 6) AS weighted FROM p, s GROUP BY vec_id")
def channel_norm_apply(read):
    e = read("embeddings").select("vec_id", F.col("embedding").alias("v"))
    out = normalize.apply_channels(e, normalize.fit_channels(e, {"v": "v"}), {"v": "v"})
    return out.select("vec_id", F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("weighted"))


@query(f"""WITH {SEQ}, w AS (SELECT e.file, c.soh FROM seq e JOIN seq c ON c.file = e.file AND c.cycle_number BETWEEN e.cycle_number - {LOOKBACK - 1} AND e.cycle_number
JOIN (SELECT file, max(cycle_number) AS n FROM seq GROUP BY file) m ON m.file = e.file WHERE e.cycle_number >= {LOOKBACK} AND e.cycle_number <= m.n - {HORIZON})
SELECT 'soh' AS channel, count(*) AS n, round(avg(soh), 6) AS mean, round(stddev_pop(soh) + 1e-8, 6) AS std FROM w""")
def channel_norm_windows(read):
    """A cycle counts once for each window that holds it, by weight and not by laying windows out."""
    s = sequence(read).withColumn("n", F.count("*").over(W.partitionBy("file")).cast("int"))
    s = s.select(F.array("soh").alias("soh"), normalize.multiplicity(F.col("ord"), F.col("n"), LOOKBACK, HORIZON).alias("times"))
    return normalize.fit_channels(s, {"soh": "soh"}, "times").withColumn("n", F.col("n").cast("long"))


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS place, round(CASE WHEN i = 1 THEN embedding[2]::DOUBLE - embedding[1]::DOUBLE WHEN i = len(embedding) THEN embedding[i]::DOUBLE - embedding[i - 1]::DOUBLE ELSE (embedding[i + 1]::DOUBLE - embedding[i - 1]::DOUBLE) / 2 END, 6) AS slope FROM embeddings, range(1, 65) r(i)")
def gradient(read):
    e = read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.posexplode(arrays.gradient(F.col("v"))).alias("place", "slope"))


@query("""WITH g AS (SELECT vec_id, k, k * 63 / 9.0 AS x, embedding FROM embeddings, range(0, 10) r(k)), f AS (SELECT *, least(CAST(floor(x) AS BIGINT), 62) AS lo FROM g)
SELECT vec_id, CAST(k AS BIGINT) AS place, round(embedding[lo + 1]::DOUBLE + (embedding[lo + 2]::DOUBLE - embedding[lo + 1]::DOUBLE) * (x - lo), 6) AS value FROM f""")
def resample_linear(read):
    return read("embeddings").select("vec_id", F.posexplode(arrays.resample_linear(F.col("embedding"), 10)).alias("place", "value"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def finite_filter(read):
    """Points at or below 0 are made infinite first, and so go."""
    holed = F.transform("embedding", lambda x: F.when(x > 0, x).otherwise(F.lit(float("inf")).cast("float")))
    kept = arrays.finite_points(holed)
    return read("embeddings").select("vec_id", F.size(kept).alias("n"), F.coalesce(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"))


@query("""WITH r AS (SELECT vec_id, label, list_max(embedding)::DOUBLE AS top, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings),
ref AS (SELECT label, avg(top) FILTER (place <= 5) AS reference FROM r GROUP BY label)
SELECT r.vec_id, round(reference, 6) AS reference, CASE WHEN top / reference > 0 AND top / reference < 1.5 THEN round(top / reference, 6) END AS soh FROM r JOIN ref ON r.label = ref.label""")
def reference_capacity(read):
    e = read("embeddings").withColumn("position", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    e = e.withColumn("reference", arrays.reference_capacity(F.lit(None), F.col("embedding"), F.col("position"), "label"))
    return e.select("vec_id", "reference", arrays.capacity_soh(F.col("embedding"), F.col("reference")).alias("soh"))


@query("""WITH g AS (SELECT vec_id, k, k * 63 / 4.0 AS x, embedding AS v, list_reverse(embedding) AS c FROM embeddings, range(0, 5) r(k)), f AS (SELECT *, least(CAST(floor(x) AS BIGINT), 62) AS lo FROM g),
d AS (SELECT *, list_transform(v, lambda y, i: CASE WHEN i = 1 THEN v[2]::DOUBLE - v[1]::DOUBLE WHEN i = 64 THEN v[64]::DOUBLE - v[63]::DOUBLE ELSE (v[i + 1]::DOUBLE - v[i - 1]::DOUBLE) / 2 END) AS dv FROM f)
SELECT vec_id, CAST(k AS BIGINT) AS place, round(v[lo + 1]::DOUBLE + (v[lo + 2]::DOUBLE - v[lo + 1]::DOUBLE) * (x - lo), 6) AS v, round(c[lo + 1]::DOUBLE + (c[lo + 2]::DOUBLE - c[lo + 1]::DOUBLE) * (x - lo), 6) AS i, round(dv[lo + 1] + (dv[lo + 2] - dv[lo + 1]) * (x - lo), 6) AS x FROM d""")
def feature_rows(read):
    e = read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    f = e.select("vec_id", arrays.features(F.col("v"), F.reverse("v"), 5).alias("f"))
    return f.select("vec_id", F.posexplode(F.arrays_zip("f.v", "f.i", "f.x")).alias("place", "p")).select("vec_id", "place", "p.*")


# --- labels ----------------------------------------------------------------------------------------

# Beginnings of the public datasets' file names, and others.
BEGINNINGS = (
    "CALB_0_B182", "CALCE_CX2", "HNEI_18650", "MICH_MCForm1", "MICH_1", "SNL_18650_LFP", "UL-PUR_N15", "HUST", "ISU-ILCC", "MATR", "NA-ion_27_3", "RWTH", "SDU_Battery", "Stanford_Nova_Regular_Ref",
    "Stanford_Nova_Regular", "Tongji1_CY25-05", "XJTU_2C", "ZN-coin_202", "foo", "bar_baz",
)
# Endings with the number in place of #, and the folder of each file.
ENDINGS = ("-#.pkl", "_#.pkl", "_a.pkl", "_1-#.pkl", "_b#c2.pkl", "_battery-#.pkl", "_#_Batch-2.pkl", "_x_#.pkl", "", "_#.tar.pkl")
_LISTS = f"{list(BEGINNINGS)}[1 + p_partkey % {len(BEGINNINGS)}] || replace({list(ENDINGS)}[1 + (p_partkey // {len(BEGINNINGS)}) % {len(ENDINGS)}], '#', CAST(p_size AS VARCHAR))"
FILES_SQL = f"f AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'a/b.c/' ELSE '' END || {_LISTS} AS path FROM part), s AS (SELECT k, path, regexp_replace(path, '^.*/', '') AS name, regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS stem FROM f)"


def part_files(read) -> DataFrame:
    """(k, path): a file name for every part, out of each pair of beginning and ending in turn."""
    at = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    ending = F.replace(at(ENDINGS, F.floor(k / len(BEGINNINGS))), F.lit("#"), size)
    return read("part").select(k.alias("k"), F.concat(F.when(F.col("p_size") % 2 == 0, "a/b.c/").otherwise(""), at(BEGINNINGS, k), ending).alias("path"))


@query(f"WITH {FILES_SQL} SELECT k, path, CASE " + " ".join(f"WHEN regexp_matches(stem, '{p}') THEN regexp_extract(stem, '{p}', 1)" for p in labels.CONDITIONS) + " WHEN regexp_matches(stem, '^.*_([a-z]|[0-9]{1,4}|battery-[0-9]+)$') THEN regexp_replace(stem, '_[^_]*$', '') ELSE stem END AS condition FROM s")
def condition_label(read):
    return part_files(read).select("k", "path", labels.condition(F.col("path")).alias("condition"))


@query(f"WITH {FILES_SQL} SELECT k, CASE WHEN starts_with(stem, 'Tongji') THEN 'Tongji' ELSE split_part(stem, '_', 1) END AS domain FROM s")
def domain_label(read):
    return part_files(read).select("k", labels.domain(F.col("path")).alias("domain"))


_KNOWN = " ".join(f"WHEN starts_with(s.name, '{p}') THEN '{d}'" for p, d in labels.DATASETS)


@query(f"WITH {FILES_SQL} SELECT k, CASE {_KNOWN} ELSE CASE WHEN starts_with(stem, 'Tongji') THEN 'Tongji' ELSE split_part(stem, '_', 1) END END AS dataset FROM s")
def dataset_label(read):
    return part_files(read).select("k", labels.dataset(F.col("path")).alias("dataset"))


@query(f"WITH {FILES_SQL}, m AS (SELECT DISTINCT name, 'mapped' AS dataset FROM s WHERE starts_with(name, 'foo')) SELECT k, coalesce(m.dataset, CASE {_KNOWN} ELSE 'unknown' END) AS dataset FROM s LEFT JOIN m ON m.name = s.name")
def dataset_by_manifest(read):
    """A manifest names the files that begin with foo."""
    files = part_files(read).withColumn("name", labels.name_of(F.col("path")))
    named = files.filter(F.col("name").startswith("foo")).select("name", F.lit("mapped").alias("mapped")).distinct()
    return files.join(named, "name", "left").select("k", F.coalesce("mapped", labels.dataset(F.col("path"), F.lit("unknown"))).alias("dataset"))


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(lower(regexp_replace(regexp_replace(trim(replace(p_name || ' v1.5 (x)', '.', 'p')), '[^A-Za-z0-9_.-]+', '_', 'g'), '_+', '_', 'g')), '^_+|_+$', '', 'g'), ''), 'item') AS slug,
regexp_replace(regexp_replace(replace(p_type || ' 0.5', '.', 'p'), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS plain FROM part""")
def slug(read):
    return read("part").select("p_partkey", labels.slug(F.concat("p_name", F.lit(" v1.5 (x)"))).alias("slug"), labels.slug(F.concat("p_type", F.lit(" 0.5")), tidy=False).alias("plain"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, regexp_replace(url, '/[^/]*$', '') AS parent FROM pages")
def path_parts(read):
    u = F.col("url")
    return read("pages").select("page_id", labels.name_of(u).alias("name"), labels.stem_of(u).alias("stem"), labels.parent_of(u).alias("parent"))


@query("SELECT p_partkey, CAST(len(list_filter(string_split(p_size || ', ,' || p_partkey, ','), lambda x: trim(x) <> '')) AS BIGINT) AS n, p_size::BIGINT + p_partkey AS total FROM part")
def list_parsing(read):
    items = labels.listed(F.concat_ws(", ,", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")), "long")
    return read("part").select("p_partkey", F.size(items).alias("n"), F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# --- metrics ---------------------------------------------------------------------------------------

REG = f"count(*) AS n, round(sqrt(avg((pred - actual) * (pred - actual))), 6) AS RMSE, round(avg(abs(pred - actual)), 6) AS MAE, round({MAPE}, 6) AS MAPE_percent, round(CASE WHEN var_pop(actual) > 0 THEN 1 - sum((pred - actual) * (pred - actual)) / (var_pop(actual) * count(*)) END, 6) AS R2"


@query(f"WITH {PRED} SELECT {REG} FROM pred")
def regression_metrics(read):
    return metrics.regression_metrics(predictions(read))


@query(f"WITH {PRED} SELECT cohort, {REG} FROM pred GROUP BY cohort")
def strict_regression_metrics(read):
    return metrics.strict_regression_metrics(predictions(read), ("cohort",))


@query(f"WITH {PRED} SELECT count(*) AS n, round({MAPE}, 6) AS MAPE_percent, round(avg(CASE WHEN abs(pred - actual) / greatest(abs(actual), 1e-8) <= 0.15 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred")
def acc15(read):
    return metrics.accuracy_within(predictions(read))


EOL = f"""eol AS (SELECT g, avg(abs(p - a)) AS e, count(p - a) AS n FROM (SELECT {{g}} AS g, cell_id, min(CASE WHEN actual <= {EOL_VALUE} THEN target_cycle END) AS a, min(CASE WHEN pred <= {EOL_VALUE} THEN target_cycle END) AS p FROM {{t}} GROUP BY ALL) GROUP BY g)"""


@query(f"WITH {PRED}, {EOL.format(g='cohort', t='pred')} SELECT g AS cohort, n AS n_cells, round(e, 6) AS EOL_Error_cycles FROM eol")
def eol_cycle_error(read):
    return metrics.eol_error(predictions(read), ("cohort",), EOL_VALUE)


@query(f"""WITH {PRED}, st AS (SELECT 'cohort' AS group_by, CAST(cohort AS VARCHAR) AS group_value, * FROM pred UNION ALL SELECT 'kind', kind, * FROM pred UNION ALL SELECT 'band', CASE WHEN actual >= 450 THEN 'early_ge_0.90' WHEN actual >= 400 THEN 'mid_0.80_0.90' ELSE 'late_lt_0.80' END, * FROM pred),
e AS (SELECT group_by, group_value, avg(abs(p - a)) AS e FROM (SELECT group_by, group_value, cell_id, min(CASE WHEN actual <= {EOL_VALUE} THEN target_cycle END) AS a, min(CASE WHEN pred <= {EOL_VALUE} THEN target_cycle END) AS p FROM st GROUP BY ALL) GROUP BY ALL)
SELECT st.group_by, st.group_value, count(*) AS n_samples, count(DISTINCT cell_id) AS n_cells, min(target_cycle) AS target_cycle_min, max(target_cycle) AS target_cycle_max, {REG.split(', ', 1)[1]}, round(any_value(e.e), 6) AS EOL_Error_cycles
FROM st LEFT JOIN e ON e.group_by = st.group_by AND e.group_value IS NOT DISTINCT FROM st.group_value GROUP BY st.group_by, st.group_value""")
def group_metrics_grouping_sets(read):
    p = predictions(read).withColumn("band", numbers.soh_band(F.col("actual") / 500))
    return metrics.group_metrics(p, ("cohort", "kind", "band"), threshold=EOL_VALUE)


@query(f"WITH {PRED} SELECT cell_id, count(*) AS n, round(sqrt(avg((pred - actual) * (pred - actual))), 6) AS RMSE, round(avg(abs(pred - actual)), 6) AS MAE, round(avg(pred - actual), 6) AS bias FROM pred GROUP BY cell_id")
def per_cell_metrics(read):
    return metrics.cell_metrics(predictions(read))


@query(f"""WITH {SAMPLES}, e AS (SELECT abs(soh - target) AS err, abs(avg(soh) OVER (PARTITION BY file ORDER BY cycle_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - target) AS other, place, target FROM win), g AS (SELECT err - other AS gain FROM e WHERE place >= {LOOKBACK} AND target IS NOT NULL)
SELECT count(*) AS n, round(avg(gain), 6) AS mean_gain, round(median(gain), 6) AS median_gain, round(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS improved FROM g""")
def paired_improvement(read):
    """A moving average of five against persistence, on the same samples."""
    s = sequence(read).withColumn("mean5", F.avg("soh").over(W.partitionBy("file").orderBy("ord").rowsBetween(-4, 0)))
    p = windows.persistence(s, LOOKBACK, HORIZON).withColumn("actual", F.col("target"))
    keys = ("file", "input_end_cycle")
    return metrics.paired_improvement(p.select(*keys, "actual", F.col("mean5").alias("pred")), p.select(*keys, "actual", "pred"), keys)


CHANGED = f"{PRED}, ch AS (SELECT *, (cell_id % 7 - 3) / 10.0 AS pred_delta, baseline + (cell_id % 7 - 3) / 10.0 + CASE WHEN target_cycle % 11 = 0 THEN 0.25 ELSE 0 END AS moved FROM pred)"


def changed_predictions(read) -> DataFrame:
    """Predicted changes by cell; at every eleventh cycle the prediction is off from baseline + change."""
    p = predictions(read).withColumn("pred_delta", (F.col("cell_id") % 7 - 3) / 10.0)
    return p.withColumn("pred", F.col("baseline") + F.col("pred_delta") + F.when(F.col("target_cycle") % 11 == 0, 0.25).otherwise(0.0))


@query(f"WITH {CHANGED} SELECT count(*) AS n, round(avg(actual - baseline), 6) AS actual_delta_mean, round(avg(pred_delta), 6) AS pred_delta_mean, round(stddev_samp(actual - baseline), 6) AS actual_delta_std, round(stddev_samp(pred_delta), 6) AS pred_delta_std, round(max(abs(moved - (baseline + pred_delta))), 6) AS reconstruction_error FROM ch")
def delta_summary(read):
    return metrics.delta_summary(changed_predictions(read).withColumn("actual_delta", F.col("actual") - F.col("baseline")))


@query(f"WITH {CHANGED} SELECT cell_id, target_cycle FROM ch WHERE abs(moved - (baseline + pred_delta)) > 1e-6")
def reconstruction_violations(read):
    return audit.reconstruction_violations(changed_predictions(read)).select("cell_id", "target_cycle")


# --- roll-ups --------------------------------------------------------------------------------------

L1 = f"{TRIALS}, l1 AS (SELECT stage, seed, horizon, model, sum(mape) AS n_validation, avg(mae) AS mae, avg(rmse) AS rmse FROM trials GROUP BY ALL)"
L2 = f"{L1}, l2 AS (SELECT stage, horizon, model, count(DISTINCT seed) AS n_seeds, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std FROM l1 GROUP BY ALL)"


def level1(read):
    return rollup.by_seed(trials(read), ("stage", "seed", "horizon", "model"), ("mape",), ("mae", "rmse")).withColumnRenamed("mape", "n_validation")


def level2(read):
    return rollup.by_horizon(level1(read), ("stage", "horizon", "model"), ("mae", "rmse"))


@query(f"WITH {L1} SELECT stage, seed::BIGINT AS seed, horizon, model, round(n_validation, 6) AS n_validation, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM l1")
def rollup_by_seed(read):
    return level1(read)


@query(f"WITH {L2} SELECT stage, horizon, model, n_seeds, round(mae_mean, 6) AS mae_mean, round(mae_std, 6) AS mae_std, round(rmse_mean, 6) AS rmse_mean, round(rmse_std, 6) AS rmse_std FROM l2")
def rollup_by_horizon(read):
    return level2(read)


@query(f"WITH {L2} SELECT stage, model, count(DISTINCT horizon) AS n_horizons, round(avg(mae_mean), 6) AS mae_avg, round(coalesce(stddev_samp(mae_mean), 0), 6) AS mae_std, round(max(mae_mean), 6) AS mae_worst, round(avg(rmse_mean), 6) AS rmse_avg, round(coalesce(stddev_samp(rmse_mean), 0), 6) AS rmse_std, round(max(rmse_mean), 6) AS rmse_worst FROM l2 GROUP BY ALL")
def rollup_overall(read):
    return rollup.overall(level2(read), ("stage", "model"), ("mae", "rmse"))


@query(f"WITH {TRIALS} SELECT model, horizon, count(*) AS n, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std, round(min(mae), 6) AS mae_min, round(max(mae), 6) AS mae_max, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std, round(min(rmse), 6) AS rmse_min, round(max(rmse), 6) AS rmse_max FROM trials GROUP BY ALL")
def stats_mean_std_min_max(read):
    return rollup.stats(trials(read), ("model", "horizon"), ("mae", "rmse"))


@query(f"WITH {TRIALS} SELECT horizon, count(*) AS n, round(avg(mae), 6) AS mae_mean, round(min(mae), 6) AS mae_min, round(max(mae), 6) AS mae_max FROM trials GROUP BY ALL")
def scenario_overview(read):
    return rollup.stats(trials(read), ("horizon",), ("mae",), ("mean", "min", "max"))


@query(f"WITH {TRIALS} SELECT model, count(*) AS n, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS std FROM trials WHERE stage = 'O' GROUP BY ALL")
def mean_std(read):
    return rollup.mean_std(trials(read).filter("stage = 'O'"), ("model",), "mae")


BASE = f"{TRIALS}, m AS (SELECT horizon, model, avg(mae) AS mae, avg(rmse) AS rmse FROM trials GROUP BY ALL), b AS (SELECT horizon, mae AS bmae, rmse AS brmse FROM m WHERE model = 0)"


def by_model(read):
    return trials(read).groupBy("horizon", "model").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


@query(f"WITH {BASE} SELECT m.horizon, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bmae, 6) AS baseline_mae, round(bmae - mae, 6) AS gain, round((bmae - mae) / nullif(bmae, 0) * 100, 6) AS gain_percent, round(1 - mae / bmae, 6) AS skill FROM m LEFT JOIN b ON m.horizon = b.horizon")
def baseline_compare(read):
    return rollup.against_baseline(by_model(read), ("horizon",), "mae", 0)


@query(f"WITH {BASE} SELECT m.horizon, model, round(mae - bmae, 6) AS mae_gap, round(mae / nullif(bmae, 0), 6) AS mae_ratio, round(rmse - brmse, 6) AS rmse_gap, round(rmse / nullif(brmse, 0), 6) AS rmse_ratio FROM m LEFT JOIN b ON m.horizon = b.horizon")
def gap_ratio_vs_baseline(read):
    return rollup.gaps(by_model(read), ("horizon",), ("mae", "rmse"), 0).drop("mae", "rmse")


@query(f"WITH {TRIALS}, m AS (SELECT horizon, stage, avg(mae) AS mae FROM trials GROUP BY ALL), p AS (SELECT horizon, max(CASE WHEN stage = 'O' THEN mae END) AS after_mae, max(CASE WHEN stage = 'F' THEN mae END) AS before_mae FROM m GROUP BY horizon) SELECT horizon, round(after_mae, 6) AS after_mae, round(before_mae, 6) AS before_mae, round(before_mae - after_mae, 6) AS mae_gain, round((before_mae - after_mae) / nullif(before_mae, 0) * 100, 6) AS mae_gain_percent FROM p")
def before_after_pivot(read):
    m = trials(read).groupBy("horizon", "stage").agg(F.avg("mae").alias("mae"))
    return rollup.pivot_pair(m, ("horizon",), ("mae",), "O", "F", "stage", ("after", "before"))


# --- ranking and deduplication ---------------------------------------------------------------------

ORD = "o AS (SELECT o_orderkey, o_orderpriority, round(o_totalprice / 1e4, 0) * 1e4 AS price FROM orders)"


def orders(read):
    return read("orders").select("o_orderkey", "o_orderpriority", (F.round(F.col("o_totalprice") / 1e4, 0) * 1e4).alias("price"))


@query(f"WITH {ORD} SELECT o_orderkey, round(rank() OVER (PARTITION BY o_orderpriority ORDER BY price) + (count(*) OVER (PARTITION BY o_orderpriority, price) - 1) / 2.0, 6) AS rnk FROM o")
def avg_rank(read):
    return ranking.average_rank_by_ranges(orders(read), ("o_orderpriority",), "price", "rnk").select("o_orderkey", "rnk")


@query(f"WITH {BASE}, r AS (SELECT horizon, model, row_number() OVER (PARTITION BY horizon ORDER BY rmse, mae, model) AS rnk FROM m) SELECT horizon, model, rnk, rnk = 1 AS is_best FROM r")
def rank_records(read):
    rows = by_model(read).withColumn("r2", F.lit(None).cast("double"))
    return ranking.rank_records(rows, ("horizon",), "model", rmse="rmse", mae="mae", r2="r2").select("horizon", "model", F.col("rank").alias("rnk"), "is_best")


@query(f"WITH {BASE}, r AS (SELECT horizon, model, rank() OVER (PARTITION BY horizon ORDER BY mae) + (count(*) OVER (PARTITION BY horizon, mae) - 1) / 2.0 AS a, rank() OVER (PARTITION BY horizon ORDER BY rmse) + (count(*) OVER (PARTITION BY horizon, rmse) - 1) / 2.0 AS b FROM m) SELECT horizon, model, round((a + b) / 2, 6) AS mean_rank FROM r")
def mean_of_ranks(read):
    return rollup.rank_columns(by_model(read), ("mae", "rmse")).select("horizon", "model", "mean_rank")


@query(f"WITH {ORD} SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY price DESC, o_orderkey) AS place FROM o")
def cumcount(read):
    return ranking.numbered_by_ranges(orders(read), ("o_orderpriority",), [F.desc("price"), "o_orderkey"]).select("o_orderkey", "place")


@query(f"WITH {ORD}, r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY price DESC, o_orderkey) AS place FROM o) SELECT o_orderpriority, o_orderkey, place FROM r WHERE place <= 7")
def topk_per_group(read):
    return ranking.top_k(orders(read), ("o_orderpriority",), [F.desc("price"), "o_orderkey"], 7).select("o_orderpriority", "o_orderkey", "place")


@query(f"WITH {ORD}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY price, o_orderkey) AS place FROM o) SELECT o_orderpriority, o_orderkey, price FROM r WHERE place = 1")
def best_per_group(read):
    return ranking.best(orders(read), ("o_orderpriority",), ["price", "o_orderkey"]).select("o_orderpriority", "o_orderkey", "price")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS val, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS path FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (val IS NOT NULL) DESC, (path IS NOT NULL) DESC, o_orderkey DESC) AS place FROM c)
SELECT o_custkey, o_orderkey FROM r WHERE place = 1""")
def dedup_keep_best(read):
    c = read("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("val"), F.when(F.col("o_orderkey") % 3 == 0, "x").alias("path"))
    return ranking.keep_best_then_latest(c, ("o_custkey",), ("val", "path"), "o_orderkey").select("o_custkey", "o_orderkey")


@query(f"WITH {ORD}, b AS (SELECT price, min(o_orderkey) AS o_orderkey FROM o GROUP BY price) SELECT price, o_orderkey FROM b ORDER BY price DESC LIMIT 9")
def distinct_topk(read):
    return ranking.distinct_top(orders(read), "price", [F.desc("price"), "o_orderkey"], 9).select("price", "o_orderkey")


@query(f"WITH {BASE}, g AS (SELECT m.horizon, model, bmae - mae AS gain FROM m JOIN b ON m.horizon = b.horizon), r AS (SELECT *, row_number() OVER (ORDER BY (gain > 0) DESC, horizon, model) AS place FROM g) SELECT horizon, model, place FROM r WHERE place <= 30")
def winners_first(read):
    """The first 30 of all, those that gain on the baseline before the others."""
    g = ranking.winners_first(rollup.against_baseline(by_model(read), ("horizon",), "mae", 0), "gain", ["horizon", "model"]).limit(30)
    return ranking.ranked_together(g, [(F.col("gain") > 0).desc(), F.col("horizon"), F.col("model")], "place").select("horizon", "model", "place")


@query("SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def unique_in_order(read):
    return ranking.unique_in_order(read("orders"), "o_orderpriority", "o_orderkey")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(read):
    return ranking.duplicates(read("lineitem"), "l_orderkey", "l_linenumber")


# --- plans and sets --------------------------------------------------------------------------------


@query("SELECT r_regionkey::BIGINT AS r_regionkey, n_nationkey::BIGINT AS n_nationkey, s.seed::BIGINT AS seed, 'm' || n_nationkey || '|' || r_regionkey || '|' || s.seed AS trial FROM region CROSS JOIN nation CROSS JOIN (VALUES (1), (2), (3)) s(seed)")
def plan_cross_product(read):
    region, nation = read("region").select("r_regionkey"), read("nation").select("n_nationkey")
    seeds = region.sparkSession.createDataFrame([(1,), (2,), (3,)], "seed int")
    return experiments.plan(region, nation, seeds, key=("n_nationkey", "r_regionkey", "seed"), prefix="m")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def resume_anti_join(read):
    return sets.pending(read("customer").select("c_custkey"), read("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def used_semi_join(read):
    return sets.used(read("customer"), read("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT n_nationkey::BIGINT AS key FROM nation EXCEPT SELECT s_nationkey::BIGINT FROM supplier WHERE s_acctbal > 5000")
def missing_set(read):
    return sets.missing(read("nation").select(F.col("n_nationkey").cast("long").alias("key")), read("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("key")))


@query("SELECT s_nationkey::BIGINT AS key FROM supplier INTERSECT SELECT c_nationkey::BIGINT FROM customer WHERE c_acctbal < 0")
def common_keys(read):
    return sets.common(read("supplier").select(F.col("s_nationkey").cast("long").alias("key")), read("customer").filter("c_acctbal < 0").select(F.col("c_nationkey").cast("long").alias("key")))


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name, NULL::BIGINT AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_missing_columns(read):
    a = read("region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    b = read("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return sets.union_all(a, b)


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) = 3 AS complete FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def has_all_required(read):
    return sets.has_all(read("orders"), ("o_custkey",), "o_orderstatus", ["F", "O", "P"]).select("o_custkey", "complete")


# --- anomalies -------------------------------------------------------------------------------------

Z = """{n}m AS (SELECT median(x) AS med FROM {t}), {n} AS (SELECT any_value(med) AS med, median(abs(x - med)) AS mad FROM {t}, {n}m)"""


@query(f"WITH {SEQ}, v AS (SELECT soh AS x FROM seq WHERE file % 2 = 0), {Z.format(n='s', t='v')} SELECT file, cycle_number, round((soh - med) / (1.4826 * (mad + 1e-8)), 6) AS z FROM seq, s WHERE file % 2 = 1")
def robust_z(read):
    q = sequence(read)
    return anomaly.robust_z(q.filter("file % 2 = 1"), q.filter("file % 2 = 0"), "soh").select("file", "cycle_number", F.col("soh_z").alias("z"))


@query(f"WITH {PRED} SELECT round(quantile_cont(abs(pred - actual), 0.975), 6) AS threshold FROM pred")
def quantile_threshold(read):
    p = predictions(read).withColumn("residual", F.abs(F.col("pred") - F.col("actual")))
    return anomaly.quantile(p, "residual")


@query(f"""WITH {PRED}, r AS (SELECT cell_id, target_cycle, abs(actual - pred) AS residual, coalesce(abs(actual - pred) - lag(abs(actual - pred)) OVER (PARTITION BY cell_id ORDER BY target_cycle), 0) AS slope FROM pred),
a AS (SELECT residual AS x FROM r WHERE cell_id % 2 = 0), b AS (SELECT slope AS x FROM r WHERE cell_id % 2 = 0), {Z.format(n='za', t='a')}, {Z.format(n='zb', t='b')},
z AS (SELECT cell_id, target_cycle, (greatest((residual - za.med) / (1.4826 * (za.mad + 1e-8)), 0) + greatest((slope - zb.med) / (1.4826 * (zb.mad + 1e-8)), 0)) / 2 AS score FROM r, za, zb),
t AS (SELECT quantile_cont(score, 0.975) AS threshold FROM z WHERE cell_id % 2 = 0)
SELECT cell_id, target_cycle, round(score, 6) AS anomaly_score, score > threshold AS is_anomaly FROM z, t WHERE cell_id % 2 = 1""")
def anomaly_flags(read):
    p = predictions(read).withColumn("residual", F.abs(F.col("actual") - F.col("pred")))
    out = anomaly.anomaly_flags(p.filter("cell_id % 2 = 1"), p.filter("cell_id % 2 = 0"))
    return out.select("cell_id", "target_cycle", "anomaly_score", "is_anomaly")


@query(None)
def isolation_scores(read):
    """Every vector against a forest of those with even ids."""
    e = read("embeddings").select("vec_id", "embedding")
    return isolation.with_latent(e, e.filter("vec_id % 2 = 0"), "embedding", ["vec_id"]).select("vec_id", "latent_score")


# --- audits ----------------------------------------------------------------------------------------

SPLIT = "sp AS (SELECT doc_id AS file, source AS condition, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents)"


def document_split(read):
    m = F.col("doc_id") % 10
    return read("documents").select(F.col("doc_id").alias("file"), F.col("source").alias("condition"), F.when(m < 6, "train").when(m < 8, "val").otherwise("test").alias("split"))


@query(f"WITH {SPLIT} SELECT condition AS file, CAST(count(DISTINCT split) AS BIGINT) AS n_splits FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1")
def overlap_check(read):
    s = document_split(read).select(F.col("condition").alias("file"), "split")
    return splits.overlaps(s).select("file", F.size("splits").alias("n_splits"))


@query(f"WITH {TRIALS} SELECT model, count(DISTINCT horizon) AS n, count(DISTINCT horizon) = 7 AS complete FROM trials GROUP BY 1")
def completeness_check(read):
    return audit.completeness(trials(read), ("model",), "horizon", 7)


POLICY = f"""{FILES_SQL}, d AS (SELECT s.*, CASE {_KNOWN} ELSE 'unknown' END AS dataset, k // 40 AS run, k % 3 AS sp FROM s),
m AS (SELECT *, run % 6 AS kind, CASE WHEN run % 6 = 5 AND k % 40 = 7 THEN 1 ELSE 0 END AS twice FROM d),
x AS (SELECT run, kind, name, dataset, sp FROM m WHERE NOT (kind = 4 AND sp = 2) UNION ALL SELECT run, kind, name, dataset, (sp + 1) % 3 FROM m WHERE twice = 1 OR kind IN (1, 2) AND k % 40 = 3),
u AS (SELECT DISTINCT run, kind, name, dataset, sp FROM x),
a AS (SELECT run, any_value(kind) AS kind, count(*) > count(DISTINCT name) AS again, count(*) FILTER (sp = 2) AS n_test,
 string_agg(DISTINCT dataset, ', ' ORDER BY dataset) FILTER (dataset IN {audit.EXCLUDED}) AS excluded, string_agg(DISTINCT dataset, ', ' ORDER BY dataset) FILTER (dataset NOT IN {audit.LIION}) AS outside FROM u GROUP BY run)"""


@query(f"""WITH {POLICY} SELECT run, concat_ws('; ', CASE WHEN excluded IS NOT NULL THEN 'split uses excluded datasets: ' || excluded END, CASE WHEN outside IS NOT NULL THEN 'split uses datasets outside the policy: ' || outside END,
CASE WHEN again AND kind = 1 THEN 'condition-gap split needs a gap of 20, has 5' END, CASE WHEN again AND kind = 2 THEN 'condition-gap split takes 20 cycles at most, has 30' END, CASE WHEN again AND kind NOT IN (1, 2) THEN 'files stand in several splits outside condition-gap mode' END,
CASE WHEN kind = 3 THEN 'chronological-within-file is no final split policy' END, CASE WHEN again AND kind IN (0, 4, 5) THEN 'file-level split has overlapping files' END, CASE WHEN n_test = 0 THEN 'no test files' END) AS failures,
excluded IS NULL AND outside IS NULL AND NOT again AND kind <> 3 AND n_test > 0 AS policy_ok FROM a""")
def policy_audit(read):
    """Runs of forty files each under policies in turn, some with a file in two splits, some without test files."""
    f = part_files(read).select("k", labels.name_of(F.col("path")).alias("name"), F.floor(F.col("k") / 40).alias("run"), (F.col("k") % 3).alias("sp"))
    f = f.withColumn("kind", F.col("run") % 6)
    twice = f.filter("kind = 5 and k % 40 = 7 or kind in (1, 2) and k % 40 = 3").withColumn("sp", (F.col("sp") + 1) % 3)
    every = f.filter("not (kind = 4 and sp = 2)").unionByName(twice)
    of = lambda n: F.collect_set(F.when(F.col("sp") == n, F.col("name")))
    runs = every.groupBy("run", "kind").agg(of(0).alias("train_files"), of(1).alias("val_files"), of(2).alias("test_files"))
    mode = F.when(F.col("kind").isin(1, 2), "condition-gap-within-file").when(F.col("kind") == 3, "chronological-within-file").when(F.col("kind") == 5, "battery").otherwise("file-level")
    runs = runs.withColumns({"split_mode": mode, "split_gap": F.when(F.col("kind") == 1, 5).otherwise(20), "early_cycle": F.when(F.col("kind") == 2, 30).otherwise(20)})
    return audit.split_policy(runs).select("run", F.array_join("failures", "; ").alias("failures"), "policy_ok")


@query("SELECT source AS dataset, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE source NOT IN ('src0', 'src1', 'src2') GROUP BY 1")
def purity_violations(read):
    d = audit.impure(read("documents"), "source", ["src0", "src1", "src2"])
    return d.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT o_orderpriority, string_agg(m, ',' ORDER BY m) AS markers FROM (SELECT DISTINCT o_orderpriority, m FROM orders, (VALUES ('high'), ('urgent'), ('ent'), ('low')) x(m) WHERE contains(lower(o_orderpriority), m)) GROUP BY 1")
def marker_detection(read):
    o = read("orders").select("o_orderpriority").distinct()
    found = labels.markers_in([F.col("o_orderpriority")], ("high", "urgent", "ent", "low"))
    return o.select("o_orderpriority", found.alias("markers")).filter("markers <> ''")


# --- JSON and hashes -------------------------------------------------------------------------------


@query("""SELECT '{"event_id":' || event_id || ',"k":' || coalesce(props->>'$.k', 'null') || ',"share":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '0.5' END || '}' AS line FROM events""")
def json_metric_rows(read):
    """NaN becomes null, and missing fields stay as null."""
    e = read("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(0.5).alias("share"))
    return sinks.json_rows(e)


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber = 1 OR l_quantity > 40 THEN NULL ELSE round(l_discount, 6) END AS share FROM lineitem")
def finite_columns(read):
    odd = F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_quantity") > 40, float("inf")).otherwise(F.col("l_discount").cast("double"))
    return sinks.finite_columns(read("lineitem").select("l_orderkey", "l_linenumber", odd.alias("share")))


@query("""SELECT p_partkey, left(sha1('{"brand": "' || p_brand || CASE p_size % 3 WHEN 0 THEN '\\"\\\\' WHEN 1 THEN '\\u00e9\\ud83d\\ude00\\n' ELSE '' END || '", "size": ' || p_size || '}'), 10) AS hash FROM part""")
def config_hash(read):
    """Quotes, backslashes, line ends and characters beyond ASCII are escaped as JSON has them."""
    odd = F.when(F.col("p_size") % 3 == 0, '"\\').when(F.col("p_size") % 3 == 1, "é😀\n").otherwise("")
    return read("part").select("p_partkey", experiments.config_hash({"size": F.col("p_size"), "brand": F.concat("p_brand", odd)}).alias("hash"))


# --- projections, filters, selection ----------------------------------------------------------------


@query("SELECT 'run' AS name, 7::BIGINT AS seed, c_custkey, c_acctbal AS val_balance, c_mktsegment AS segment, coalesce(c_nationkey::VARCHAR, '') || '|' || c_mktsegment AS key, 'c_nationkey=' || c_nationkey || '|c_mktsegment=' || c_mktsegment AS named FROM customer")
def projected_columns(read):
    c = read("customer").select("c_custkey", F.col("c_acctbal").alias("balance"), "c_nationkey", "c_mktsegment")
    out = projections.with_constants(projections.prefixed(c, "val_", ("balance",)), name="run", seed=7)
    out = out.withColumn("key", projections.key_of("c_nationkey", "c_mktsegment")).withColumn("named", projections.key_of("c_nationkey", "c_mktsegment", named=True))
    return projections.known_first(projections.without(out.withColumnRenamed("c_mktsegment", "segment"), "c_nationkey"), ("name", "seed"))


@query("SELECT url FROM pages WHERE regexp_matches(regexp_extract(url, '([^/]*)$', 1), '[0-9]') AND NOT regexp_matches(regexp_extract(url, '([^/]*)$', 1), 'html|page') ORDER BY url LIMIT 25")
def file_filter(read):
    """Include and exclude by name, then the first 25 by path."""
    files = read("pages").select(F.col("url").alias("path"), labels.name_of(F.col("url")).alias("name"))
    return cells.chosen_files(files, "[0-9]", "html|page", 25).select(F.col("path").alias("url"))


@query(f"WITH {FILES_SQL} SELECT k, starts_with(name, 'MATR') AS own FROM s")
def prefix_partition(read):
    own, others = cells.dataset_files(part_files(read).withColumn("name", labels.name_of(F.col("path"))), "MATR")
    return sets.union_all(own.select("k", F.lit(True).alias("own")), others.select("k", F.lit(False).alias("own")))


@query(f"WITH {SEQ}, c AS (SELECT file, count(*) AS n, min(soh) AS low, max(soh) AS high FROM seq GROUP BY file) SELECT file, concat_ws('; ', CASE WHEN n < 60 THEN 'needs 60 cycles, has ' || n END, CASE WHEN low > 2 THEN 'never low' END, CASE WHEN high < 200 THEN 'never high' END) AS reason, CASE WHEN n < 60 OR low > 2 OR high < 200 THEN 'skipped' ELSE 'used' END AS status FROM c")
def status_reasons(read):
    c = sequence(read).groupBy("file").agg(F.count("*").alias("n"), F.min("soh").alias("low"), F.max("soh").alias("high"))
    why = labels.reasons((F.col("n") < 60, F.concat(F.lit("needs 60 cycles, has "), F.col("n").cast("string"))), (F.col("low") > 2, "never low"), (F.col("high") < 200, "never high"))
    return c.select("file", why.alias("reason"), labels.status(why).alias("status"))


def metric_files(l: DataFrame) -> DataFrame:
    path = F.concat(F.lit("runs/"), F.when(F.col("l_partkey") % 5 == 0, "Tuned_").otherwise(""), F.col("l_orderkey").cast("string"))
    m = F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string"))
    model = F.when(m == "m0", "persistence").otherwise(m)
    rows = l.groupBy(model.alias("model"), path.alias("path")).agg(F.avg("l_tax").alias("RMSE"), F.avg("l_discount").alias("MAE"))
    return rows.withColumn("policy_ok", F.lit(True)).withColumn("R2", F.lit(None).cast("double"))


METRIC_FILES = "r AS (SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'persistence' ELSE 'm' || (l_suppkey % 4) END AS model, 'runs/' || CASE WHEN l_partkey % 5 = 0 THEN 'Tuned_' ELSE '' END || l_orderkey AS path, avg(l_tax) AS RMSE, avg(l_discount) AS MAE FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {METRIC_FILES}, k AS (SELECT path, string_agg(model, ',' ORDER BY model) FILTER (model <> 'persistence') AS learned_models, count(*) FILTER (model <> 'persistence') AS n FROM r GROUP BY path) SELECT model, r.path, learned_models FROM r JOIN k ON r.path = k.path WHERE model <> 'persistence' AND n >= 2 AND NOT starts_with(r.path, 'runs/Tuned')")
def selection_candidates(read):
    return selection.candidates(metric_files(read("lineitem")), drop_tuned=True, drop_single=True).select("model", "path", "learned_models")


@query(f"WITH {METRIC_FILES} SELECT model, path, row_number() OVER (ORDER BY round(RMSE, 9), round(MAE, 9), model, path) AS place FROM r WHERE model <> 'persistence'")
def global_test_rank(read):
    rows = selection.candidates(metric_files(read("lineitem"))).withColumns({c: F.round(c, 9) for c in ("RMSE", "MAE")})
    return selection.by_test_metrics(rows, "path").select("model", "path", F.col("rank").alias("place"))


VAL = f"{L2}, v AS (SELECT model, horizon, avg(mae_mean) AS mae, avg(rmse_mean) AS rmse, avg(mae_std) AS std FROM l2 GROUP BY ALL)"


def validation_summary(read) -> DataFrame:
    v = level2(read).groupBy("model", "horizon").agg(F.avg("mae_mean").alias("MAE_mean"), F.avg("rmse_mean").alias("RMSE_mean"), F.avg("mae_std").alias("MAE_std"))
    return v.withColumn("MAPE_percent_mean", F.col("MAE_mean") * 100).withColumn("skill_mean", 1 - F.col("MAE_mean"))


@query(f"WITH {VAL}, s AS (SELECT model, avg(mae) AS a, avg(rmse) AS r, coalesce(stddev_samp(mae), 0) AS s, max(mae) AS w, count(DISTINCT horizon) AS n FROM v GROUP BY model) SELECT model, round(a, 6) AS avg_MAE, round(s, 6) AS std_MAE, round(w, 6) AS worst_MAE, n AS n_horizons, row_number() OVER (ORDER BY a, r, model) = 1 AS selected FROM s")
def validation_selection(read):
    return selection.by_validation_metrics(validation_summary(read), 7).select("model", "avg_MAE", "std_MAE", "worst_MAE", "n_horizons", "selected")


@query(f"WITH {VAL}, r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY mae, rmse, model) AS place FROM v) SELECT horizon, model, round(mae, 6) AS mae FROM r WHERE place = 1")
def best_per_horizon(read):
    return selection.per_horizon(validation_summary(read)).select("horizon", "model", F.col("MAE_mean").alias("mae"))


@query(f"""WITH {FILES_SQL}, d AS (SELECT CASE {_KNOWN} ELSE 'unknown' END AS dataset FROM s), n AS (SELECT dataset, count(*) AS n FROM d GROUP BY 1), e AS (SELECT unnest(['CALB', 'MATR', 'SNL', 'ABSENT']) AS dataset)
SELECT coalesce(n.dataset, e.dataset) AS dataset, coalesce(n, 0) AS n, CASE WHEN n.dataset IS NULL THEN 'missing' WHEN n.dataset IN {audit.EXCLUDED} THEN 'excluded' WHEN e.dataset IS NULL THEN 'unexpected' ELSE 'allowed' END AS status FROM n FULL JOIN e ON n.dataset = e.dataset""")
def file_inventory(read):
    return audit.inventory(part_files(read), ["CALB", "MATR", "SNL", "ABSENT"])
