"""Tables of results: metric files found below a folder, their sidecars, manifests, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import parent_of
from ..operators.positions import as_read
from ..schemas import METRICS
from .tables import read_tables

METRIC_FILE, SIDECAR = "model_comparison_metrics.csv", "split_info.json"


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A CSV file with a header; with a schema no pass to infer one."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header of one file alone; `tables.headers` reads those of many, in parallel."""
    return spark.read.option("header", True).csv(path).columns


def keyed_strings(spark: SparkSession, path: str, key: str = "model") -> dict[str, dict[str, str | None]]:
    """A small CSV file as text, by key; of repeated keys the last line counts."""
    return {r[key]: r.asDict() for r in spark.read.option("header", True).csv(path).coalesce(1).collect()}


def keyed_rows(spark: SparkSession, path: str, columns: list[str], key: str = "model") -> DataFrame:
    """The lines of CSV files of any size as text, one per key: of repeated keys the last line counts. Lines of all files count in the order of paths."""
    rows = as_read(spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path), "_line")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in columns if c != key)), "_line").alias("_last"))
    return last.filter(F.col(key).isNotNull()).select(key, "_last.*").select(*columns)


def find_metrics(spark: SparkSession, roots: list[str], exclude: str | None = None, name: str = METRIC_FILE) -> DataFrame:
    """Metric rows below the roots with path and folder, in order of path; files below `exclude` are left out. Columns that a file lacks are null.

    A root that is given twice, or lies below another, counts once. `extras` holds further columns as text.
    """
    rows = read_tables(spark, roots, METRICS, name, exclude)
    return rows.withColumn("folder", parent_of(F.col("path"))).orderBy("path")


def sidecars(spark: SparkSession, roots: list[str], schema, name: str = SIDECAR) -> DataFrame:
    """(folder, info) of the JSON documents that stand beside metric files."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(roots, wholetext=True)
    return text.select(parent_of(F.col("_metadata.file_path")).alias("folder"), F.from_json("value", schema).alias("info"))


def with_sidecars(metric_rows: DataFrame, info: DataFrame) -> DataFrame:
    """metric rows with the info of their folder, null where there is none."""
    return metric_rows.join(info, "folder", "left")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, dataset) of a manifest document; a malformed one gives no rows."""
    text = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", "array<struct<file:string,dataset:string>>"), F.from_json("value", "struct<files:array<struct<file:string,dataset:string>>>")["files"])
    return text.select(F.inline(items)).filter("file is not null")


def completed(metric_rows: DataFrame, key: list[str], models: list[str]) -> DataFrame:
    """Keys whose metric rows cover all required models: what a resumed run need not repeat."""
    have = metric_rows.groupBy(*key).agg(F.collect_set("model").alias("have"))
    return have.filter(F.size(F.array_except(F.array(*map(F.lit, models)), "have")) == 0).select(*key)


def predictions(spark: SparkSession, glob: str, pattern: str = r"([^/]+?)_predictions\.csv$") -> DataFrame:
    """Prediction files with `model` out of their names."""
    rows = read_csv(spark, glob)
    return rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
