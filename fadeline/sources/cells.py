"""Cell files. Canonical storage is Parquet with the CELL_FILE schema; pickled files are imported once, by a restricted reader."""

from __future__ import annotations

import fnmatch
import io
import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import LEAST_POINTS, capacity_soh, features
from ..functions.labels import name_of
from ..operators.ranking import duplicates
from ..schemas import CELL_FILE

SUFFIX = ".pkl"
#: Cycles of a file that are listed as wrong, and files that a split needs.
ERRORS, LEAST_USABLE = 5, 3


def find_files(spark: SparkSession, root: str, pattern: str = f"*{SUFFIX}", recursive: bool = True) -> DataFrame:
    """(path, name, length) of the files below root, or of root itself if it is one, sorted by path; contents are not read.

    A root that is a file of another kind raises.
    """
    own = spark._jvm.org.apache.hadoop.fs.Path(root)
    if own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own).isFile() and not fnmatch.fnmatch(own.getName(), pattern):
        raise ValueError(f"{root} is no {pattern} file")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(root)
    return files.select("path", name_of(F.col("path")).alias("name"), "length").orderBy("path")


def chosen_files(files: DataFrame, include: str | None = None, exclude: str | None = None, limit: int | None = None) -> DataFrame:
    """Files whose names the expressions take (searched for, not anchored), the first `limit` of them by path."""
    if include:
        files = files.filter(F.col("name").rlike(include))
    if exclude:
        files = files.filter(~F.col("name").rlike(exclude))
    return files if limit is None else files.orderBy("path").limit(limit)


def split_by_prefix(files: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(files of one dataset, the others)."""
    own = F.col("name").startswith(prefix)
    return files.filter(own), files.filter(~own)


def dataset_files(files: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """split_by_prefix, raising if the dataset has no file."""
    own, others = split_by_prefix(files, prefix)
    if own.isEmpty():
        raise ValueError(f"no file begins with {prefix}")
    return own, others


class _Plain(pickle.Unpickler):
    """Reads containers, numbers, strings and numeric arrays only."""

    ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("_codecs", "encode"), ("numpy.core.numeric", "_frombuffer"), ("numpy._core.numeric", "_frombuffer")}

    def find_class(self, module: str, name: str):
        if (module, name) in self.ALLOWED:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def read_plain(data: bytes) -> dict:
    """The dictionary of a pickled cell file; anything but plain data raises."""
    out = _Plain(io.BytesIO(data)).load()
    if not isinstance(out, dict):
        raise pickle.UnpicklingError("a cell file holds a dictionary")
    return out


def cell_row(name: str, cell: dict) -> tuple:
    """CELL_FILE values of one unpickled cell; a missing id is the file's stem."""
    curve = lambda c, key: [float(x) for x in (c.get(key) if c.get(key) is not None else [])]
    cycles = [(None if c.get("cycle_number") is None else int(c["cycle_number"]), *(curve(c, k) for k in ("voltage_in_V", "current_in_A", "discharge_capacity_in_Ah"))) for c in cell.get("cycle_data") or []]
    nominal = cell.get("nominal_capacity_in_Ah")
    return name, str(cell.get("cell_id") or name.rpartition(".")[0] or name), None if nominal is None else float(nominal), cycles


def import_pickles(spark: SparkSession, root: str) -> DataFrame:
    """CELL_FILE rows of pickled files: file, cell_id, nominal capacity, cycles. For one-off imports into Parquet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").load(root)

    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([cell_row(path.rpartition("/")[2], read_plain(content)) for path, content in zip(frame["path"], frame["content"], strict=True)], columns=CELL_FILE.names)

    return files.select("path", "content").mapInPandas(run, CELL_FILE)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Canonical cell files."""
    return spark.read.schema(CELL_FILE).parquet(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Canonical cell files, one folder per dataset, so that dataset filters prune the scan."""
    from ..functions.labels import dataset

    cells.withColumn("dataset", dataset(F.col("file"))).write.mode("overwrite").partitionBy("dataset").parquet(path)


def fixed_origin_records(cells: DataFrame, lookback: int, horizons: list[int], length: int) -> DataFrame:
    """One row per file for fixed-origin samples: file, cell_id, status, reason, n_features, origin_soh, targets (map horizon -> soh), n_cycles, feature_errors, soh_errors.

    Cycles are ordered by number, those without one last, and then counted from 1. Labels come from every
    cycle, features from cycles 1..lookback alone; of cycles that share a number the last in order that has a
    label counts. A file is used if it has all of those features, a label at the origin and one at a horizon;
    otherwise its reasons are listed. Each list of errors holds the first ERRORS cycles, in their order, that
    gave no feature where one is needed, or no label.
    """
    from ..functions.arrays import reference_capacity

    horizons = sorted(set(horizons))
    rows = cells.select("file", F.coalesce("cell_id", F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1)).alias("cell_id"), "nominal_capacity_in_Ah", F.size("cycle_data").alias("n"), F.posexplode_outer("cycle_data").alias("at", "c"))
    order = W.partitionBy("file").orderBy(F.coalesce("c.cycle_number", "n"), "at")
    rows = rows.withColumn("place", F.when(F.col("at").isNotNull(), F.row_number().over(order) - 1))
    rows = rows.withColumn("reference", reference_capacity(F.col("nominal_capacity_in_Ah"), F.col("c.discharge_capacity_in_Ah"), F.col("place"), "file"))
    number = F.coalesce("c.cycle_number", F.col("place") + 1)
    early = number.between(1, lookback)
    feature = F.when(early, features(F.col("c.voltage_in_V"), F.col("c.current_in_A"), length, order="IV"))
    soh = capacity_soh(F.col("c.discharge_capacity_in_Ah"), F.col("reference"))
    rows = rows.select("file", "cell_id", "place", number.alias("number"), early.alias("early"), feature.isNotNull().alias("has_feature"), soh.alias("soh"))
    there = F.col("place").isNotNull()

    def first_wrong(test: Column, what: str) -> Column:
        error = F.when(there & test, F.struct("place", F.concat(F.lit("cycle "), F.col("number").cast("string"), F.lit(f": {what}")).alias("text")))
        return F.transform(F.slice(F.array_sort(F.collect_list(error)), 1, ERRORS), lambda e: e["text"])

    label_at = lambda n: F.max_by("soh", F.when((F.col("number") == n) & F.col("soh").isNotNull(), F.col("place")))
    out = rows.groupBy("file", "cell_id").agg(
        F.count_distinct(F.when(F.col("has_feature"), F.col("number"))).alias("n_features"), label_at(lookback).alias("origin_soh"), *(label_at(lookback + h).alias(f"_{h}") for h in horizons), F.count("place").alias("n_cycles"),
        first_wrong(F.col("early") & ~F.col("has_feature"), "no feature").alias("feature_errors"), first_wrong(F.col("soh").isNull(), "no label").alias("soh_errors"),
    )
    targets = F.map_filter(F.map_from_arrays(F.array(*(F.lit(h) for h in horizons)), F.array(*(F.col(f"_{h}") for h in horizons))), lambda _, v: v.isNotNull())
    out = out.withColumn("targets", targets).drop(*(f"_{h}" for h in horizons))
    reasons = F.concat_ws("; ", F.when(F.col("n_features") < lookback, F.concat(F.lit(f"needs features of {lookback} cycles, has "), F.col("n_features").cast("string"))), F.when(F.col("origin_soh").isNull(), F.lit(f"no label at cycle {lookback}")), F.when(F.size("targets") == 0, F.lit("no label at any horizon")))
    return out.withColumn("reason", reasons).withColumn("status", F.when(reasons == "", "used").otherwise("skipped"))


def check_records(records: DataFrame, least: int = LEAST_USABLE) -> None:
    """Raise for files of one name, or for fewer than `least` that can be used."""
    used = records.filter("status = 'used'")
    again = [r["file"] for r in duplicates(used, "file").orderBy("file").limit(20).collect()]
    if again:
        raise ValueError(f"duplicate ids: {', '.join(again)}")
    if (n := used.limit(least).count()) < least:
        raise ValueError(f"needs {least} usable files, has {n}")


def manifest_counts(records: DataFrame) -> DataFrame:
    """(horizon, n): usable files with a target, per horizon."""
    return records.filter("status = 'used'").select(F.explode("targets").alias("horizon", "soh")).groupBy("horizon").agg(F.count("*").alias("n"))


__all__ = ["LEAST_POINTS", "check_records", "chosen_files", "dataset_files", "find_files", "fixed_origin_records", "import_pickles", "manifest_counts", "read_cells", "read_plain", "split_by_prefix", "write_cells"]
