"""Artefacts: tables and a document that belong together (constants, split, parameters), published whole or not at all.

An artefact is a folder of versions. A version is first written to a staging folder beside them, its checksums last,
and then appears by one rename. Readers take the newest version; a writer that dies before the rename leaves all
readers what they had. The rename must be atomic in the store, as it is in HDFS and local file systems. A checksum reads a
file whole: files are those of constants, states and parameters, of less than 2 GB each.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import json_text

VERSION = re.compile(r"v(\d{6,})$")
DOCUMENT, CHECKSUMS = "document.json", "checksums"


def _store(spark: SparkSession, path: str) -> tuple:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, sha256) of the files below the tables and document of a version."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/content")
    return files.select(F.regexp_extract("path", r"/content/(.*)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def stage(spark: SparkSession, path: str, tables: dict[str, DataFrame], document: dict | None = None) -> str:
    """Write a version to a staging folder, checksums last; nothing that readers see changes."""
    folder = f"{path}/staging-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/content/{name}")
    text = spark.createDataFrame([(json_text(document or {}),)], "value string")
    text.coalesce(1).write.option("lineSep", "\n").text(f"{folder}/content/{DOCUMENT}")
    _sums(spark, folder).write.parquet(f"{folder}/{CHECKSUMS}")
    return folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, in order."""
    own, store = _store(spark, path)
    if not store.exists(own):
        return []
    names = [s.getPath().getName() for s in store.listStatus(own) if s.isDirectory()]
    return sorted(int(m[1]) for n in names if (m := VERSION.match(n)))


def commit(spark: SparkSession, path: str, staged: str) -> int:
    """Publish what was staged as the next version; of two writers at once each gets a number of its own."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_store(spark, path)[0].toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        number = max(versions(spark, path), default=0) + 1
        try:
            context.rename(_store(spark, staged)[0], _store(spark, f"{path}/v{number:06d}")[0], plain)  # fails where there is one
            return number
        except Exception:
            if number not in versions(spark, path):
                raise


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], document: dict | None = None) -> int:
    """Stage and commit: the number of the new version."""
    return commit(spark, path, stage(spark, path, tables, document))


def current(spark: SparkSession, path: str, version: int | None = None) -> str:
    """The folder of the newest version, or of the one asked for."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"{path}: no version{'' if version is None else f' {version}'}")
    return f"{path}/v{found[-1] if version is None else version:06d}"


def table(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{current(spark, path, version)}/content/{name}")


def document(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(value): the document as text, one row."""
    return spark.read.text(f"{current(spark, path, version)}/content/{DOCUMENT}", wholetext=True)


def damaged(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file, fault): files of a version that are missing, changed or were never written; none if it is whole."""
    folder = current(spark, path, version)
    now = _sums(spark, folder).select("file", F.col("length").alias("_length"), F.col("sha256").alias("_sha256"))
    met = spark.read.parquet(f"{folder}/{CHECKSUMS}").join(now, "file", "full")
    fault = F.when(F.col("_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "added").when((F.col("sha256") != F.col("_sha256")) | (F.col("length") != F.col("_length")), "changed")
    return met.select("file", fault.alias("fault")).filter("fault is not null")
