"""CSV tables that differ in columns: files are grouped by header, each group is one typed scan, the groups are united by name."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are read of a file at a time until its first line has ended.
CHUNK = 1 << 16


def listed(spark: SparkSession, roots: Iterable[str], name: str, exclude: str | None = None) -> DataFrame:
    """(path, uri) of the files below the roots, or roots themselves, whose names fit the glob; contents are not read.

    A root that is given twice, or lies below another, counts once; files below `exclude` are left out, and those
    without a byte, as Spark's scans do.
    """
    tidy = sorted({r.rstrip("/") for r in roots})
    roots = [r for r in tidy if not any(r.startswith(other + "/") for other in tidy)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load([_plain(r) for r in roots])
    files = files.select("path", F.col("_metadata.file_path").alias("uri"))
    return files.filter(~F.contains("path", F.lit(exclude.rstrip("/") + "/"))) if exclude else files


def _plain(path: str) -> str:
    """The path with what a glob would take for a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def first_line(source, chunk: int = CHUNK) -> str:
    """The first record of an open CSV file: up to a line's end outside of quotes; nothing behind its chunk is read."""
    held = b""
    while more := source.read(chunk):
        held += bytes(more)
        quoted, at = False, -1
        for at, b in enumerate(held):
            if b == 34:
                quoted = not quoted
            elif b in (10, 13) and not quoted:
                return held[:at].decode("utf-8-sig")
    return held.decode("utf-8-sig")


def headers(files: DataFrame) -> DataFrame:
    """(path, header) of listed files: the names in each one's first line, read where a task opens the file; none if it is blank.

    Executors open files by pyarrow: local paths and the stores that it knows.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs

        for batch in batches:
            found = []
            for uri in batch.column(1).to_pylist():
                store, path = pyarrow.fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path) as source:
                    found.append(next(csv.reader(io.StringIO(first_line(source))), []))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["path", "header"])

    return files.select("path", "uri").mapInArrow(run, "path string, header array<string>")


def read_tables(spark: SparkSession, roots: Iterable[str], known: T.StructType, name: str = "*.csv", exclude: str | None = None) -> DataFrame:
    """Rows of all files that `listed` finds: the columns of `known` by name and type, `extras` with the others as text, `path`.

    What a file lacks is null, whatever the order of its columns; of a name that a header repeats the first counts
    for a known column, the last for an extra; values that do not fit their type are null, as are empty ones.
    The driver holds the paths, grouped by header; rows are read by one scan a group.
    """
    groups = headers(listed(spark, roots, name, exclude)).filter(F.size("header") > 0).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header")
    out = spark.createDataFrame([], known).select("*", F.lit(None).cast("map<string,string>").alias("extras"), F.lit(None).cast("string").alias("path"))
    types = {f.name: f.dataType for f in known.fields}
    for header, paths in groups.collect():
        # columns by place: names may clash in case, repeat or be empty
        own = T.StructType([T.StructField(f"c{k}", types.get(c, T.StringType())) for k, c in enumerate(header)])
        rows = spark.read.schema(own).option("header", True).option("multiLine", any("\n" in c or "\r" in c for c in header)).csv([_plain(p) for p in paths])
        place = {c: k for k, c in reversed(list(enumerate(header)))}
        others = {c: k for k, c in enumerate(header) if c not in types}
        extras = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*(F.col(f"c{k}") for k in others.values()))) if others else F.create_map().cast("map<string,string>")
        picked = [F.col(f"c{place[f.name]}") if f.name in place else F.lit(None).cast(f.dataType) for f in known.fields]
        out = out.unionByName(rows.select(*(c.alias(f.name) for c, f in zip(picked, known.fields, strict=True)), extras.alias("extras"), F.col("_metadata.file_path").alias("path")))
    return out
