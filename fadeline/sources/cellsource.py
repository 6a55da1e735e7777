"""A Spark data source of pickled cell files, `cells`: spark.read.format("cells").load(folder) after register(spark).

Scans are planned by bytes of files, not by their number. Files are opened by pyarrow, so that the folder may be
local or in a store that it knows. Files are read by the restricted reader: plain data and numeric arrays only.
What a task holds as Python objects is one cell when it writes, and files of a few bytes, or one, when it reads,
however many rows it has.
"""

from __future__ import annotations

import ctypes
import fnmatch
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schemas import CELL_FILE
from .cells import SUFFIX, cell_row, read_plain

#: Bytes of files that a task reads; a larger file is a task of its own. Rows of an Arrow batch, and bytes of the files in it.
TASK_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 16, 1 << 20
CURVES = ("voltage_in_V", "current_in_A", "discharge_capacity_in_Ah")


@dataclass
class Files(InputPartition):
    """The paths that one task reads."""

    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


def dealt(files: list[tuple[str, int]], most: int = TASK_BYTES) -> list[list[str]]:
    """Files (path, bytes) in order, in runs of `most` bytes each; a file that is larger is a run of its own."""
    runs: list[list[str]] = []
    held = 0
    for path, size in files:
        if not runs or held + size > most:
            runs.append([])
            held = 0
        runs[-1].append(path)
        held += size
    return runs


def _opened(folder: str) -> tuple:
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(folder)


def _give_back() -> None:
    """Return the memory of a finished task to the system: idle Python workers share an executor's memory with its JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


class CellReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.pattern = options.get("pattern", f"*{SUFFIX}")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        import pyarrow.fs

        store, root = _opened(self.folder)
        own = store.get_file_info(root)
        if own.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        found = [own] if own.is_file else store.get_file_info(pyarrow.fs.FileSelector(root, recursive=self.recursive))
        files = sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern))
        return [Files(paths) for paths in dealt(files, self.task_bytes)]

    def read(self, partition: Files) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, names = to_arrow_schema(CELL_FILE), CELL_FILE["cycle_data"].dataType.elementType.names
        store, _ = _opened(self.folder)
        rows: list[dict] = []
        held = 0
        for path in partition.paths if partition else ():
            with store.open_input_file(path) as source:
                data = source.read()
            if rows and (len(rows) >= BATCH_ROWS or held + len(data) > BATCH_BYTES):
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
            try:
                own = cell_row(path.rpartition("/")[2], read_plain(data))
            except Exception as error:
                raise ValueError(f"{path}: {error}") from error
            held += len(data)
            rows.append(dict(zip(CELL_FILE.names, (*own[:3], [dict(zip(names, c, strict=True)) for c in own[3]]), strict=True)))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
        del rows
        _give_back()


@dataclass
class Written(WriterCommitMessage):
    files: int


def _cell(row) -> tuple[str, dict]:
    """The file name and the cell of a batch of one row; what is null is left out."""
    import numpy as np

    name, cell_id, nominal = (row.column(c)[0].as_py() for c in ("file", "cell_id", "nominal_capacity_in_Ah"))
    if not name or "/" in name:
        raise ValueError(f"{name!r} is no file name")
    data = row.column("cycle_data").flatten()  # a struct for each cycle; none if there is no list
    if data.null_count:
        raise ValueError(f"{name!r} has a cycle that is null")
    parts = {"cycle_number": [x.as_py() for x in data.field("cycle_number")]}
    for c in CURVES:
        parts[c] = [None if x.values is None else np.array(x.values.to_numpy(zero_copy_only=False), np.float32) for x in data.field(c)]
    cycles = [{k: v for k, v in zip(parts, own, strict=True) if v is not None} for own in zip(*parts.values(), strict=True)]
    cell = {"cell_id": cell_id, "nominal_capacity_in_Ah": nominal, "cycle_data": cycles}
    return name, {k: v for k, v in cell.items() if v is not None}


class CellWriter(DataSourceArrowWriter):
    """One pickled file a row. Each comes by a rename, so that a task that is lost leaves no half of one, and its repetition the same file.

    Rows stay in Arrow batches until they are written, one by one: a batch of them as Python objects is many times as large.
    """

    def __init__(self, options) -> None:
        self.folder = options["path"]

    def write(self, iterator: Iterator) -> Written:
        store, root = _opened(self.folder)
        store.create_dir(root, recursive=True)
        files = 0
        for batch in iterator:
            for k in range(batch.num_rows):
                name, cell = _cell(batch.slice(k, 1))
                own = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(pickle.dumps(cell, protocol=4))
                store.move(own, f"{root}/{name}")
                files += 1
        _give_back()
        return Written(files)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class Cells(DataSource):
    """Options: path, a folder or one file; pattern, a glob on names; recursive; taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self):
        return CELL_FILE

    def reader(self, schema) -> CellReader:
        return CellReader(self.options)

    def writer(self, schema, overwrite: bool) -> CellWriter:
        if overwrite:
            raise ValueError("cells are only appended; take a new folder")
        return CellWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Cells)
