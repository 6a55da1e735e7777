"""Helpers that the training-data operators share: scratch tables, row keys, word splitting."""

from __future__ import annotations

import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at a time; a longer text is a step of its own.
STEP_BYTES = 1_000_000
#: Distinct words whose hashes a worker remembers before it starts afresh.
MEMO_WORDS = 100_000
#: Where scratch tables go if a session on one machine names no folder.
LOCAL_SCRATCH = "/tmp/fadeline-scratch"


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one that the session names in spark.checkpoint.dir.

    Only a session whose executors all run on this machine (master local) may leave that setting out.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or LOCAL_SCRATCH).rstrip('/')}/fadeline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, which goes when the application ends, or earlier by `discard` and `clear_scratch`."""
    folder = scratch_dir(spark)
    if folder not in _to_delete:
        _to_delete.add(folder)
        own, files = _files(spark, folder)
        files.mkdirs(own)
        files.deleteOnExit(own)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared scratch folder and read it back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


_to_delete: set[str] = set()


def _files(spark: SparkSession, path: str) -> tuple:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing still to be computed reads."""
    for df in tables:
        own, files = _files(df.sparkSession, df.scratch_path)
        files.delete(own, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; for when no result that reads them is still to be computed."""
    own, files = _files(spark, scratch_dir(spark))
    files.delete(own, True)


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart even where doc_id is null or repeats: id and a hash of the text."""
    return [doc_id.cast("long").alias("doc_id"), F.xxhash64(doc_id.isNull(), F.coalesce(text, F.lit(""))).alias("text_key")]


def carried(docs: DataFrame) -> DataFrame:
    """(doc, id, key): each row as one struct beside its row_key, so that no column of docs clashes with others in a join."""
    own_id, key = row_key(F.col("doc_id"), F.col("text"))
    return docs.select(F.struct("*").alias("doc"), own_id.alias("id"), key.alias("key"))


def restored(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again out of carried rows, some of them changed."""
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def steps(texts: Iterable[bytes | None], most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes with the index of their first; None counts as empty."""
    at, held, size, i = 0, [], 0, -1
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


class WordHashes(dict):
    """word -> its 64-bit hash, remembered for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(texts: list[bytes], memo: dict) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their hashes end to end, and where each text starts (one more at the end).

    bytes.split() parts at space and 0x09-0x0D only, which is `[^\\x20\\x09-\\x0D]+`.
    """
    words = [t.split() for t in texts]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    hashes = np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(starts[-1]))
    return words, hashes, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def give_back() -> None:
    """Return the memory that a finished task leaves to the system: idle Python workers share an executor's memory with its JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of mapInArrow, giving memory back at the end of each task."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batch, rows: int = 256) -> Iterator:
    """The batch a few rows at a time: nested values take many times their room once they are Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(batch, name: str = "text", rows: int = 256) -> Iterator[bytes | None]:
    """The texts of a batch, a few at a time, so that the batch is not held twice."""
    import pyarrow as pa

    for part in slices(batch, rows):
        yield from part.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
