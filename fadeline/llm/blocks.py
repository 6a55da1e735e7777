"""A stated set of queries against all vectors, block by block.

Vectors and queries are packed into chunks, chunks dealt to shards and query blocks of bounded size, and
each pair of a shard and a block searched by a kernel that returns every query's best of that shard.
A last window keeps the best of all shards. No task holds more than one shard and one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import session_partitions

#: Vectors of a chunk, of a shard, and queries of a block at most, if vectors are not very wide.
CHUNK, SHARD, BLOCK = 1024, 16384, 8192
#: Bytes that the components of a shard or block take at most; a wider vector is one by itself.
MOST_BYTES = 64 << 20


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows with an id and a vector of finite components only; vec as doubles."""
    vec = F.col(vec_col).cast("array<double>")
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ok)


def matrix(vecs: list, dim: int) -> np.ndarray:
    """Rows of `dim` doubles; shorter vectors end in zeros."""
    out = np.zeros((len(vecs), dim))
    if vecs and {len(v) for v in vecs} == {dim}:
        out[:] = vecs
    else:
        for k, v in enumerate(vecs):
            out[k, : len(v)] = v
    return out


def rows_of(most: int, dim: int) -> int:
    """How many vectors of `dim` doubles to take together, `most` at most."""
    return max(1, min(most, MOST_BYTES // (8 * dim)))


def packed(df: DataFrame, groups: int, dim: int, tables: Callable[[np.ndarray], list[np.ndarray]], queries: bool, chunk: int) -> DataFrame:
    """(part, is_query, tags, ids, t0, t1): chunks of up to `chunk` rows; `tables` makes two arrays of as many rows from the vectors.

    A tag is the row's own number, so that rows that share an id stay apart.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        tag = number << 33
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                ids = part.column(0).to_numpy().astype(np.int64)
                made = [t.tobytes() for t in tables(matrix(part.column(1).to_pylist(), dim))]
                row = (number % groups, queries, np.arange(tag, tag + len(ids)).tobytes(), ids.tobytes(), *made)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds(pa), strict=True)], names=["part", "is_query", "tags", "ids", "t0", "t1"])
                number, tag = number + 1, tag + len(ids)

    def kinds(pa):
        return [pa.int32(), pa.bool_(), *[pa.binary()] * 4]

    return df.mapInArrow(run, "part int, is_query boolean, tags binary, ids binary, t0 binary, t1 binary")


def search(vectors: DataFrame, queries: DataFrame, dim: int, n: int, n_queries: int, tables, query_tables, kernel, k: int, score: str, key: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best by `kernel`, ties to the smaller id; score is a SQL type.

    kernel(query_ids, query_tables, ids, tables) gets the tables' bytes joined and returns arrays (number of
    the query among query_ids, vec_id, score[, key]) that hold every query's k best of that shard. Where `key`
    is a type, that column and not the score decides the order. Every row of `queries` is a query of its own.
    """
    shards = max(1, -(-n // rows_of(SHARD, dim)))
    at_least = -(-n_queries // rows_of(BLOCK, dim))
    blocks = max(1, at_least, min(-(-n_queries // CHUNK), -(-2 * session_partitions(vectors.sparkSession) // shards)))
    own = packed(vectors, shards, dim, tables, False, rows_of(CHUNK, dim)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ask = packed(queries, blocks, dim, query_tables, True, rows_of(min(CHUNK, -(-n_queries // blocks) or 1), dim)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    every = own.withColumnRenamed("part", "shard").unionByName(ask.withColumnRenamed("part", "block"))
    names = ["tag", "query_id", "vec_id", "score", *["sort_key"] * bool(key)]

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc  # a worker that has only imported pyarrow has no pa.compute

        sides = []
        for side in (True, False):
            part = table.filter(pc.equal(table.column("is_query"), side))
            joined = [b"".join(part.column(c).to_pylist()) for c in ("tags", "ids", "t0", "t1")]
            sides.append((np.frombuffer(joined[0], np.int64), np.frombuffer(joined[1], np.int64), joined[2:]))
        (tags, query_ids, query_side), (_, ids, side) = sides
        found = kernel(query_ids, query_side, ids, side) if len(query_ids) and len(ids) else [np.zeros(0, np.int64)] * (3 + bool(key))
        types = [{"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[t] for t in (score, *[key] * bool(key))]
        columns = [pa.array(tags[found[0]]), pa.array(query_ids[found[0]]), pa.array(found[1], pa.int64()), *(pa.array(c, t) for c, t in zip(found[2:], types, strict=True))]
        return pa.table(columns, names=names)

    best = every.groupBy("shard", "block").applyInArrow(run, f"tag long, query_id long, vec_id long, score {score}" + f", sort_key {key}" * bool(key))
    order = W.partitionBy("query_id", "tag").orderBy(F.desc("sort_key" if key else "score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if scores.dtype == object:  # Python's whole numbers
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def exponent(top: float) -> int:
    """e with 2^(e-1) <= top < 2^e; 0 for 0. Dividing by 2^e is exact and keeps squares within range."""
    return math.frexp(top)[1]
