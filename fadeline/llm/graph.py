"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rounds shrink the diameter by a constant factor each; this many never suffice only for absurd graphs.
MOST_ROUNDS = 60
#: Nodes of a partition's edges that a task holds at a time.
MOST_NODES = 1_000_000


def local_forest(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Of each run of edges, of up to MOST_NODES nodes, keep only star edges of its own components; the components stay what they were."""

    def shrink(batches):
        import numpy as np
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def stars():
            rows = np.array([(x, top) for x in parent if (top := root(x)) != x], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=[a, b])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > MOST_NODES:
                yield stars()
                parent.clear()
        yield stars()

    return edges.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(shrink, f"{a} long, {b} long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns u, v, long); component is its smallest node.

    Alternating large-star and small-star rounds: each node only ever meets the least of its
    neighbours, an aggregate that combines before the shuffle, so that no adjacency list is gathered. It is
    written before it is joined back, so that the edges of a node with very many can be split over tasks.
    Self-loops and repeated edges do no harm; an empty table gives an empty one.
    """
    pairs = materialise(local_forest(edges.filter("u is not null and v is not null"), "u", "v").distinct(), "edges")
    last = None
    for _ in range(MOST_ROUNDS):
        # large star: every neighbour above a node is tied to the least of that node and its neighbours
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialise(large.distinct(), "large-star")
        discard(pairs, least)
        # small star: a node and its smaller neighbours are tied to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = materialise(small.filter("u <> v").distinct(), "small-star")
        discard(large, least)
        mark = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
