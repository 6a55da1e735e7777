"""Isolation forest: how few random cuts part a vector from a sample of the reference.

Trees grow on a bounded sample, POOL rows at most whatever the reference's size, so that the forest is
a few arrays of at most 2 * SAMPLE nodes a tree. Scoring reads every row, in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, SEED = 200, 256, 42
#: Rows of the reference that the trees draw their samples from.
POOL = 8192
#: Rows that one step walks down the trees together.
STEP = 4096


def expected_depth(n):
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    more = np.maximum(n, 3)
    return np.where(n < 2, 0.0, np.where(n < 3, 1.0, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """(feature, cut, left, right, depth) of a tree's nodes; a leaf is its own child, its depth that expected of its rows."""
    most = math.ceil(math.log2(max(len(x), 2)))
    feature, cut, left, right, depth, waiting = [], [], [], [], [], [(np.arange(len(x)), 0, None)]
    while waiting:
        rows, level, parent = waiting.pop()
        node = len(feature)
        if parent is not None:
            parent[0][parent[1]] = node
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) > 1 and level < most else (np.zeros(0), np.zeros(0))
        apart = np.flatnonzero(low < high)
        if not len(apart):
            for field, value in zip((feature, cut, left, right, depth), (0, 0.0, node, node, level + float(expected_depth(len(rows)))), strict=True):
                field.append(value)
            continue
        f = int(rng.choice(apart))
        u = rng.random()
        at = max(low[f], min(low[f] * (1 - u) + high[f] * u, np.nextafter(high[f], low[f])))  # the least goes left, the largest right
        for field, value in zip((feature, cut, left, right, depth), (f, at, node, node, 0.0), strict=True):
            field.append(value)
        below = x[rows, f] <= at
        waiting += [(rows[below], level + 1, (left, node)), (rows[~below], level + 1, (right, node))]
    return [np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(depth)]


def walk(x: np.ndarray, forest: list[list[np.ndarray]], base: float) -> np.ndarray:
    """Score of each row, from 0 to 1: 2 to minus its mean depth over the depth expected of a tree's sample."""
    total, every = np.zeros(len(x)), np.arange(len(x))
    for feature, cut, left, right, depth in forest:
        node = np.zeros(len(x), np.int64)
        while True:
            down = np.where(x[every, feature[node]] <= cut[node], left[node], right[node])
            if (down == node).all():
                break
            node = down
        total += depth[node]
    return np.exp2(-total / (len(forest) * base))


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether the vector has components, all finite (and as many as dim)."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    return F.coalesce(ok if dim is None else ok & (F.size(vector) == dim), F.lit(False))


def latent_score(reference: DataFrame, vector: str, keys: Sequence[str], trees: int = TREES, sample: int = SAMPLE, pool: int = POOL, seed: int = SEED):
    """A function of a vector column: its isolation score against the reference, higher where more is odd.

    The forest grows when this is called, on the `pool` rows of least hash of their keys and seed; each tree
    takes `sample` of them. Vectors that are null, empty, hold null or non-finite components, or have
    another length than most of those rows, take no part and score null, as every row does without a reference.
    Repeated rows count as often as they stand.
    """
    own = reference.select(*keys, F.col(vector).cast("array<double>").alias("_vector")).filter(usable(F.col("_vector")))
    drawn = own.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys, "_vector").select("_vector").limit(pool).collect()
    sizes = [len(r[0]) for r in drawn]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d), default=1)
    x, rng = np.array([r[0] for r in drawn if len(r[0]) == dim]).reshape(-1, dim), np.random.default_rng(seed)
    size = min(sample, len(x))
    forest = [grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)] if len(x) else []
    base = max(float(expected_depth(size)), 1.0)

    @F.pandas_udf("double")
    def score(v):
        import pandas as pd

        out = np.full(len(v), np.nan)
        there = np.flatnonzero(v.notna().to_numpy())
        for at in range(0, len(there), STEP):
            rows = there[at : at + STEP]
            out[rows] = walk(np.stack(v.iloc[rows].to_list()), forest, base)
        return pd.Series(out, index=v.index)

    def apply(c: Column) -> Column:
        c = c.cast("array<double>")
        return F.when(usable(c, dim), score(F.when(usable(c, dim), c))) if forest else F.lit(None).cast("double")

    return apply


def with_latent(rows: DataFrame, reference: DataFrame, vector: str, keys: Sequence[str], name: str = "latent_score", **options) -> DataFrame:
    """rows with their isolation score against the reference as a column, for `anomaly_flags(latent=...)`."""
    return rows.withColumn(name, latent_score(reference, vector, keys, **options)(F.col(vector)))
