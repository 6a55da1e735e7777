"""Exact top-k by inner product with a pivot table.

Vectors are lifted to one norm M, the largest there is, by one more component, which turns the
largest inner product into the least distance: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. A table holds each
vector's distances to many pivots. For a query, the largest difference to its own distances bounds
its distance to a vector from below, and so the product from above. Vectors are evaluated in the
order of their bounds until no bound reaches the k-th best product.

Bounds are doubles with room for their rounding; products are whole numbers and exact. A
component stands for the whole number floor(64 * x) and is held as that over 64, which a double
holds exactly for every finite x.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_of, exponent, matrix, rows_of, search, usable

PIVOTS, SAMPLE = 32, 2048
#: Vectors evaluated in the first step of a query; each step doubles.
FIRST_STEP = 64
#: Where a step takes this part of a shard or more, one pass over the shard is cheaper than picking its vectors out.
ALL_FROM = 16
#: Below it products are exact in doubles, in 64 bits; above in Python's whole numbers.
DOUBLES, LONGS = 2.0**52, 2.0**62


def whole(x: np.ndarray) -> np.ndarray:
    """floor(64 * x) / 64, exactly: from 2^46 on every double is a multiple of 1/64."""
    large = np.abs(x) >= 2.0**46
    return np.where(large, x, np.floor(64.0 * np.where(large, 0.0, x)) / 64.0)


def numbers(v: np.ndarray) -> np.ndarray:
    """floor(64 * x) of what `whole` gave, as Python's whole numbers."""
    return np.array([int(x * 64) if abs(x) < 2.0**46 else int(x) * 64 for x in v.ravel().tolist()], object).reshape(v.shape)


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (v * v).sum(axis=1), 0))
    return np.concatenate((v, rest[:, None]), axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def rounding(norm: float, dim: int) -> float:
    """More than squares and products of vectors of `dim` components and up to this norm can be off by."""
    return 64 * (dim + 16) * np.finfo(float).eps * norm * norm


def upper_bounds(query: np.ndarray, away: np.ndarray, far: np.ndarray, norm: float) -> np.ndarray:
    """At least the product of the query and each vector, of which `away` and `far` (pivot, vector) are the distances to the pivots."""
    least, gap = np.zeros((2, far.shape[1]))
    for column, a in zip(far, away, strict=True):
        np.abs(np.subtract(column, a, out=gap), out=gap)
        np.maximum(least, gap, out=least)
    off = rounding(norm, len(query))
    least = np.maximum(least - 2 * np.sqrt(off), 0)  # a square that is off by `off` puts its root off by no more than sqrt(off)
    return (float(query @ query) + norm * norm - least * least) / 2 + 2 * off


def spread_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    chosen, away = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def pivot_search(bound: np.ndarray, query_id: int, ids: np.ndarray, product, share, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, products) of the query's k best, and how many vectors were evaluated.

    product(places) gives exact products; share(product) puts one on the bounds' scale.
    """
    order = np.argsort(-bound)  # equal bounds in any order: `best_of` settles ties, and a bound that ties the k-th best is evaluated
    order = order[ids[order] != query_id]
    best_ids, best, at, step = ids[:0], None, 0, FIRST_STEP
    while at < len(order):
        if best is not None and len(best) >= k and bound[order[at]] < share(best[-1]):
            break
        own = order[at : at + step]
        new = product(own)
        best_ids, best = np.concatenate((best_ids, ids[own])), new if best is None else np.concatenate((best, new))
        keep = best_of(best_ids, best, k)
        best_ids, best = best_ids[keep], best[keep]
        at, step = at + step, step * 2
    return best_ids, np.zeros(0, np.int64) if best is None else best, min(at, len(order))


def norm_of(v: np.ndarray) -> tuple[float, int]:
    """(m, e): no row of v has a norm beyond m * 2^e."""
    e = exponent(float(np.abs(v).max(initial=0)))
    return float(np.sqrt((np.ldexp(v, -e) ** 2).sum(axis=1).max())) * (1 + 1e-9), e


def exact_products(query: np.ndarray, v: np.ndarray, reach: float):
    """places -> exact products of whole numbers, given that none of them, nor a part of its sum, is beyond `reach`."""
    if reach < DOUBLES:
        every = []

        def product(at):
            if len(at) * ALL_FROM < len(v):
                return 4096.0 * (v[at] @ query)
            if not every:
                every.append(4096.0 * (v @ query))
            return every[0][at]

        return product
    if reach < LONGS:  # a norm that is not zero is 1/64 or more, so that the components fit as well
        own = (64 * query).astype(np.int64)
        return lambda at: (64 * v[at]).astype(np.int64) @ own
    own = numbers(query)
    return lambda at: numbers(v[at]) @ own


def exact_top_k(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest products of floor(64 * x), ties to smaller ids.

    `is_query` is a condition on the id column. Rows with a null id or a vector that is null or holds null
    or non-finite components take no part; shorter vectors end in zeros (all are worked on at the widest's
    width, a few at a time if that is large); fewer candidates than k: all.
    Every row is a candidate of its own, repeated or not, and every row that the condition picks is a query
    of its own with ranks from 1; rows that share a query's id are not its candidates. Products are exact
    at any size of the components, and so is the order; a product beyond 64 bits shows as a null score.
    """
    own = usable(vectors, id_col, vec_col)
    asked = own.filter(is_query(F.col("id")))
    top = F.max(F.array_max(F.transform("vec", F.abs)))
    stats = own.agg(F.count("*").alias("n"), F.sum(is_query(F.col("id")).cast("int")).alias("q"), F.max(F.size("vec")).alias("dim"), top.alias("top")).first()
    dim, e = stats.dim or 1, exponent((stats.top or 0.0) + 1 / 64)
    # bounds are of components over 2^e, all below 1: no square overflows
    scaled = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(F.when(F.abs(x) < 2.0**46, F.floor(x * 64).cast("double") / 64).otherwise(x) * F.lit(2.0**-e), 2))
    square = own.agg(F.max(scaled).alias("square")).first().square
    norm = float(square or 0) ** 0.5 * (1 + 1e-12)
    drawn = own.orderBy(F.xxhash64("id"), "id").limit(rows_of(SAMPLE, dim)).collect()  # SAMPLE rows at most, fewer of great width, to choose pivots from
    pivots = spread_pivots(lifted(np.ldexp(whole(matrix([r.vec for r in drawn], dim)), -e), norm))
    bits = 2 * (e + 6) + dim.bit_length() + 1  # a product's size, its sign included
    wide = bits > 63
    width = bits // 8 + 1

    def tables(x: np.ndarray) -> list[np.ndarray]:
        v = whole(x)
        return [v, distances(lifted(np.ldexp(v, -e), norm), pivots)]

    def query_tables(x: np.ndarray) -> list[np.ndarray]:
        q = whole(x)
        return [q, distances(np.concatenate((np.ldexp(q, -e), np.zeros((len(q), 1))), axis=1), pivots)]

    def kernel(query_ids, query_side, ids, side):
        v, q = (np.frombuffer(s[0]).reshape(-1, dim) for s in (side, query_side))
        far, own_far = (np.frombuffer(s[1]).reshape(-1, len(pivots)) for s in (side, query_side))
        far, small = np.ascontiguousarray(far.T), np.ldexp(q, -e)
        largest = norm_of(v)
        out = []
        for number, (query_id, query, away) in enumerate(zip(query_ids, q, own_far, strict=True)):
            own = norm_of(query[None, :])
            with np.errstate(over="ignore"):
                reach = float(np.ldexp(largest[0] * own[0], largest[1] + own[1] + 12))
            share = (lambda p: float(np.ldexp(float(p), -12 - 2 * e))) if reach < LONGS else (lambda p: float(int(p) / (1 << 12 + 2 * e)))
            product = exact_products(query, v, reach)
            found, score, _ = pivot_search(upper_bounds(small[number], away, far, norm), query_id, ids, product, share, k)
            out.append((np.full(len(found), number), found, score.astype(object if wide else np.int64)))
        numbers_, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        if not wide:
            return numbers_, found, score
        exact = [int(p) for p in score]
        return numbers_, found, [p if -(2**63) <= p < 2**63 else None for p in exact], [(p + (1 << bits)).to_bytes(width, "big") for p in exact]

    return search(own, asked, dim, stats.n, stats.q or 0, tables, query_tables, kernel, k, "long", "binary" if wide else None)


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """Per query (vec_id divisible by 20) its 20 best: query_id, rank, vec_id, score."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c % 20 == 0, 20)
