"""Approximate nearest neighbours by cosine: multi-index hashing over learned rotated binary codes.

Codes of BITS bits are the signs of a rotation learnt (iterative quantisation) on a bounded sample.
A code is split into SUBSTRINGS parts, each with an index of its own. Codes within radius r of a query
have a part within r // SUBSTRINGS of the query's: probing all those keys in every index retrieves
every code within r. Radii grow until the k-th best cosine found says that nearer vectors would have
shown: the sample tells within which radius nearly all pairs of such a cosine lie.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_of, matrix, rows_of, search, usable

BITS, SUBSTRINGS, SAMPLE, ROUNDS = 64, 4, 4096, 30
WIDTH = BITS // SUBSTRINGS
#: First radius inside a part, and the share of the sample's pairs of a cosine that its radius must take in.
FIRST, COVER = 3, 0.98
#: More than the rounding of a cosine of unit vectors.
ROUNDING = 1e-9
_FLIPS = [np.flatnonzero(np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32)) == r).astype(np.int64) for r in range(WIDTH + 1)]


def ranged(x: np.ndarray) -> np.ndarray:
    """Each row over a power of two, so that its largest component is from 1/2 to 1: no square overflows, no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def learn_rotation(sample: np.ndarray) -> np.ndarray:
    """(dim, BITS) projections: principal directions rotated to lie near binary corners; repeated if dim < BITS."""
    dim, out, made, rng = sample.shape[1], [], 0, np.random.default_rng(7)
    main = np.linalg.svd(sample, full_matrices=False)[2].T if len(sample) >= dim else np.eye(dim, min(dim, BITS))
    while made < BITS:
        m = min(dim, BITS - made)
        basis = main[:, :m] if m < dim else main
        turn = np.linalg.qr(rng.standard_normal((m, m)))[0]
        low = sample @ basis
        for _ in range(ROUNDS if len(sample) else 0):
            u, _, vt = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (u @ vt).T
        out.append(basis @ turn)
        made += m
    return np.concatenate(out, axis=1)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotation > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def learn_radii(sample: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """radius[i]: within it lie COVER of the pairs of cosine i / 100; from the sample, or for rare cosines from the angle."""
    angle = np.arccos(np.arange(101) / 100) / math.pi
    radius = np.ceil(BITS * angle + 2.5 * np.sqrt(BITS * angle * (1 - angle)) + 1)
    if len(sample) > 1:
        code = codes(sample, rotation)
        some = slice(0, len(sample), max(1, len(sample) // 256))
        cosine = np.rint(100 * (sample[some] @ sample.T)).astype(int).ravel()
        apart = np.bitwise_count(code[some][:, None] ^ code[None, :]).ravel()
        for c in range(100):
            if (own := cosine == c).sum() >= 200:
                radius[c] = np.quantile(apart[own], COVER)
    return np.maximum.accumulate(radius[::-1])[::-1]


class Index:
    """An index per part of the codes: places in the order of their keys, and where each key begins."""

    def __init__(self, code: np.ndarray) -> None:
        self.code, self.order, self.begin = code, [], []
        for s in range(SUBSTRINGS):
            key = self.part(code, s)
            self.order.append(np.argsort(key, kind="stable"))
            self.begin.append(np.concatenate(([0], np.cumsum(np.bincount(key, minlength=1 << WIDTH)))))

    @staticmethod
    def part(code, s: int):
        return ((code >> np.uint64(s * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def probe(self, code: np.uint64, r: int) -> np.ndarray:
        """Places whose code has some part at exactly r bits from that part of `code`, repeats included."""
        found = []
        for s in range(SUBSTRINGS):
            key = self.part(code, s) ^ _FLIPS[r]
            a, n = self.begin[s][key], self.begin[s][key + 1] - self.begin[s][key]
            a, n = a[n > 0], n[n > 0]
            found.append(self.order[s][np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else a, n) + np.arange(n.sum())])
        return np.concatenate(found)


def near_search(query: np.ndarray, query_id: int, code: np.uint64, index: Index, ids: np.ndarray, x: np.ndarray, k: int, radii: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of the query's nearest found, by cosines of unit vectors: the k best and all that rounding could put among them.

    `seen` is a mask of all places that is False before and after.
    """
    touched, waiting, apart = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    best_at, best = np.zeros(0, np.int64), np.zeros(0)
    for r in range(WIDTH + 1):
        new = index.probe(code, r)
        new = np.unique(new[~seen[new]])
        seen[new] = True
        touched.append(new)
        new = new[ids[new] != query_id]  # never its own candidate
        waiting, apart = np.concatenate((waiting, new)), np.concatenate((apart, np.bitwise_count(index.code[new] ^ code).astype(np.int64)))
        radius = SUBSTRINGS * r + SUBSTRINGS - 1
        if r < FIRST:
            continue
        own, waiting, apart = waiting[apart <= radius], waiting[apart > radius], apart[apart > radius]
        best_at, best = np.concatenate((best_at, own)), np.concatenate((best, x[own] @ query))
        if len(best) > k:
            keep = best >= np.partition(best, len(best) - k)[len(best) - k] - ROUNDING
            best_at, best = best_at[keep], best[keep]
        if len(best) >= k and radius >= radii[min(100, max(0, math.floor(100 * best.min())))]:
            break
    seen[np.concatenate(touched)] = False
    return best_at


def cosines(query: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of the query and each row, all sums in the order of the components: equal vectors score equally wherever they lie."""
    total = lambda a: np.cumsum(a, axis=1)[:, -1]
    return total(v * query) / (np.sqrt(total(v * v)) * np.sqrt(total(query[None, :] * query)))


def nearest(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by cosine, nearest first, ties to smaller ids.

    `is_query` is a condition on the id column. Rows with a null id or a vector that is null, zero, or holds
    null or non-finite components take no part; shorter vectors end in zeros (all are worked on at the widest's
    width, a few at a time if that is large); fewer candidates than k: all.
    Every other row is indexed, repeated or not, and every row that the condition picks is a query of its
    own with ranks from 1; rows that share a query's id are not its candidates. Codes and radii only choose
    candidates: scores are those of the vectors as given, in doubles.
    """
    own = usable(vectors, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    asked = own.filter(is_query(F.col("id")))
    stats = own.agg(F.count("*").alias("n"), F.sum(is_query(F.col("id")).cast("int")).alias("q"), F.max(F.size("vec")).alias("dim")).first()
    dim = stats.dim or 1
    drawn = own.orderBy(F.xxhash64("id"), "id").limit(rows_of(SAMPLE, dim)).collect()  # SAMPLE rows at most, fewer of great width, to learn the rotation from
    sample = unit(ranged(matrix([r.vec for r in drawn], dim))) if drawn else np.zeros((0, dim))
    rotation = learn_rotation(sample)
    radii = learn_radii(sample, rotation)

    def tables(x: np.ndarray) -> list[np.ndarray]:
        x = ranged(x)
        return [x, codes(unit(x), rotation)]

    def kernel(query_ids, query_side, ids, side):
        v, q = (np.frombuffer(s[0]).reshape(-1, dim) for s in (side, query_side))
        code, own_code = (np.frombuffer(s[1], np.uint64) for s in (side, query_side))
        x, ask, index, seen, out = unit(v), unit(q), Index(code), np.zeros(len(ids), bool), []
        for number, (query_id, query, own) in enumerate(zip(query_ids, q, own_code, strict=True)):
            at = near_search(ask[number], query_id, own, index, ids, x, k, radii, seen)
            score = cosines(query, v[at])
            keep = best_of(ids[at], score, k)
            out.append((np.full(len(keep), number), ids[at[keep]], score[keep]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    return search(own, asked, dim, stats.n, stats.q or 0, tables, tables, kernel, k, "double")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """Per query (vec_id divisible by 50) its 5 nearest found: query_id, rank, vec_id, score."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c % 50 == 0, 5)
