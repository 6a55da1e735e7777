"""Exact quantiles of whole tables, without sorting one in a task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one task sorts; of more, a sketch narrows down where the wanted one lies.
LARGEST_SORT = 1 << 17
#: Accuracy of the sketch, and how far around the wanted rank, in shares, its two bounds are taken.
ACCURACY, AROUND = 10_000, 3e-4


def kth(rows: DataFrame, x: str, n: int, k: int, largest: int = LARGEST_SORT) -> float:
    """The k-th least, from 0, of the n values of x, none of which is null.

    Round by round two bounds out of a sketch split what is left into below, equal, between and above,
    whose exact counts say where the k-th is; the sketch decides how fast, never what. Each round reads
    the table once; the driver holds a few numbers.
    """
    low, high = -math.inf, math.inf
    while n > largest:
        p = (k + 0.5) / n
        inside = rows.filter((F.col(x) > low) & (F.col(x) < high))
        a, b = inside.agg(F.percentile_approx(x, [max(0.0, p - AROUND), min(1.0, p + AROUND)], ACCURACY)).first()[0]
        is_ = lambda c: F.count_if(c)
        below, at_a, between, at_b = inside.agg(is_(F.col(x) < a), is_(F.col(x) == a), is_((F.col(x) > a) & (F.col(x) < b)), is_(F.col(x) == b)).first()
        at_b = 0 if a == b else at_b
        if k < below:
            high, n = a, below
        elif k < below + at_a:
            return a
        elif k < below + at_a + between:
            low, high, k, n = a, b, k - below - at_a, between
        elif k < below + at_a + between + at_b:
            return b
        else:
            seen = below + at_a + between + at_b
            low, k, n = b, k - seen, n - seen
    inside = rows.filter((F.col(x) > low) & (F.col(x) < high)) if (low, high) != (-math.inf, math.inf) else rows
    return inside.agg(F.get(F.sort_array(F.collect_list(x)), F.lit(k))).first()[0]  # `largest` values at most


def quantiles(rows: DataFrame, wanted: dict[str, tuple[Column, float]], largest: int = LARGEST_SORT) -> dict[str, float | None]:
    """name -> linearly interpolated quantile q of a column's finite values, of (column, q); None without a value."""
    own = rows.select(*(c.cast("double").alias(name) for name, (c, _) in wanted.items()))
    real = {name: F.when(~F.isnan(name) & (F.abs(name) < math.inf), F.col(name)) for name in wanted}
    counts = own.agg(*(F.count(c).alias(name) for name, c in real.items())).first()
    if max(counts) <= largest:
        return own.agg(*(F.percentile(c, F.lit(wanted[name][1])).alias(name) for name, c in real.items())).first().asDict()
    out = {}
    for name, (_, q) in wanted.items():
        kept, at = own.select(real[name].alias(name)).dropna(), q * (counts[name] - 1)
        if not counts[name]:
            out[name] = None
            continue
        a = kth(kept, name, counts[name], math.floor(at), largest)
        b = a if at == math.floor(at) else kth(kept, name, counts[name], math.floor(at) + 1, largest)
        out[name] = a + (b - a) * (at - math.floor(at))
    return out
