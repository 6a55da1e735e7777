"""Train, validation and test: chronological and gapped splits, seeded permutations of keys, whole groups and domains.

`permuted` and what builds on it run in the engine for any number of keys. `shuffled_assignment` and its kin give the
shuffle of Python's own generator for a few names on the driver, where an assignment must be that of an earlier run.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .ranking import numbered_by_ranges, ranked_together, running_total

SPLITS = ("train", "val", "test")


def counts(n: Column, val: float = 0.15, test: float = 0.15, gap: int = 0) -> tuple[Column, Column, Column]:
    """(train, val, test) sizes of n samples in order, 2 * gap reserved; null if fewer than three are left.

    Sizes round half to even. If nothing is left to train on: one, one and the rest.
    """
    left = n - 2 * gap
    part = lambda r: F.greatest(F.lit(1), F.rint(left * F.lit(r)).cast("int"))
    n_val, n_test = part(val), part(test)
    train = left - n_val - n_test
    short = train < 1
    ok = left >= 3
    return (F.when(ok, F.when(short, 1).otherwise(train)), F.when(ok, F.when(short, 1).otherwise(n_val)), F.when(ok, F.when(short, left - 2).otherwise(n_test)))


def chronological(samples: DataFrame, val: float = 0.15, test: float = 0.15, gap: int = 0, key: str = "file", order: tuple[str, ...] = ("target_cycle", "input_end_cycle")) -> DataFrame:
    """samples with `segment`: train, [gap_train_val,] val, [gap_val_test,] test in order inside each file.

    Null for files with too few samples. One window by file; no join.
    """
    w = W.partitionBy(key)
    out = samples.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w).cast("int"))
    return out.withColumn("segment", _segment(val, test, gap)).drop("place", "n")


def chronological_by_ranges(samples: DataFrame, val: float = 0.15, test: float = 0.15, gap: int = 0, key: str = "file", order: tuple[str, ...] = ("target_cycle", "input_end_cycle")) -> DataFrame:
    """`chronological` for files that hold a large share of all samples: places are counted by ranges, sizes joined back."""
    laid = checkpointed(numbered_by_ranges(samples, (key,), list(order)))
    sizes = laid.groupBy(F.col(key).alias("_of")).agg(F.count("*").cast("int").alias("n"))
    met = laid.join(sizes, F.col(key).eqNullSafe(F.col("_of"))).drop("_of")
    return met.withColumn("segment", _segment(val, test, gap)).drop("place", "n")


def _segment(val: float, test: float, gap: int) -> Column:
    """The segment of a sample at `place` of `n`."""
    n_train, n_val, _ = counts(F.col("n"), val, test, gap)
    at = F.col("place")
    return F.when(n_train.isNull(), None).when(at <= n_train, "train").when(at <= n_train + gap, "gap_train_val").when(at <= n_train + gap + n_val, "val").when(at <= n_train + 2 * gap + n_val, "gap_val_test").otherwise("test")


def split_report(split: DataFrame, gap: int = 0, key: str = "file", cycle: str = "target_cycle") -> DataFrame:
    """(key, status, reason, total_samples, <segment>_samples, _first and _last cycle): one row per file, skipped ones too."""
    names = ("train", "gap_train_val", "val", "gap_val_test", "test")
    of = lambda name: F.col("segment") == name
    parts = [x for s in names for x in (F.count_if(of(s)).alias(f"{s}_samples"), F.min(F.when(of(s), F.col(cycle))).alias(f"{s}_first"), F.max(F.when(of(s), F.col(cycle))).alias(f"{s}_last"))]
    out = split.groupBy(key).agg(F.count("*").alias("total_samples"), F.count("segment").alias("used"), *parts)
    used = F.col("used") > 0
    why = F.when(~used, F.concat(F.lit("needs "), F.lit(str(3 + 2 * gap)), F.lit(" samples, has "), F.col("total_samples").cast("string")))
    return out.withColumn("status", F.when(used, "used").otherwise("skipped")).withColumn("reason", why).drop("used")


def segment_ranges(split: DataFrame, key: str = "file", cycle: str = "target_cycle") -> DataFrame:
    """(key, segment, n, first_cycle, last_cycle)."""
    return split.filter("segment is not null").groupBy(key, "segment").agg(F.count("*").alias("n"), F.min(cycle).alias("first_cycle"), F.max(cycle).alias("last_cycle"))


def manifest(samples: DataFrame, split: str = "split", horizon: str = "horizon", key: str = "file") -> DataFrame:
    """(split, horizon, key, n): the keys of each split with their samples, a row each, so that a split may hold any number."""
    return samples.groupBy(split, horizon, key).agg(F.count("*").alias("n"))


def manifest_sizes(samples: DataFrame, split: str = "split", horizon: str = "horizon", key: str = "file") -> DataFrame:
    """(split, horizon, n, n_keys): samples and distinct keys of each split."""
    return manifest(samples, split, horizon, key).groupBy(split, horizon).agg(F.sum("n").alias("n"), F.count(key).alias("n_keys"))


def labels_by_split(samples: DataFrame, *columns: str, split: str = "split") -> DataFrame:
    """(split, <column>s...): the distinct values of label columns in each split, sorted. Labels (domains, conditions) are few."""
    return samples.groupBy(split).agg(*(F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in columns))


def _sizes(n: int, val: float, test: float) -> tuple[int, int, int]:
    n_test, n_val = max(1, round(n * test)), max(1, round(n * val))
    n_train = n - n_val - n_test
    return (n_train, n_val, n_test) if n_train >= 1 else (1, 1, n - 2)


def shuffled_assignment(names: list[str], seed: int, val: float = 0.15, test: float = 0.15, least: int = 3) -> dict[str, str]:
    """name -> split by a seeded shuffle of the names as given. For files and conditions: few, on the driver."""
    if len(names) < least:
        raise ValueError(f"needs {least} names, has {len(names)}")
    order = list(names)
    random.Random(seed).shuffle(order)
    n_train, n_val, _ = _sizes(len(order), val, test)
    return {name: SPLITS[(k >= n_train) + (k >= n_train + n_val)] for k, name in enumerate(order)}


def by_file(files: list[str], seed: int, val: float = 0.15, test: float = 0.15) -> dict[str, str]:
    return shuffled_assignment(files, seed, val, test)


def by_condition(condition_of: dict[str, str], seed: int, val: float = 0.15, test: float = 0.15) -> dict[str, str]:
    """file -> split; all files of a condition go together, and there are three conditions at least."""
    split = shuffled_assignment(sorted(set(condition_of.values())), seed, val, test)
    return {file: split[c] for file, c in condition_of.items()}


def by_domain(domain_of: dict[str, str], seed: int, held_out: str | None = None) -> dict[str, str]:
    """file -> split: one domain is held out and halved into val and test, all others train.

    Without a name (its case does not matter), the domain with most files, two at least, is held out;
    of several the first after a seeded shuffle.
    """
    groups: dict[str, list[str]] = {}
    for file, name in domain_of.items():
        groups.setdefault(name, []).append(file)
    if held_out is None:
        largest = max((len(f) for f in groups.values()), default=0)
        ties = sorted(d for d, f in groups.items() if len(f) == largest)
        random.Random(seed).shuffle(ties)
        chosen = ties[0] if ties else None
    else:
        chosen = next((d for d in groups if d.lower() == held_out.lower()), None)
    own = list(groups.get(chosen, ()))
    if len(own) < 2 or len(own) == len(domain_of):
        raise ValueError("the domain held out needs two files, and others must be left to train on")
    random.Random(seed).shuffle(own)
    half = max(1, len(own) // 2)
    place = {f: "val" if k < half else "test" for k, f in enumerate(own)}
    return {f: place.get(f, "train") for f in domain_of}


def by_battery(ids: list[str], seed: int, val: float = 0.2, test: float = 0.2) -> dict[str, str]:
    """Battery-level 60/20/20 on sorted ids."""
    return shuffled_assignment(sorted(ids), seed, val, test)


def assign(samples: DataFrame, assignment: dict[str, str], key: str = "file") -> DataFrame:
    """samples with `split`; the few names of the assignment are a table that is joined. Unassigned rows are left out."""
    if not assignment:
        return samples.withColumn("split", F.lit(None).cast("string")).limit(0)
    table = samples.sparkSession.createDataFrame(list(assignment.items()), f"{key} string, split string")
    return samples.join(table, key)


def permuted(keys: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """(key, place): distinct keys, not null, in a pseudo-random order of the seed, from 1: by the SHA-256 of seed and key.

    The order depends on seed and keys alone, not on how the keys lie; a subset keeps its order. Sorted by ranges.
    """
    own = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    own = own.withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")), 256))
    return ranked_together(own, [F.col("_hash"), F.col(key)], name).drop("_hash")


def _by_place(n: int, val: float, test: float) -> Column:
    n_train, n_val, _ = _sizes(n, val, test)
    return F.when(F.col("place") <= n_train, SPLITS[0]).when(F.col("place") <= n_train + n_val, SPLITS[1]).otherwise(SPLITS[2])


def random_split(keys: DataFrame, key: str, seed: int, val: float = 0.15, test: float = 0.15, least: int = 3) -> DataFrame:
    """(key, split) of distinct keys: the permutation cut at the rounded sizes. Raises for fewer than `least` keys."""
    laid = permuted(keys, key, seed)
    n = laid.count()
    if n < least:
        raise ValueError(f"needs {least} keys, has {n}")
    return laid.select(key, _by_place(n, val, test).alias("split"))


def group_split(rows: DataFrame, key: str, group: str, seed: int, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """(key, group, split): whole groups, three at least, are split by their number; keys go with their group."""
    groups = random_split(rows, group, seed, val, test)
    return rows.select(key, group).dropna().distinct().join(groups, group).select(key, group, "split")


def quota_split(rows: DataFrame, key: str, group: str, seed: int, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """(key, group, split): whole groups, dealt by size. In permuted order groups fill test, then val, up to their share of keys; the others train.

    A split overshoots its share by less than its last group. Raises if nothing is left for one of the splits.
    """
    own = rows.select(key, group).dropna().distinct()
    sizes = own.groupBy(group).agg(F.count("*").alias("n")).join(permuted(rows, group, seed), group)
    laid = running_total(sizes, (), ["place"], F.col("n"), "upto")
    total = own.count()
    n_test, n_val = max(1, round(total * test)), max(1, round(total * val))
    # what a group finds before it decides: val begins where test has ended, with whole groups
    before = F.col("upto") - F.col("n")
    tested = laid.filter(before < n_test).agg(F.max("upto")).first()[0] or 0
    dealt = laid.withColumn("split", F.when(before < n_test, SPLITS[2]).when(before < tested + n_val, SPLITS[1]).otherwise(SPLITS[0])).select(group, "split")
    if lacking := set(SPLITS) - {r[0] for r in dealt.select("split").distinct().collect()}:
        raise ValueError(f"no group is left for {', '.join(sorted(lacking))}")
    return own.join(dealt, group).select(key, group, "split")


def domain_split(rows: DataFrame, key: str, domain: str, seed: int, held_out: str | None = None) -> DataFrame:
    """(key, domain, split): one domain is held out and its permuted keys are halved into val and test, the larger half; all others train.

    Without a name (its case does not matter), the domain with most keys is held out, of several the first in
    permuted order. Raises if it has fewer than two keys, or no other is left.
    """
    own = rows.select(key, domain).dropna().distinct()
    sizes = own.groupBy(domain).agg(F.count("*").alias("n"))
    if held_out is None:
        first = sizes.orderBy(F.desc("n"), F.sha2(F.concat(F.lit(f"{seed}/"), F.col(domain).cast("string")), 256), domain).first()
    else:
        first = sizes.filter(F.lower(F.col(domain).cast("string")) == held_out.lower()).orderBy(domain).first()
    if first is None or first["n"] < 2 or sizes.filter(F.col(domain) != first[domain]).isEmpty():
        raise ValueError("the domain held out needs two keys, and others must be left to train on")
    out = F.col(domain) == F.lit(first[domain])
    half = max(1, first["n"] // 2)
    places = permuted(own.filter(out), key, seed).withColumn("split", F.when(F.col("place") <= half, SPLITS[1]).otherwise(SPLITS[2])).drop("place")
    tested = own.filter(out).join(places, key)
    return own.filter(~out).withColumn("split", F.lit(SPLITS[0])).unionByName(tested.select(key, domain, "split"))


def battery_split(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, split): 60/20/20 of distinct keys."""
    return random_split(rows, key, seed, 0.2, 0.2)


def overlaps(split: DataFrame, key: str = "file", name: str = "split") -> DataFrame:
    """(key, splits): the keys that stand in several splits; empty if the split is clean."""
    seen = split.filter(F.col(name).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(name)).alias("splits"))
    return seen.filter(F.size("splits") > 1)


def check_gap(policy: str, gap: int, lookbacks: list[int]) -> None:
    """Raise if the gap is too small; the three policies differ on purpose."""
    most = max(lookbacks)
    ok = {"search": gap >= most - 1, "experiments": gap >= most, "audit": gap >= 20 and most <= 20}[policy]
    if not ok:
        raise ValueError(f"gap {gap} is too small for look-back {most} under the {policy} policy")


def gap_fits(policy: str, gap: Column, lookback: Column) -> Column:
    """check_gap of columns: whether a gap fits a look-back under the policy."""
    return {"search": gap >= lookback - 1, "experiments": gap >= lookback, "audit": (gap >= 20) & (lookback <= 20)}[policy]
