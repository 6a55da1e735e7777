"""SimHash near-duplicates, found by pigeonring filtering.

Two fingerprints of 64 bits within `distance` bits differ by at most `distance` over the ring of
SEGMENTS segments. By the pigeonring principle some start exists from which every chain of
consecutive segments stays within its proportional budget, floor(length * distance / SEGMENTS).
With distance < SEGMENTS the first segment is then equal and the second differs in one bit at
most, so that one half of it is equal too: start, first segment and that half are the join key
(for very many fingerprints, pieces of the third segment as well).
Inside a bucket the longer chains are required in turn, then the full distance.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, frugal, materialise, restored, row_key, session_partitions, steps, texts_of
from .graph import components

SEED, SHINGLE_WORDS, DISTANCE = 42, 4, 4
#: Bits of the ring's segments; their number must exceed the distance.
WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 512
#: Beyond so many distinct fingerprints, join keys are those of chains of three segments (25 keys of 24 bits
#: or more each) and not of two (10 keys of 18 or more): both are exact, what differs is the pairs compared.
DEEPER = 1 << 24
#: Runs of at least so many fingerprints are compared as a matrix and emit a spanning forest only.
DENSE = 48
_STARTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS)))


def fingerprints_of(texts: list[bytes], n_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprint of each text: bit b is 1 if it is 1 in over half of the hashes of its shingles."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z only, and parts at space and 0x09-0x0D only
        joined = b" ".join(words)
        if len(words) <= n_words:
            own = [digest(joined, SEED)] if words else []
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            begins = np.concatenate(([0], ends[:-n_words])).tolist()
            own = [digest(joined[a:b], SEED) for a, b in zip(begins, (ends[n_words - 1 :] - 1).tolist(), strict=True)]
        counts[k] = len(own)
        hashes += own
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = _majority(np.array(hashes, np.uint64), np.concatenate(([0], np.cumsum(counts[full])[:-1])), counts[full])
    return out


def _majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    # 0/1 bytes of the bits add up eight to a word, at most 255 rows at a time so that no byte overflows
    pieces = (counts + 254) // 255
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits.view(np.uint64), cuts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    ones = np.add.reduceat(sums, first, axis=0)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) of every row; null and wordless texts have fp 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), texts_of(batch)
            fps = np.concatenate([fingerprints_of(part) for _, part in steps(texts)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    own = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(frugal(run), "doc_id long, text_key long, fp long")


def bucket_keys(fp: np.ndarray, depth: int = 2) -> np.ndarray:
    """The join keys of each fingerprint (its columns): start and case above bit 32, equal pieces of the chain below.

    depth 2: the second segment differs in one bit at most, so one half of it is equal.
    depth 3: either the second segment is equal, or it takes one of two differences, so that a half of
    it and a half of the third are equal.
    """

    def cut(segment: int) -> list[tuple[np.ndarray, int]]:
        width, low = WIDTHS[segment], WIDTHS[segment] // 2
        whole = (fp >> np.uint64(_STARTS[segment])) & np.uint64((1 << width) - 1)
        return [(whole, width), (whole & np.uint64((1 << low) - 1), low), (whole >> np.uint64(low), width - low)]

    out = []
    for i in range(len(WIDTHS)):
        first, second, third = (cut((i + k) % len(WIDTHS)) for k in range(3))
        cases = [(second[1],), (second[2],)] if depth == 2 else [(second[0],), *((a, b) for a in second[1:] for b in third[1:])]
        for case, parts in enumerate(cases):
            key = first[0][0]
            for value, width in parts:
                key = key << np.uint64(width) | value
            out.append(np.uint64((8 * i + case) << 32) | key)
    return np.stack(out, axis=1).view(np.int64)


def chain_masks(start: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask of the chain of l segments from `start`, its budget) for l = 2 up to the whole ring."""
    m, mask, out = len(WIDTHS), 0, []
    for length in range(1, m + 1):
        k = (start + length - 1) % m
        mask |= ((1 << WIDTHS[k]) - 1) << _STARTS[k]
        out.append((mask, length * distance // m))
    return out[1:]


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which pairs pass every chain from their start and then the whole distance."""
    x = a ^ b
    masks = [chain_masks(i) for i in range(len(WIDTHS))]
    ok = np.ones(x.shape, bool)
    for step in range(len(WIDTHS) - 1):
        mask = np.array([m[step][0] for m in masks], np.uint64)[start]
        ok &= np.bitwise_count(x & mask) <= masks[0][step][1]
    return ok


def links_in_buckets(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Linking pairs (rows of two fingerprints) among rows sorted by key; dense runs give a spanning forest."""
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(cut, len(keys)))
    start_of = (keys >> 32 & 63) >> 3
    found = []
    for c, n in zip(cut[size >= DENSE], size[size >= DENSE], strict=True):
        f = np.unique(fps[c : c + n])
        near = linked(f[:, None], f[None, :], int(start_of[c]))
        label = np.arange(len(f))
        while True:
            down = np.where(near, label[None, :], len(f)).min(axis=1)
            down = np.minimum(down[down], label)
            if (down == label).all():
                break
            label = down
        found.append(np.stack((f, f[label]), axis=1)[label != np.arange(len(f))])
    rest = np.repeat(size < DENSE, size)
    left = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(cut, size)) - 1  # rows after this one in its run
    at = np.flatnonzero(rest & (left > 0))
    shift = 1
    while len(at):
        a, b = fps[at], fps[at + shift]
        ok = linked(a, b, start_of[at]) & (a != b)
        found.append(np.stack((a[ok], b[ok]), axis=1))
        shift += 1
        at = at[left[at] >= shift]
    return np.concatenate(found or [np.zeros((0, 2), np.uint64)])


def links(distinct_fps: DataFrame, depth: int = 2) -> DataFrame:
    """Pairs (u, v) of different fingerprints within DISTANCE bits; enough of them to keep every component whole.

    Either depth of the join key finds all; the deeper has more keys, and fewer fingerprints under each.
    """
    spark = distinct_fps.sparkSession

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = bucket_keys(fp, depth)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp.view(np.int64), keys.shape[1]))], names=["key", "fp"])

    def run(batches):
        import pyarrow as pa

        held = np.zeros((0, 4), np.int64)
        out = lambda p: pa.RecordBatch.from_arrays([pa.array(p[:, 0].view(np.int64)), pa.array(p[:, 1].view(np.int64))], names=["u", "v"])
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            held = np.concatenate((held, rows))
            ends = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1))
            if len(ends):
                ready, held = held[: ends[-1] + 1], held[ends[-1] + 1 :]
                yield out(_pairs(ready))
        if len(held):
            yield out(_pairs(held))

    def _pairs(rows: np.ndarray) -> np.ndarray:
        # runs of one (key, block pair): number them in the bits above the key
        new = np.concatenate(([0], (rows[1:, :3] != rows[:-1, :3]).any(axis=1).cumsum()))
        keys = (new.astype(np.int64) << 40) | rows[:, 0]
        return links_in_buckets(keys, np.ascontiguousarray(rows[:, 3]).view(np.uint64))

    rows = distinct_fps.select("fp").mapInArrow(keyed, "key long, fp long")
    hot = rows.groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.join(hot, "key", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    dealt = dealt.repartition(session_partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(frugal(run), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id) for every row of docs, repeated rows included.

    Rows link when their fingerprints differ in DISTANCE bits or fewer; component_id is the smallest
    doc_id reachable. Null and empty texts have fingerprint 0 and link like any other. A null doc_id
    never names a component unless all of its rows have null. Other columns are not looked at.
    """
    own = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    reached = components(links(distinct, 2 if distinct.count() <= DEEPER else 3))
    member = distinct.join(reached.select(F.col("node").alias("fp"), "component"), "fp", "left")
    member = member.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialise(member.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    member = member.join(named, "component").select("fp", "component_id")
    return own.join(member, "fp").select("doc_id", "text_key", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs less all but one of each near-duplicate group; the smallest doc_id stays.

    Of rows that share that doc_id too, the one with the smallest text_key stays; of those that share the text as
    well, the one whose columns, as JSON, have the smallest hash, and of wholly repeated rows one. Keeps the
    columns of docs.
    """
    groups = materialise(near_duplicates(docs), "near-duplicates")
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("keep_id"), F.col("best.text_key").alias("keep_key")).distinct()
    kept = carried(docs).join(best, F.expr("id <=> keep_id and key = keep_key"), "left_semi")
    again = groups.groupBy("doc_id", "text_key").count().filter("count > 1")
    if not again.isEmpty():
        kept = materialise(kept.withColumn("order", F.sha2(F.to_json("doc"), 256)), "kept")
        least = materialise(kept.groupBy(F.col("id").alias("least_id"), F.col("key").alias("least_key")).agg(F.min("order").alias("least")), "least-of-rows")
        kept = kept.join(least, F.expr("id <=> least_id and key = least_key and `order` = least"), "left_semi").dropDuplicates(["id", "key"])  # rows equal in all columns
    return restored(kept, docs)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
