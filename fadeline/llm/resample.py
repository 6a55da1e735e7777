"""Target-distribution importance resampling on hashed n-grams, enumerated by word-id suffix arrays.

Every partition is read in blocks of bounded size. A block's words become ids, its suffixes are sorted, and
the lengths of common prefixes of neighbours cut the order into runs, one run per distinct n-gram. An n-gram
is hashed once for its run; the bucket is then scattered back to all places where it stands.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked_together
from .common import carried, column, frugal, materialise, row_key, steps, texts_of

MOST_N, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Bytes of text whose suffixes are sorted together; a longer text is a block of its own.
BLOCK_BYTES = 8_000_000

#: Letters and digits of ASCII and all other code points are words, A-Z lower-cased; what is between is space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the ids of all words end to end (from 1), and where each text starts (one more at the end)."""
    known: dict[bytes, int] = {}
    parts = [[known.setdefault(w, len(known) + 1) for w in words_of(t)] for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    kind = np.uint16 if len(known) < 1 << 16 else np.uint32  # sorts by radix if it can
    ids = np.fromiter(itertools.chain.from_iterable(parts), kind, int(starts[-1]))
    return list(known), ids, starts


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lcp, length): suffixes that end with their text, or after `depth` words, in sorted order.

    lcp[j] is the common prefix of the suffixes at j - 1 and j of that order (0 at the first), length[j] the
    length of the one at j.
    """
    n = len(ids)
    columns = []
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)
    for k in range(depth):
        own = np.zeros(n, ids.dtype)
        own[: max(0, n - k)] = ids[k:]
        own[left <= k] = 0  # the text has ended
        columns.append(own)
    order = np.argsort(columns[0], kind="stable") if depth == 1 else np.lexsort(columns[::-1])
    lcp, same = np.zeros(n, np.int32), np.ones(max(0, n - 1), bool)
    for own in columns:
        a = own[order]
        same &= (a[1:] == a[:-1]) & (a[1:] != 0)
        lcp[1:] += same
    return order, lcp, np.minimum(left[order], depth)


def bucketed(texts: list[bytes], most_n: int = MOST_N, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of all n-grams of each text, by n and then place; and the number of words of each text."""
    words, ids, starts = numbered_words(texts)
    order, lcp, length = suffix_array(ids, starts, most_n)
    at = []  # for each n the bucket of the n-gram that begins at a word
    for n in range(1, most_n + 1):
        whole = np.flatnonzero(length >= n)
        begins = lcp[whole] < n
        firsts = order[whole[begins]]
        grams = (b" ".join([words[i - 1] for i in ids[p : p + n]]) for p in firsts)
        run = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int64, len(firsts))
        own = np.zeros(len(ids), np.int64)
        own[order[whole]] = run[np.cumsum(begins) - 1]
        at.append(own)
    sizes = np.diff(starts)
    out = [np.concatenate([at[n - 1][a : max(a, b - n + 1)] for n in range(1, most_n + 1)]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return out, sizes


def _width(buckets: int) -> type:
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def hashed(rows: DataFrame, most_n: int, buckets: int) -> DataFrame:
    """(doc_id, text_key, n_words, grams, counts) of rows (doc_id, text_key, text): grams are a row's buckets as bytes.

    Each task ends with one more row, which alone has counts: of every bucket, over the task's rows.
    """
    names, kind = ["doc_id", "text_key", "n_words", "grams", "counts"], _width(buckets)

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            ids, keys = (column(batch, c) for c in ("doc_id", "text_key"))
            for at, part in steps(texts_of(batch), BLOCK_BYTES):
                found, sizes = bucketed(part, most_n, buckets)
                total += np.bincount(np.concatenate(found), minlength=buckets)
                rows = (ids[at : at + len(part)], keys[at : at + len(part)], sizes, [g.astype(kind).tobytes() for g in found], [None] * len(part))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, total), types, strict=True)], names=names)

    return rows.mapInArrow(frugal(run), "doc_id long, text_key long, n_words long, grams binary, counts array<long>")


def totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over what `hashed` gave: tasks' counts are summed in Spark, one number a bucket comes back."""
    each = rows.filter("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in each.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over its share of the corpus, both with one added."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size)))) for s, t in pairs], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """The Gumbel part of a score: from a hash of seed and doc_id; a null id is hashed as no digits."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, most_n: int = MOST_N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, n_features, weight, score, rank) of every row of docs; rank is null if it is not drawn.

    weight is the floored mean gain of a text's n-grams of up to most_n words (0 without any) towards the texts
    of target; score adds Gumbel noise. Of the N rows of at least least_words words, the floor(percent * N / 100)
    best are drawn, ties to smaller doc_ids, null ids last, then by the texts' hashes; repeated rows are drawn
    each for itself. Null texts count as empty, other columns are not looked at, empty tables draw nothing.
    """
    own = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("text"))
    rows = materialise(hashed(own, most_n, buckets), "grams")
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.col("text").cast("binary").alias("text"))
    # a gain per bucket, whatever the input
    gain, kind = gains(totals(rows, buckets), totals(hashed(aim, most_n, buckets), buckets)), _width(buckets)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            ids, weight, n = column(batch, "doc_id"), [], []
            for grams in column(batch, "grams"):
                own = gain[np.frombuffer(grams, kind)]
                n.append(len(own))
                weight.append(int(own.sum()) // len(own) if len(own) else 0)
            total = [w + noise(i, seed) for w, i in zip(weight, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in (n, weight, total))], names=["doc_id", "text_key", "n_words", "n_features", "weight", "score"])

    scored = rows.filter("counts is null").select("doc_id", "text_key", "n_words", "grams").mapInArrow(frugal(score), "doc_id long, text_key long, n_words long, n_features long, weight long, score long")
    scored = materialise(scored, "scores")
    enough = scored.filter(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    placed = ranked_together(enough, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_key")], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    short = scored.filter(F.col("n_words") < least_words)
    names = ["doc_id", "text_key", "n_features", "weight", "score"]
    return placed.select(*names, rank.alias("rank")).unionByName(short.select(*names, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that `resample` draws, all columns kept; rows equal in doc_id and text stay if one of them is drawn."""
    best = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).distinct()
    own = carried(docs)
    met = own.join(materialise(best, "drawn"), own["id"].eqNullSafe(F.col("own_id")) & (own["key"] == F.col("own_key")), "left_semi")
    return met.select("doc.*")


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank towards the benchmark texts; undrawn ranks null."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
