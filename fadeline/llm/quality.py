"""Quality classifier: logistic regression on hashed word n-grams, learnt with FTRL, scored as sparse dot products.

Two streams of tokens feed the n-grams: the words themselves, and their shapes (letters, digits and
runs folded, a word that repeats the one before it marked), which carry over to words never seen.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MEMO_WORDS, column, frugal, mix, row_key, steps, texts_of
from .ftrl import Ftrl, sigmoid

#: Hash space of the features; feature 0 is the bias.
SIZE = 1 << 18
#: Most labelled rows that training reads, in a fixed pseudo-random order of doc_id, and the bytes of text after which it reads no further row.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
EPOCHS, SCALE, THRESHOLD = 3, 6.0, 0.3
#: (stream, n) of the n-grams; streams: 0 words, 1 shapes.
GRAMS = ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3))

_SHAPES = bytes(97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_LOW = np.uint64(0xFFFFF)


class _Tokens(dict):
    """word -> 44 bits of its hash and 20 of its shape's."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPES))
        v = self[word] = xxhash.xxh3_64_intdigest(word) & ~0xFFFFF | xxhash.xxh3_64_intdigest(shape) & 0xFFFFF
        return v


def features(texts: list[bytes], memo: dict, size: int = SIZE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind of n-gram: indices end to end, and where each text's begin (one more at the end)."""
    words = [t.split() for t in texts]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    both = np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(starts[-1]))
    shape = both & _LOW
    if len(both) > 1:
        inside = np.ones(len(both) - 1, bool)
        inside[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(both))] - 1] = False
        shape[1:][(both[1:] == both[:-1]) & inside] = np.uint64(1 << 21)
    streams, lengths = (both, shape), np.diff(starts)
    indices, begins = [], []
    for kind, (stream, n) in enumerate(GRAMS):
        h = np.full(max(0, len(both) - n + 1), np.uint64(0x9E3779B97F4A7C15 * (kind + 1) & (2**64 - 1)))
        for k in range(n):
            h = mix(h + streams[stream][k : k + len(h)])
        own = np.maximum(lengths - n + 1, 0)
        begin = np.concatenate(([0], np.cumsum(own)))
        at = np.repeat(starts[:-1] - begin[:-1], own) + np.arange(begin[-1])
        indices.append((h[at] % np.uint64(size - 1)).astype(np.int32) + 1)
        begins.append(begin)
    return indices, begins


def sparse_rows(texts: list[bytes], memo: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct indices, values) of each text; a value is SCALE times the share among the text's n-grams of that kind."""
    indices, begins = features(texts, memo)
    out = []
    for k in range(len(texts)):
        parts, values = [np.zeros(1, np.int32)], [np.ones(1)]
        for index, begin in zip(indices, begins, strict=True):
            own, count = np.unique(index[begin[k] : begin[k + 1]], return_counts=True)
            parts.append(own)
            values.append(count * (SCALE / max(1, begin[k + 1] - begin[k])))
        where, back = np.unique(np.concatenate(parts), return_inverse=True)
        out.append((where, np.bincount(back, np.concatenate(values)).astype(np.float32)))
    return out


def scores(texts: list[bytes], weights: np.ndarray, memo: dict) -> np.ndarray:
    """Probability of label 1 for each text: the sparse dot product with the weights, all texts at once."""
    total = np.full(len(texts), float(weights[0]))
    for index, begin in zip(*features(texts, memo), strict=True):
        if len(index):
            sums = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
            n = np.diff(begin)
            total += SCALE * (sums[begin[1:]] - sums[begin[:-1]]) / np.maximum(n, 1)
    return sigmoid(total)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled training rows: crc32(doc_id as text) mod 5 is not 0.

    Rows without a label, or with a null one, are not drawn; of conflicting labels the larger counts, and of
    rows that share a doc_id the one whose text has the least hash. Rows are taken whole, in a fixed order, until
    their texts have `most_bytes`: one task, which learns from them, holds no more than that and one text.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    chosen = chosen.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    met = own.join(F.broadcast(chosen), "doc_id")  # at most `most` pairs of numbers
    one = met.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0))
    return one.select("doc_id", "least.text", "label").withColumn("before", before).filter(F.col("before") < most_bytes).drop("before")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> np.ndarray:
    """Weights learnt by one task from the bounded sample; zeros if nothing is labelled."""

    def learn(batches):
        import pyarrow as pa

        memo, rows = _Tokens(), []
        for batch in batches:
            ids, ys = column(batch, "doc_id"), column(batch, "label")
            for at, part in steps(texts_of(batch)):
                rows += [(xxhash.xxh3_64_intdigest(str(ids[at + k])), ys[at + k], *row) for k, row in enumerate(sparse_rows(part, memo))]
        rows.sort(key=lambda r: (r[0], len(r[2])))
        model = Ftrl(SIZE, alpha=0.3, l1=0.02, l2=0.1)
        for epoch in range(EPOCHS):
            for _, y, i, x in rows[:: -1 if epoch % 2 else 1]:
                model.learn(i, x.astype(np.float64), float(y))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights().tobytes()])], names=["weights"])

    drawn = labelled_sample(docs, labels, label, most)
    got = drawn.repartition(1).mapInArrow(frugal(learn), "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros(SIZE, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, text_key, score) of every row; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # SIZE floats, whatever the input

    def run(batches):
        import pyarrow as pa

        memo = _Tokens()
        for batch in batches:
            got = [scores(part, shared.value, memo) for _, part in steps(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(got or [np.zeros(0)]))], names=["doc_id", "text_key", "score"])

    own = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(frugal(run), "doc_id long, text_key long, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least `threshold`, all columns kept; rows are scored where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        import pyarrow as pa

        memo = _Tokens()
        for batch in batches:
            got = [scores(part, shared.value, memo) for _, part in steps(texts_of(batch))]
            yield batch.filter(pa.array(np.concatenate(got or [np.zeros(0)]) >= threshold))

    return docs.mapInArrow(frugal(run), docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if the score is at least 0.3)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return score(docs, train(docs, labels)).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
