"""Filter interaction audit: what each of five filters removes, in every order, from one pass over the texts.

A document is the set of filters that it fails, a mask of five bits. Every part of the corpus and every label
is summed up by its Walsh-Hadamard transform: 32 sums of the documents' signs, one per parity of the mask.
The transform is inverted exactly to the number of documents per mask, from which every order follows, and
the Shapley sums in closed form: of the 120 orders, 120/k put a given one of a document's k failures first.
"""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, frugal, materialise, texts_of

#: Filters in the order of their bits; the last, a text that stands under a smaller doc_id, needs the whole table.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = math.factorial(len(FILTERS))
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def failures(text: bytes) -> int:
    """Bits of the filters that a text fails by itself: words, distinct words, capitals, marks."""
    words = text.split()  # parts at space and 0x09-0x0D only
    points = len(text) - _count(text, _INNER)
    short = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    shouted = 100 * _count(text, _UPPER) > MOST_UPPER * points
    return short | repeated << 1 | shouted << 2 | (_count(text, _MARKS) > 0) << 3


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def masks(docs: DataFrame, part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask): the filters that each row of docs fails. A null part is an empty string, a null text too.

    A null doc_id is smaller than none and none is smaller than it: such rows neither fail the last filter
    nor make others fail it. Repeated rows share their doc_id, so that none of them does so for another.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bits, keys = [], []
            for text in texts_of(batch):
                bits.append(failures(text or b""))
                keys.append(hashlib.sha256(text or b"").digest())
            yield pa.RecordBatch.from_arrays([*(pa.array(column(batch, c), t) for c, t in (("doc_id", pa.int64()), ("part", pa.string()))), pa.array(bits, pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "part", "bits", "text_key"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    rows = materialise(own.mapInArrow(frugal(run), "doc_id long, part string, bits int, text_key binary"), "failures")
    # both sides are read from written tables, so that the rows of a text with very many copies can be split over tasks
    first = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    first = materialise(first.select("text_key", "first"), "first-of-text")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(first, "text_key", "left").select("doc_id", "part", (F.col("bits") + again * (CELLS >> 1)).alias("mask"))


def _sign(parity: Column, mask: Column) -> Column:
    return 1 - 2 * (F.bit_count(parity.bitwiseAND(mask)) % 2)


def transformed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): per part and label, the signed parity sums of the masks of rows, by parity.

    A document is good (toxic) if any row of labels says quality = 1 (toxic = 1) of its doc_id.
    """
    # documents of one doc_id meet in few rows, and its labels in one, before the two are joined
    counted = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    met = counted.join(known, "doc_id", "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    sums = [F.sum(F.col("n") * _sign(F.lit(s), F.col("mask"))) for s in range(CELLS)]
    return met.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents per mask, by the inverse transform, which is the same but for a factor."""
    each = sums.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    terms = F.transform("sums", lambda w, s: w * _sign(s, F.col("mask")))
    count = F.expr(f"aggregate(terms, 0L, (a, x) -> a + x) div {CELLS}")
    each = each.withColumn("terms", terms).withColumn("n", count)
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


def _steps(spark) -> DataFrame:
    """(filter_order, step, bit, before): all orders; before is the mask of the filters left of the step's own."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            rows.append(("".join(FILTERS[i] for i in order), k + 1, 1 << f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    filter_order's letters are applied from the left; the step's filter is its letter. Counts of documents of
    the part: kept (after the step), removed (by it), redundant (failing it, removed before), unique_fails
    (failing nothing else), good_lost and toxic_lost (removed by it, with that label), shapley (removed by the
    filter, summed over all orders). See `masks` for nulls and repeated rows; other columns of docs are not
    looked at; an empty table has no parts and gives no rows.
    """
    found = cells(transformed(masks(docs, part_col), labels))
    # what a step does depends on its filter and the set before it, not on that set's order: 80 cases of the 600
    filters = F.explode(F.array(*(F.lit(1 << k) for k in range(len(FILTERS)))))
    met = found.withColumn("bit", filters).withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))).filter(F.col("before").bitwiseAND(F.col("bit")) == 0)
    fails, early = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    of = lambda test, n="n": F.sum(F.when(test, F.col(n)).otherwise(0))
    share = F.sum(F.when(fails, F.col("n") * F.expr(f"{ORDERS} div greatest(1, bit_count(mask))")).otherwise(0))
    did = met.groupBy("part", "bit", "before").agg(
        of(~fails & ~early).alias("kept"), of(fails & ~early).alias("removed"), of(fails & early).alias("redundant"), of(F.col("mask") == F.col("bit")).alias("unique_fails"),
        of(fails & ~early, "n_good").alias("good_lost"), of(fails & ~early, "n_toxic").alias("toxic_lost"), share.alias("shapley"),
    )
    steps = _steps(docs.sparkSession)
    return did.join(F.broadcast(steps), ["bit", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_interactions(spark, sf_dir: str) -> DataFrame:
    """Per language, order of the five filters and step: what is kept, removed, redundant, unique and lost, and the Shapley sum."""
    return audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
