"""Toxicity by a classifier chain: categories in a fixed order, each linear model fed the earlier ones' probabilities.

The labels give one flag. The chain's categories are drawn from it and from the words that mark it
in the training rows: `dense` (flagged, with several distinct marked words), `repeated` (flagged, with
several hits) and last `toxic`, the flag itself. While training, the probabilities that a later model
sees come from models that did not see the row (out of fold), nor were the marked words of their targets
chosen by its flag; in scoring from the final models.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORDS, column, row_key, steps, texts_of
from .ftrl import Ftrl, sigmoid
from .quality import labelled_sample

SIZE, FOLDS, EPOCHS, THRESHOLD = 1 << 20, 3, 4, 0.5
CATEGORIES = ("dense", "repeated", "toxic")
#: Lengths of the beginnings of words that are features beside the words: inflected forms share them.
BEGINNINGS = (3, 5, 7)
#: Most labelled rows that training reads, in a fixed pseudo-random order of doc_id.
SAMPLE = 8192
#: A word marks toxicity if so many flagged training rows have it, at so many times the share of the others.
MARK_ROWS, MARK_RATIO = 3, 8.0
DENSE_WORDS, REPEATED_HITS = 2, 2
#: Feature 0 is the bias; 1.. are the probabilities of earlier categories; words start above them.
FIRST_WORD = 1 + len(CATEGORIES)

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class _Words(dict):
    """word -> its row in `table`: features of the bare word and of its beginnings; 0s if there are none."""

    def __init__(self) -> None:
        self.table = np.zeros((1 << 12, 1 + len(BEGINNINGS)), np.int32)

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        if row == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        bare = _EDGES.sub("", word.decode("utf-8", "replace").lower())
        if bare:
            names = [bare, *(f"{n} {bare[:n]}" if len(bare) > n else "" for n in BEGINNINGS)]
            self.table[row] = [n and FIRST_WORD + xxhash.xxh3_64_intdigest(n) % (SIZE - FIRST_WORD) for n in (x or 0 for x in names)]
        else:
            self.table[row] = 0
        return row


def word_features(texts: list[bytes], memo: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words of all texts (a row each), and the number of the text of each."""
    if len(memo) > MEMO_WORDS:  # between steps only: rows handed out in a step stay valid in it
        memo.clear()
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    row = np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(words)), np.int32, int(n.sum()))
    return memo.table[row], np.repeat(np.arange(len(texts)), n)


def _present(index: np.ndarray) -> np.ndarray:
    return np.unique(index[index > 0])


def marked_words(rows: list[np.ndarray], flags: np.ndarray) -> np.ndarray:
    """Features of the words that far more flagged rows than others have."""
    have, without = np.zeros(SIZE), np.zeros(SIZE)
    for own, flag in zip(rows, flags, strict=True):
        (have if flag else without)[own] += 1
    ratio = ((have + 0.5) / (flags.sum() + 1)) / ((without + 0.5) / ((1 - flags).sum() + 1))
    return np.flatnonzero((have >= MARK_ROWS) & (ratio >= MARK_RATIO))


def _fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> Ftrl:
    model = Ftrl(SIZE, alpha=2.0, l1=6.0, l2=0.01)
    earlier = np.arange(1, 1 + extra.shape[1])
    for epoch in range(EPOCHS):
        for k in chosen if epoch % 2 == 0 else chosen[::-1]:
            index = np.concatenate(([0], earlier, rows[k]))
            model.learn(index, np.concatenate(([1.0], extra[k], np.ones(len(rows[k])))), y[k])
    return model


def _probability(model: Ftrl, row: np.ndarray, extra: np.ndarray) -> float:
    w = model.weights_at(np.concatenate((np.arange(1 + len(extra)), row)))
    return float(sigmoid(w[0] + w[1 : 1 + len(extra)] @ extra + w[1 + len(extra) :].sum()))


def targets_of(rows: list[np.ndarray], hits: list[np.ndarray], flags: np.ndarray, seen: np.ndarray) -> dict[str, np.ndarray]:
    """Targets of each category, by the words that mark the flag in the rows that are `seen` only."""
    marks = np.zeros(SIZE, bool)
    marks[marked_words([r for r, s in zip(rows, seen, strict=True) if s], flags[seen])] = True
    distinct = np.array([marks[r].sum() for r in rows])
    repeats = np.array([marks[h].any(axis=1).sum() for h in hits])
    return {"dense": flags * (distinct >= DENSE_WORDS), "repeated": flags * (repeats >= REPEATED_HITS), "toxic": flags}


def fit_chain(rows: list[np.ndarray], hits: list[np.ndarray], flags: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Weights (category, feature) of the final models, learnt in the order of CATEGORIES."""
    targets = targets_of(rows, hits, flags, np.ones(len(rows), bool))
    apart = {fold: targets_of(rows, hits, flags, folds != fold) for fold in range(FOLDS)}
    extra, weights, everyone = np.zeros((len(rows), 0)), [], np.arange(len(rows))
    for name in CATEGORIES:
        weights.append(_fit(rows, extra, targets[name], everyone).weights())
        out_of_fold = np.zeros(len(rows))
        for fold in range(FOLDS if name != CATEGORIES[-1] else 0):
            model = _fit(rows, extra, apart[fold][name], everyone[folds != fold])
            for k in everyone[folds == fold]:
                out_of_fold[k] = _probability(model, rows[k], extra[k])
        extra = np.concatenate((extra, out_of_fold[:, None]), axis=1)
    return np.array(weights, np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> np.ndarray:
    """The chain's weights from a bounded sample of labelled rows, as (category, feature); zeros without labels."""

    def learn(batches):
        import pyarrow as pa

        memo, rows = _Words(), []
        for batch in batches:
            ids, ys = column(batch, "doc_id"), column(batch, "label")
            for at, part in steps(texts_of(batch)):
                index, doc = word_features(part, memo)
                cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                for k in range(len(part)):
                    own = index[cuts[k] : cuts[k + 1]]
                    rows.append((xxhash.xxh3_64_intdigest(str(ids[at + k])), len(own), ys[at + k], _present(own), own))
        if rows:
            rows.sort(key=lambda r: r[:2])
            flags = np.array([r[2] for r in rows], float)
            got = fit_chain([r[3] for r in rows], [r[4] for r in rows], flags, np.array([r[0] % FOLDS for r in rows]))
            for k, w in enumerate(got):
                used = np.flatnonzero(w).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([used.tobytes()]), pa.array([w[used].tobytes()])], names=["k", "index", "weight"])

    weights = np.zeros((len(CATEGORIES), SIZE), np.float32)
    for k, index, weight in labelled_sample(docs, labels, label, most).repartition(1).mapInArrow(learn, "k long, index binary, weight binary").collect():
        weights[k, np.frombuffer(index, np.int32)] = np.frombuffer(weight, np.float32)
    return weights


def probabilities(texts: list[bytes], weights: np.ndarray, memo: dict) -> np.ndarray:
    """(text, category) probabilities; a word counts once a text."""
    index, doc = word_features(texts, memo)
    used = (weights != 0).any(axis=0)
    used[:FIRST_WORD] = False
    hit = used[index]  # most features weigh nothing, and only the others are worth making distinct
    pairs = np.unique(np.repeat(doc, hit.sum(axis=1)) * SIZE + index[hit])
    doc, index = pairs // SIZE, pairs % SIZE
    out = np.zeros((len(texts), len(weights)))
    for k, w in enumerate(weights):
        out[:, k] = sigmoid(w[0] + out[:, :k] @ w[1 : 1 + k] + np.bincount(doc, w[index], len(texts)))
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_key, one probability per category, toxic) for every row of docs.

    Null and empty texts have no words and get the models' bias. Repeated rows, null or repeated
    doc_ids and other columns make no difference; without usable labels every probability is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # len(CATEGORIES) * SIZE floats

    def run(batches):
        import pyarrow as pa

        memo = _Words()
        for batch in batches:
            got = np.concatenate([probabilities(part, shared.value, memo) for _, part in steps(texts_of(batch))] or [np.zeros((0, len(CATEGORIES)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, got.T.copy())], names=["doc_id", "text_key", *names])

    names = [f"p_{c}" for c in CATEGORIES]
    own = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("text"))
    scored = own.mapInArrow(run, "doc_id long, text_key long, " + ", ".join(f"{n} double" for n in names))
    return scored.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the chain's probabilities, toxic (boolean)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels).drop("text_key")
