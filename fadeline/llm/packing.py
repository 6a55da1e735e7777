"""Best-fit packing of token sequences: bounded-space online best-fit over a bitset of free spaces.

Every task packs the documents of its own partition as they come, so that texts never move. A fixed
number of bins stays open, and when one more is needed the fullest closes. The pieces of bins that are
still open when a task ends are dealt to fewer tasks and packed again in the same way, in a second and
much smaller round.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, frugal, materialise, texts_of

CAPACITY, END_ID = 2048, 0
#: Bins that a task holds open, in either round.
OPEN_BINS = 1024
#: Tokens that one task of the second round packs.
ROUND_TOKENS = 64_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: The byte-level alphabet shows these bytes as themselves and the others from U+0100 on.
PLAIN_BYTES = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]

_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> ids by the tokenizer file at `path`, added tokens found in the text included, none put around it.

    Byte-level BPE files whose ids are ranks run in tiktoken, which gives the same ids faster; texts that
    hold an added token's string, and any other file, run in tokenizers.
    """
    if path not in _encoders:
        _encoders[path] = _ranked(path) or _general(path)
    return _encoders[path]


def _general(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or not before.get("use_regex", True):
        return None
    others = iter(range(256, 512))
    to_byte = {chr(b if b in PLAIN_BYTES else next(others)): b for b in range(256)}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    plain, whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, []

    def encode(text: str) -> list[int]:
        if not any(x in text for x in special):
            return plain(text)
        if not whole:
            whole.append(_general(path))  # large, and hardly ever needed
        return whole[0](text)

    return encode


class OpenBins:
    """A fixed number of open bins. Bit f of `free` says that some open bin has f tokens of space left."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free, self.count, self.begun = 0, 0, 0
        self.at: dict[int, list[list]] = defaultdict(list)

    def add(self, length: int, item) -> list[list]:
        """Put an item of `length` into the fullest bin that takes it; returns bins that closed thereby."""
        closed = []
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            own = self._take(space)
        else:
            if self.count >= self.most:
                closed.append(self._take((self.free & -self.free).bit_length() - 1))
            own, space = [self.begun], self.capacity
            self.begun += 1
        own.append((self.capacity - space, item))
        if space == length:
            closed.append(own)
        else:
            self._put(space - length, own)
        return closed

    def rest(self) -> list[list]:
        """The bins still open."""
        return [own for space in sorted(self.at) for own in self.at[space]]

    def _take(self, space: int) -> list:
        own = self.at[space].pop()
        self.count -= 1
        if not self.at[space]:
            del self.at[space]
            self.free &= ~(1 << space)
        return own

    def _put(self, space: int, own: list) -> None:
        self.at[space].append(own)
        self.count += 1
        self.free |= 1 << space


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if they fit, else of `capacity` but for a shorter first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _batch(rows: list[tuple], ids: bool):
    import pyarrow as pa

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids, "sequence_id", "offset"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * ids, pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _placed(bins: list[list], base: int | None) -> Iterator[tuple]:
    for number, *items in bins:
        for offset, item in items:
            yield (*item, None, None) if base is None else (*item, base + number, offset)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is its token ids and then END_ID, so a null or empty text is one token. Only documents
    longer than `capacity` are cut. Sequences are gapless from offset 0. Repeated rows and repeated or
    null doc_ids are packed each for itself; other columns are not looked at; an empty table gives no rows.
    """
    schema = PIECE + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"

    def first(batches):
        from pyspark import TaskContext

        base, encode, bins = TaskContext.get().partitionId() << 34, encoder(tokenizer), OpenBins(capacity, open_bins)
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(column(batch, "doc_id"), texts_of(batch), strict=True):
                ids = np.array([*encode((text or b"").decode()), END_ID], "<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    own = ids[start : start + length]
                    item = (doc, k, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if keep_ids else []))
                    rows += _placed(bins.add(length, item), base)
            yield _batch(rows, keep_ids)
            rows = []
        yield _batch([*_placed(bins.rest(), None)], keep_ids)

    def second(batches):
        from pyspark import TaskContext

        base, bins = (1 << 62) + (TaskContext.get().partitionId() << 34), OpenBins(capacity, open_bins)
        for batch in batches:
            rows: list[tuple] = []
            for item in zip(*(c.to_pylist() for c in batch.columns[:-2]), strict=True):
                rows += _placed(bins.add(item[3], item), base)
            yield _batch(rows, keep_ids)
        yield _batch([*_placed(bins.rest(), base)], keep_ids)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = materialise(texts.mapInArrow(frugal(first), schema), "packed")
    left = placed.filter("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    again = left.repartition(1 + tokens // ROUND_TOKENS).mapInArrow(frugal(second), schema)
    return placed.filter("sequence_id is not null").union(again)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
