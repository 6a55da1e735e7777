"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

One pass over a text visits, at each position, all pieces that end there (the automaton's output
links) and relaxes the best segmentation up to there. For unigram models that is Viterbi: the best
sum of scores. BPE models do not maximise a sum (their scores are merge ranks), so a sum would give
other ids than the model's own; there the same pass keeps, of the pieces that end at a position, the
one that BPE itself ends with: the piece that stays apart from its predecessor when BPE runs on just
the two of them. That gives the ids of the format's own library.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, texts_of

SPACE = "▁"
#: Fixed values of the public model format: kinds of pieces, kinds of models, penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Chunks whose ids a worker remembers before it starts afresh.
MEMO_CHUNKS = 300_000
#: Pairs of pieces of which a worker remembers whether they stay apart.
MOST_PAIRS = 1_500_000


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + width]
            at += width
        else:
            width = varint()
            yield tag >> 3, data[at : at + width]
            at += width


@dataclass
class Model:
    """A model file: pieces with scores and kinds, and the flags that encoding needs."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    extra_spaces: bool = True

    @classmethod
    def load(cls, data: bytes) -> Model:
        own = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                own.pieces.append(piece[1].decode())
                own.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                own.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                own.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                own.dummy_prefix, own.extra_spaces = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                if rules.get(2):
                    raise ValueError("models with a character map are not supported")
        if own.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return own

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}

    @cached_property
    def letters(self) -> set[str]:
        """Characters that are pieces."""
        return {p for p in self.ids if len(p) == 1}

    @cached_property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        return [at[f"<0x{b:02X}>"] for b in range(256)] if at else []

    @cached_property
    def automaton(self):
        import ahocorasick

        own = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            own.add_word(piece, (i, len(piece)))
        own.make_automaton()
        return own

    @cached_property
    def chunks(self) -> re.Pattern:
        """Where a text can be cut without changing its ids: no piece has a space behind another character."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r".+", re.S)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        return re.compile(f"{line + '|' if line else ''}{SPACE}*[^{SPACE}{line}]+|{SPACE}+")

    @cached_property
    def surfaces(self) -> list[bytes]:
        """UTF-8 that each id decodes to."""
        out = []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode())
        return out


class Encoder:
    """Encodes and decodes with one model; remembers the ids of chunks and which pieces stay apart."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.memo: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        self._apart_ids: dict[int, bool] = {}
        self._bytes = set(model.byte_ids)
        self._ends, self._pieces, self._lengths = model.automaton.iter, model.pieces, [*map(len, model.pieces)]
        self.floor = min((s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.top = max((s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL), default=0.0)

    def normalised(self, text: str) -> str:
        if self.model.extra_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    def segment(self, chunk: str) -> list[str]:
        """The chunk's pieces, unknown characters for themselves."""
        last: list[str | None] = [None] * (len(chunk) + 1)
        (self._relax_bpe if self.model.kind == BPE else self._relax_unigram)(chunk, last)
        out, at = [], len(chunk)
        while at:
            out.append(last[at])
            at -= len(out[-1])
        return out[::-1]

    def _endings(self, chunk: str):
        """(end, lengths of the pieces that end there, longest first) for each position in turn."""
        held, end = [], 0
        for at, (_, length) in self.model.automaton.iter(chunk):
            while end < at:
                yield end + 1, held
                held, end = [], end + 1
            held.append(length)
        while end < len(chunk):
            yield end + 1, held
            held, end = [], end + 1

    def _relax_unigram(self, chunk: str, last: list) -> None:
        best = [0.0] + [-np.inf] * len(chunk)
        ids, scores, kinds = self.model.ids, self.model.scores, self.model.kinds
        for end, lengths in self._endings(chunk):
            for length in lengths if 1 in lengths else [*lengths, 1]:
                piece = chunk[end - length : end]
                i = ids.get(piece)
                own = self.floor if i is None else length * self.top - 0.1 if kinds[i] == USER_DEFINED else scores[i]
                if best[end - length] + own > best[end]:
                    best[end], last[end] = best[end - length] + own, piece

    def _relax_bpe(self, chunk: str, last: list) -> None:
        for end, lengths in self._endings(chunk):
            for length in lengths if 1 in lengths else [*lengths, 1]:
                piece, before = chunk[end - length : end], last[end - length]
                if (before is not None or length == end) and self.stays_apart(before or "", piece):
                    last[end] = piece
                    break

    def _bpe_ids(self, chunk: str) -> list[int]:
        """_relax_bpe on ids, for chunks whose characters are all pieces."""
        last: list[int | None] = [-1] + [None] * len(chunk)
        apart = self._apart_ids
        for at, (i, length) in self._ends(chunk):
            if last[at + 1] is None and (before := last[at + 1 - length]) is not None:
                good = apart.get(before << 32 | i)
                if good is None:
                    pair = [self._pieces[k] for k in (before, i) if k >= 0]
                    good = apart[before << 32 | i] = self.merged("".join(pair)) == pair
                if good:
                    last[at + 1] = i
        out, at, lengths = [], len(chunk), self._lengths
        while at:
            i = last[at]
            out.append(i)
            at -= lengths[i]
        out.reverse()
        return out

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether BPE on a + b ends with just these two (b alone, if a is empty)."""
        got = self._apart.get((a, b))
        if got is None:
            if len(self._apart) > MOST_PAIRS:
                self._apart.clear()
            got = self._apart[a, b] = self.merged(a + b) == [x for x in (a, b) if x]
        return got

    def merged(self, text: str) -> list[str]:
        """BPE as defined: again and again join the adjacent pair with the best score, leftmost first."""
        parts, ids, scores = list(text), self.model.ids, self.model.scores
        while True:
            found = [(-scores[i], k) for k in range(len(parts) - 1) if (i := ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _ids_of(self, chunk: str) -> list[int]:
        if self.model.kind == BPE and self.model.letters.issuperset(chunk):
            return self._bpe_ids(chunk)
        out = []
        for piece in self.segment(chunk):
            i = self.model.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.model.byte_ids:
                out += [self.model.byte_ids[b] for b in piece.encode()]
            elif not out or out[-1] != self.model.unknown:
                out.append(self.model.unknown)
        return out

    def _packed_chunk(self, chunk: str) -> tuple[bytes, int, bytes]:
        got = self.older.get(chunk)
        if got is None:
            ids = self._ids_of(chunk)
            got = (np.array(ids, "<u4").tobytes(), sum(map(self._bytes.__contains__, ids)) if self._bytes else 0, self.surface(ids))
        if len(chunk) < 200:
            if len(self.memo) > MEMO_CHUNKS:
                self.memo, self.older = {}, self.memo
            if len(self._apart_ids) > MOST_PAIRS:
                self._apart_ids.clear()
            self.memo[chunk] = got
        return got

    def packed(self, text: str) -> tuple[bytes, int, str]:
        """The ids of a whole text as little-endian unsigned 32-bit, how many of them are bytes, and the text decoded from them.

        Ids decode one by one, so that a text's decoding is that of its chunks end to end.
        """
        parts, n_bytes, surfaces = [], 0, []
        for chunk in self.model.chunks.findall(self.normalised(text)):
            ids, n, surface = self.memo.get(chunk) or self._packed_chunk(chunk)
            parts.append(ids)
            n_bytes += n
            surfaces.append(surface)
        return b"".join(parts), n_bytes, self._shown(b"".join(surfaces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text)[0], "<u4").tolist()

    def surface(self, ids: list[int]) -> bytes:
        return b"".join(map(self.model.surfaces.__getitem__, ids))

    def _shown(self, surface: bytes) -> str:
        text = surface.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        return self._shown(self.surface(ids))


_encoders: dict[bytes, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    """This process's encoder for a model: tasks that follow each other share what it remembers."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(Model.load(model))
    return _encoders[key]


def encode_documents(docs: DataFrame, model: bytes, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text_key, n_ids, n_bytes, ids_crc32, round_trip[, ids]) for every row of docs.

    n_bytes counts ids of single bytes; round_trip says whether decoding gives the text back. Null and
    empty texts have no ids. Repeated rows, null doc_ids and other columns make no difference.
    """
    schema = "doc_id long, text_key long, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids

    def run(batches):
        import pyarrow as pa

        own = encoder_of(model)
        for batch in batches:
            rows = []
            for data in texts_of(batch):
                text = (data or b"").decode()
                packed, n_bytes, shown = own.packed(text)
                ids = np.frombuffer(packed, "<u4")
                rows.append((len(ids), n_bytes, zlib.crc32(packed), shown == text, *[ids.astype(np.int32)] * keep_ids))
            columns = list(zip(*rows, strict=True)) or [()] * (4 + keep_ids)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * keep_ids]
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_ids, n_bytes, ids_crc32, round_trip."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).drop("text_key")
