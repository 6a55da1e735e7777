"""Token ids in binary files: one concatenated id array per file, document boundaries by Elias-Fano.

A file is MAGIC, the ids of its documents end to end (2 bytes each where the vocabulary allows, else 4, little
endian), a footer, the footer's length (8 bytes) and MAGIC again. The footer holds FIELDS and then two
Elias-Fano sequences: the ends of the documents, in ids from the file's beginning, and their doc_ids above the
least one. Files follow each other in ascending order of doc_id; documents without one come first. The table
`manifest` beside them is written last and names the files that count: what an attempt that was lost or
repeated left behind is in no manifest, and without a manifest there is nothing to read.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, frugal, scratch_path, session_partitions, steps, texts_of
from .eliasfano import EliasFano

MAGIC = b"FLIDS\x00\x00\x01"
FIELDS = np.dtype([("n_docs", "<u8"), ("n_ids", "<u8"), ("width", "<u8"), ("n_without", "<u8"), ("least", "<i8")])
END_ID = 2
#: Bytes of text that a task is dealt the ids of; ids, and documents, after which it begins another file.
PART_BYTES, FILE_IDS, FILE_DOCS = 64 << 20, 1 << 28, 1 << 20
#: Bytes of ids that a reader or writer holds at a time; a longer document is held whole.
STEP_BYTES = 8 << 20
#: Bytes of text that are encoded together.
TEXT_BYTES = 2 << 20
#: Words whose ids a worker remembers, those of the generation before not counted; words that the library sees in one call.
MEMO_WORDS, TOGETHER = 250_000, 4096

#: Fixed value: the word pattern of lower-cased word BPE files. No match of it holds white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER, _DIGIT, _MARK, _ODD, _SPACE = range(5)
#: Classes of bytes in pieces that part into words as WORD_PATTERN says: letters of ASCII and Latin-1 (led by 0xC3), digits, marks. Others are odd.
_CLASS = np.array([_SPACE if b in b" \t\n\v\f\r" else _LETTER if chr(b).isalpha() and b < 128 or b == 0xC3 else _DIGIT if 48 <= b <= 57 else _MARK if 33 <= b < 127 and chr(b) not in "'<>|" else _ODD for b in range(256)], np.uint8)

MANIFEST = "part int, number int, file string, n_docs long, n_ids long"


def parts_at_space(spec: dict) -> bool:
    """Whether a tokenizer file gives a text the ids of its pieces between white space, one after the other."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = bool(steps) and steps[0] == {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    then = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    before = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    plain = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in before.get("normalizers", [before]))
    return split and then and plain and not any(set(t["content"]) & set(" \t\n\r\v\f") for t in spec.get("added_tokens", []))


def _classes(data: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    led = np.flatnonzero(data[:-1] == 0xC3) + 1
    kind[led] = np.where((data[led] != 0x97) & (data[led] != 0xB7), _LETTER, _ODD)
    return kind


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of texts end to end, in small letters, and how many each text has: runs of letters, single digits, runs of marks.

    A piece between white space that holds an odd byte stays one word, as it is.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = _classes(data)
    begins = kind != _SPACE
    begins[1:] &= kind[:-1] == _SPACE
    plain = np.ones(len(data), bool)
    if len(odd := np.flatnonzero(kind == _ODD)):
        piece = np.cumsum(begins, dtype=np.int32)
        bad = np.zeros(int(piece[-1]) + 1, bool)
        bad[piece[odd]] = True
        plain = ~bad[piece]
    inside = (kind[1:] != _SPACE) & (kind[:-1] != _SPACE) & plain[1:]
    cuts = np.flatnonzero(inside & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))) + 1
    large = (data >= 65) & (data <= 90)
    large[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    small = data + ((large & plain).view(np.uint8) << 5)
    begins[cuts] = True
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), ends), prepend=0)
    return np.insert(small, cuts, 32).tobytes().split(), counts


class Encoder:
    """Texts -> their ids as bytes, by the tokenizers library, added tokens found in a text included, none put around it.

    Where the file allows, the library sees each different word once, plain ones many in one call: it marks where each ends.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.own = Tokenizer.from_file(path)
        self.kind = id_type(spec)
        self.by_word = parts_at_space(spec)
        self.ends = np.zeros(max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1, bool)
        if suffix := spec["model"].get("end_of_word_suffix"):
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.own.encode(text.decode(), add_special_tokens=False).ids, self.kind)

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words that are not yet known."""
        size = self.kind.itemsize
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            line = np.frombuffer(b"\n".join(own), np.uint8)
            odd = np.zeros(len(own), bool)
            odd[np.searchsorted(np.flatnonzero(line == 10), np.flatnonzero(_classes(line) == _ODD))] = True
            self.young.update((w, self._ids(w).tobytes()) for w in itertools.compress(own, odd))
            own = list(itertools.compress(own, ~odd))
            ids = self._ids(b" ".join(own))
            last, data = (np.flatnonzero(self.ends[ids]) + 1).tolist(), ids.tobytes()
            self.young.update((w, data[a * size : b * size]) for w, a, b in zip(own, [0, *last[:-1]], last, strict=len(own) > 0))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [self._ids(t).tobytes() for t in texts]
        words, counts = words_of(texts)
        own = list(map(self.young.get, words, itertools.repeat(b"")))
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        if missing := np.flatnonzero(sizes == 0).tolist():
            new = {words[k] for k in missing} - self.young.keys()
            known = new & self.old.keys()
            self.young.update((w, self.old[w]) for w in known)
            self._learn(list(new - known))
            for k in missing:
                own[k] = self.young[words[k]]
                sizes[k] = len(own[k])
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        data = b"".join(own)
        if len(self.young) >= MEMO_WORDS:  # what is used stays for as many words again
            self.old = {w: i for w, i in self.young.items() if len(w) <= 64}
            self.young = {}
        return [data[a:b] for a, b in itertools.pairwise(ends)]


def id_type(spec: dict) -> np.dtype:
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), END_ID])
    return np.dtype("<u2") if most < 1 << 16 else np.dtype("<u4")


_encoders: dict[str, Encoder] = {}


def encoded(docs: DataFrame, tokenizer: str, bounds: Bounds, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, place, ids) of docs (doc_id, text): ids as bytes with end_id at the end; place tells rows apart that share a doc_id."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encode, place = _encoders[tokenizer], TaskContext.get().partitionId() << 33
        end = np.array([end_id], encode.kind).tobytes()
        for batch in batches:
            docs = column(batch, "doc_id")
            for at, texts in steps(texts_of(batch), TEXT_BYTES):
                ids = [own + end for own in encode(texts)]
                own, places = docs[at : at + len(ids)], np.arange(place, place + len(ids))
                columns = [pa.array(bounds.parts(own, places), pa.int32()), pa.array(own, pa.int64()), pa.array(places), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "place", "ids"])
                place += len(ids)

    return docs.mapInArrow(frugal(run), "part int, doc_id long, place long, ids binary")


@dataclass
class Bounds:
    """Which of n parts, in order, a document is written by: `without` parts share those without a doc_id, `upper` has the last doc_id of each but the last of the others.

    A doc_id that is the last of several parts is shared out over them.
    """

    n: int
    without: int
    upper: np.ndarray

    @classmethod
    def of(cls, docs: DataFrame, at_least: int) -> Bounds:
        """Bounds of docs (doc_id, text) by the number of rows, for PART_BYTES of text a part or at_least parts: a long per part in the driver."""
        size, rows, named = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id")).first()
        n = max(at_least, -(-(size or 0) // PART_BYTES))
        without = min(n - 1, max(1, round(n * (rows - named) / rows))) if rows > named and n > 1 else 0
        shares = [k / (n - without) for k in range(1, n - without)]
        upper = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n))).first()[0] if shares and named else []
        return cls(n, without, np.array(upper, np.int64))

    def parts(self, docs: list[int | None], places: np.ndarray) -> np.ndarray:
        named = np.array([d is not None for d in docs], bool)
        ids = np.array([d or 0 for d in docs], np.int64)
        low, high = np.searchsorted(self.upper, ids, "left"), np.searchsorted(self.upper, ids, "right")
        return np.where(named, self.without + low + places % np.maximum(1, high - low), places % max(1, self.without))


def opened(folder: str) -> tuple:
    """(file system, path) of a folder that all executors share, by pyarrow: a local path, or a URI of a store that it knows."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(folder)


class FileWriter:
    """Writes documents in ascending order of doc_id, None first."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.ends, self.docs = array("q"), array("q")
        self.n_ids, self.n_without, self.held = 0, 0, bytearray()
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held += ids
        self.n_ids += len(ids) // self.width
        self.ends.append(self.n_ids)
        if doc_id is None:
            self.n_without += 1
        else:
            self.docs.append(doc_id)
        if len(self.held) >= STEP_BYTES:
            self._flush()

    def _flush(self) -> None:
        self.out.write(bytes(self.held))
        self.held.clear()

    def close(self) -> None:
        self._flush()
        docs = np.array(self.docs, np.int64)
        least = int(docs[0]) if len(docs) else 0
        fields = np.array([(len(self.ends), self.n_ids, self.width, self.n_without, least)], FIELDS)
        above = docs.view(np.uint64) - np.array([least], np.int64).view(np.uint64)
        footer = fields.tobytes() + EliasFano.of(np.array(self.ends, np.uint64)).tobytes() + EliasFano.of(above).tobytes()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


class FileReader:
    """Random and sequential access to one file; only the footer is held."""

    def __init__(self, source) -> None:
        self.source = source
        size, tail = source.size(), 8 + len(MAGIC)
        end = bytes(source.read_at(tail, size - tail))
        if end[8:] != MAGIC:
            raise ValueError("not a whole file of ids")
        length = int.from_bytes(end[:8], "little")
        footer = bytes(source.read_at(length, size - tail - length))
        own = np.frombuffer(footer, FIELDS, 1)[0]
        self.n_docs, self.n_ids, self.n_without, self.least = (int(own[c]) for c in ("n_docs", "n_ids", "n_without", "least"))
        self.kind = np.dtype(f"<u{int(own['width'])}")
        self.ends, at = EliasFano.read(footer, FIELDS.itemsize)
        self.above, _ = EliasFano.read(footer, at)

    def span(self, k: int) -> tuple[int, int]:
        """(start, end) of document k, in ids from the beginning of the file."""
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def doc_id(self, k: int) -> int | None:
        return None if k < self.n_without else self.least + self.above.select(k - self.n_without)

    def ids(self, start: int, end: int) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.source.read_at((end - start) * width, len(MAGIC) + start * width), self.kind)

    def document(self, k: int) -> np.ndarray:
        return self.ids(*self.span(k))

    def steps(self) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """(doc_ids, starts with one more at the end, ids) of runs of documents of about STEP_BYTES, in order."""
        starts = np.concatenate(([0], self.ends.values().astype(np.int64)))
        docs = (self.above.values() + np.array([self.least], np.int64).view(np.uint64)).view(np.int64)
        most, k, n = STEP_BYTES // self.kind.itemsize, 0, self.n_without
        while k < self.n_docs:
            j = max(k + 1, int(np.searchsorted(starts, starts[k] + most, "right")) - 1)
            yield [None] * (min(j, n) - min(k, n)) + docs[max(0, k - n) : max(0, j - n)].tolist(), starts[k : j + 1], self.ids(int(starts[k]), int(starts[j]))
            k = j


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text of docs, each with end_id at its end, into a new folder that all executors share.

    Order: ascending doc_id, rows without one first, rows that share one in no order of their own. A null
    text counts as empty and is the end id alone; other columns are not looked at; an empty table writes
    an empty manifest. Texts are encoded where they lie; only ids travel.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    bounds = Bounds.of(own, session_partitions(spark))
    with open(tokenizer, encoding="utf-8") as f:
        width = id_type(json.load(f)).itemsize

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number, own, name = TaskContext.get(), 0, None, ""
        files, root = opened(folder)
        done = []

        def close():
            own.close()
            done.append((task.partitionId(), number, name, len(own.ends), own.n_ids))

        for batch in batches:
            for doc, ids in zip(column(batch, "doc_id"), column(batch, "ids"), strict=True):
                if own is None:
                    # an attempt of its own name: two attempts of one task never share a file
                    name = f"part-{task.partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.ids"
                    own = FileWriter(files.open_output_stream(f"{root}/{name}"), width)
                own.add(doc, ids)
                if own.n_ids >= FILE_IDS or len(own.ends) >= FILE_DOCS:
                    close()
                    number, own = number + 1, None
        if own is not None:
            close()
        names = ["part", "number", "file", "n_docs", "n_ids"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    files, root = opened(folder)
    files.create_dir(root, recursive=True)
    laid = encoded(own, tokenizer, bounds, end_id).repartitionById(bounds.n, "part").sortWithinPartitions(F.asc_nulls_first("doc_id"), "place").drop("part")
    laid.mapInArrow(frugal(write), MANIFEST).write.parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document out of the files that the manifest names.

    start counts the ids of all documents before it; ids_crc32 is of the ids as little-endian unsigned 32-bit
    numbers. One task reads one file or several, a few documents at a time.
    """
    # one row per file: a window over files, not over documents
    before = F.sum("n_ids").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def read(batches):
        import pyarrow as pa

        where, root = opened(folder)
        for batch in batches:
            for name, base in zip(column(batch, "file"), column(batch, "base"), strict=True):
                with where.open_input_file(f"{root}/{name}") as source:
                    for docs, starts, ids in FileReader(source).steps():
                        wide = ids.astype("<u4")
                        spans = [wide[a - starts[0] : b - starts[0]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                        columns = [pa.array(docs, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64())]
                        if keep_ids:
                            columns.append(pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids])

    return files.repartition(session_partitions(spark)).mapInArrow(frugal(read), schema)


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """Per document, out of the files written: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_ids(spark, folder)
