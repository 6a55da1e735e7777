"""Substring deduplication by seed and extend.

A window is WINDOW consecutive words of one document. Winnowing gives every window an anchor: the least
n-gram of GRAM words in it. Windows with equal words have equal anchors at equal places, so documents
are joined where anchors repeat. An anchor's stretch is all windows that it stands for; places with equal
stretches form a class. Only where an anchor occurs in different stretches (the ends of repeats) are its
windows compared one by one, once a class. Every repeated window gets one partner: the same words' place
before it in its text, or else the first or the last place of them all; so nothing is paired with
everything that shares its anchor, and no link is lost.

Windows in turn whose partners are in turn make a seed match. Its partner's words are fetched in blocks
of BLOCK, compared word by word and extended both ways until the words differ or a text ends; matches of
WINDOW words or more stay. Their union is that of all maximal repeats of WINDOW words or more.

Joins go by 64 bits of the anchor and 64 more of the stretch or window; words decide afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, column, discard, frugal, hashed_words, materialise, mix, row_key, slices, steps, texts_of

WINDOW, GRAM = 35, 10
#: Words of a partner that are fetched together.
BLOCK = 64
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Stretches:
    """The seeds of some texts and the stretches of windows that they stand for."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> None:
        self.window = window
        sizes = np.diff(starts)
        own = np.maximum(sizes - window + 1, 0)  # windows of each text
        begin = np.concatenate(([0], np.cumsum(own)))
        text = np.repeat(np.arange(len(sizes)), own)
        at = np.arange(begin[-1]) - begin[:-1][text] + starts[:-1][text]  # first word of each window
        grams = mix(self._grams(hashes, gram))
        seed = self._least(grams, window - gram + 1, at)
        new = np.ones(len(at), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.text = text[first]
        self.lo = at[first]  # first word of the first window, counted over all texts
        self.n = np.diff(np.append(first, len(at)))  # windows
        self.start = self.lo - starts[:-1][self.text]  # the same, counted in its text
        self.seed = grams[seed[first]]
        # sums of powers: the hash of any stretch of words is a difference, moved to a common power
        self.power = _powers(pow(_BASE2, -1, 2**64), len(hashes) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _U(_BASE)) * _powers(_BASE2, len(hashes)), dtype=np.uint64)))
        offset = (seed[first] - self.lo).astype(np.uint64) << _U(32) | self.n.astype(np.uint64)
        self.stretch = mix(self.words(self.lo, self.lo + self.n + window - 1) ^ mix(offset))

    def words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a to b (not included)."""
        return mix((self.sums[b] - self.sums[a]) * self.power[a])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of the windows of stretch k, in turn."""
        at = self.lo[k] + np.arange(self.n[k])
        return self.words(at, at + self.window)

    @staticmethod
    def _grams(hashes: np.ndarray, gram: int) -> np.ndarray:
        out, have, base = hashes.copy(), 1, _BASE
        with np.errstate(over="ignore"):
            result, width, shift = None, 0, gram
            while True:  # doubling: n-grams of 1, 2, 4, ... words, those of the bits of `gram` put together
                if shift & 1:
                    if result is None:
                        result, width = out, have
                    else:
                        m = len(hashes) - have - width + 1
                        result = out[: max(0, m)] * _U(pow(_BASE, width, 2**64)) + result[have : have + max(0, m)]
                        width += have
                shift >>= 1
                if not shift:
                    return result
                m = max(0, len(out) - have)
                out = out[:m] * _U(pow(base, have, 2**64)) + out[have : have + m]
                have *= 2

    @staticmethod
    def _least(grams: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        """Where the first least gram of grams[p : p + width] is, for each p of `at`."""
        best, place, have = grams, np.arange(len(grams)), 1
        while have * 2 <= width:
            a, b = best[:-have], best[have:]
            right = b < a  # not if equal: the first one counts
            best, place = np.where(right, b, a), np.where(right, place[have:], place[:-have])
            have *= 2
        if not len(at):
            return np.zeros(0, np.int64)
        end = at + width - have
        return np.where(best[end] < best[at], place[end], place[at])


def packed_texts(docs: DataFrame, *carried: Column) -> DataFrame:
    """(row, doc_id, text_key, carried..., packed): rows numbered, texts compressed; written, so that numbers and texts stay as they are."""
    own = docs.select(*row_key(F.col("doc_id"), F.col("text")), *carried, F.col("text").cast("binary").alias("text"))
    own = own.select(F.monotonically_increasing_id().alias("row"), "*")
    names = [*own.columns[:-1], "packed"]

    def run(batches):
        import pyarrow as pa

        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([None if t is None else tool.compress(t) for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=names)

    schema = T.StructType([*own.schema.fields[:-1], T.StructField("packed", T.BinaryType())])
    return materialise(own.mapInArrow(frugal(run), schema), "texts")


def unpacked(batch, tool):
    """The texts of a batch, a few at a time; None counts as empty."""
    for part in slices(batch):
        yield from (t and tool.decompress(t) for t in column(part, "packed"))


def stretches(texts: DataFrame) -> DataFrame:
    """(seed, stretch, row, start, n): every stretch of windows of every text."""

    def run(batches):
        import pyarrow as pa

        memo, tool = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = batch.column(0)
            for at, part in steps(unpacked(batch, tool)):
                _, hashes, starts = hashed_words(part, memo)
                s = Stretches(hashes, starts)
                arrays = [pa.array(s.seed.view(np.int64)), pa.array(s.stretch.view(np.int64)), rows.take(pa.array(s.text + at)), pa.array(s.start.astype(np.int32)), pa.array(s.n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["seed", "stretch", "row", "start", "n"])

    return texts.select("row", "packed").mapInArrow(frugal(run), "seed long, stretch long, row long, start int, n int")


def _lists(batch, *names: str):
    for part in slices(batch, 64):
        yield from zip(column(part, "packed"), *(column(part, n) for n in names), strict=True)


def _windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seed, stretch, k, window, times, lrow, lstart, hrow, hstart): the windows one by one of the wanted classes of stretches.

    Each class is read from the text of its first place; its first and last place are moved on to the window.
    """
    names = ["seed", "stretch", "k", "window", "times", "lrow", "lstart", "hrow", "hstart"]

    def run(batches):
        import pyarrow as pa

        memo, tool = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, own in _lists(batch, "own"):
                _, hashes, starts = hashed_words([tool.decompress(packed)], memo)
                s = Stretches(hashes, starts)
                at = {start: k for k, start in enumerate(s.start.tolist())}
                for x in own:
                    i = at[x["lstart"]]
                    k, same = np.arange(s.n[i]), np.ones(s.n[i], np.int64)
                    rows.append((same * x["seed"], same * x["stretch"], k, s.windows(i).view(np.int64), same * x["times"], same * x["lrow"], x["lstart"] + k, same * x["hrow"], x["hstart"] + k))
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    own = wanted.groupBy(F.col("lrow").alias("row")).agg(F.collect_list(F.struct("seed", "stretch", "times", "lrow", "lstart", "hrow", "hstart")).alias("own"))
    return texts.select("row", "packed").join(own, "row").select("packed", "own").mapInArrow(frugal(run), ", ".join(f"{n} long" for n in names))


def repeated(texts: DataFrame) -> DataFrame:
    """(row, start, parts), parts of (mask, lrow, lstart, hrow, hstart): bit k of a mask says that the window at word start + k occurs elsewhere.

    lrow, lstart + k is the first place of that window's words in row order, hrow, hstart + k the last. A stretch has
    one row of parts, at most one part for each of its windows: each place of a stretch meets one row, whatever its windows' partners.
    """
    seeds = materialise(stretches(texts), "stretches")
    again = seeds.groupBy("seed").agg(F.count("*").alias("times"), F.min("stretch").alias("a"), F.max("stretch").alias("b"))
    # what is joined is written first, and what a join gives as well where an aggregate follows: either would
    # tie the join to partitions by its key, and the rows of a hot seed could then not be split over tasks
    again = materialise(again.filter("times > 1").select("seed", (F.col("a") != F.col("b")).alias("mixed")), "again")
    hits = materialise(seeds.join(again, "seed"), "hits")
    discard(seeds, again)
    place = F.struct("row", "start")
    classes = hits.groupBy("seed", "stretch", "n", "mixed").agg(F.count("*").alias("times"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    ends = [F.col(f"{x}.{c}").cast("long").alias(f"{x[0]}{c}") for x in ("lo", "hi") for c in ("row", "start")]
    classes = materialise(classes.select("seed", "stretch", "n", "mixed", "times", *ends), "classes")
    windows = materialise(_windows(texts, classes.filter("mixed")), "windows")
    twice = windows.groupBy("seed", "window").agg(F.sum("times").alias("all"), F.min(F.struct("lrow", "lstart")).alias("lo"), F.max(F.struct("hrow", "hstart")).alias("hi"))
    twice = materialise(twice.filter("all > 1").select("seed", "window", "lo.*", "hi.*"), "twice")
    met = windows.select("seed", "stretch", "k", "window").join(twice, ["seed", "window"])
    met = met.select("seed", "stretch", "k", "lrow", (F.col("lstart") - F.col("k")).alias("lstart"), "hrow", (F.col("hstart") - F.col("k")).alias("hstart"))
    masks = met.groupBy("seed", "stretch", "lrow", "lstart", "hrow", "hstart").agg(F.bit_or(F.expr("shiftleft(1L, cast(k as int))")).alias("mask"))
    part = F.struct("mask", "lrow", "lstart", "hrow", "hstart")
    masks = masks.groupBy("seed", "stretch").agg(F.collect_list(part).alias("parts"))  # as many as a stretch has windows
    whole = classes.filter("not mixed").withColumn("mask", F.expr("shiftleft(1L, n)") - 1)  # all windows
    found = hits.select("seed", "stretch", "row", "start").join(materialise(whole.select("seed", "stretch", F.array(part).alias("parts")).unionByName(masks), "masks"), ["seed", "stretch"])
    return found.select("row", "start", "parts")


def partners(row, start, mask, lrow, lstart, hrow, hstart) -> tuple[np.ndarray, ...]:
    """Seed matches (row, start, n, prow, pstart) out of the parts of `repeated`, each with its row and start, those of a text all together.

    A window's partner is the same words' place before it in its own text (so that text of a short period
    matches itself along one diagonal), or else the first place of all, or the last, or the next in its text.
    The n windows of a match follow one another in both texts.
    """
    i, k = np.nonzero(np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    row, t, lrow, ls, hrow, hs = row[i], start[i] + k, lrow[i], lstart[i] + k, hrow[i], hstart[i] + k
    order = np.lexsort((t, ls, lrow, row))
    row, t, lrow, ls, hrow, hs = (x[order] for x in (row, t, lrow, ls, hrow, hs))
    same = (row[1:] == row[:-1]) & (lrow[1:] == lrow[:-1]) & (ls[1:] == ls[:-1])
    prow = np.where(lrow != row, lrow, hrow)
    pstart = np.where(lrow != row, ls, hs)
    after = np.append(same, False) & (prow == row)
    pstart[after] = t[np.flatnonzero(after) + 1]
    before = np.concatenate((np.zeros(min(1, len(t)), bool), same))
    prow[before] = row[before]
    pstart[before] = t[np.flatnonzero(before) - 1]
    order = np.lexsort((t, pstart - t, prow, row))
    row, t, prow, pstart = (x[order] for x in (row, t, prow, pstart))
    new = np.ones(len(t), bool)
    new[1:] = (row[1:] != row[:-1]) | (prow[1:] != prow[:-1]) | (t[1:] != t[:-1] + 1) | (pstart[1:] != pstart[:-1] + 1)
    first = np.flatnonzero(new)
    return row[first], t[first], np.diff(np.append(first, len(t))), prow[first], pstart[first]


def seed_matches(texts: DataFrame) -> DataFrame:
    """(row, start, n, prow, pstart): n words at word start of a text that stand, by their hashes, at pstart of prow as well."""
    names = ["mask", "lrow", "lstart", "hrow", "hstart"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in slices(batch, 64):
                own = part.column(1)
                values = own.flatten()
                places = values.field("parts")
                at, each = pc.list_parent_indices(places), places.flatten()
                ends = part.column(0).take(pc.list_parent_indices(own)).take(at), values.field("start").take(at), *(each.field(n) for n in names)
                got = partners(*(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ends))
                got = (*got[:2], got[2] + WINDOW - 1, *got[3:])
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], names=["row", "start", "n", "prow", "pstart"])

    own = repeated(texts).groupBy("row").agg(F.collect_list(F.struct("start", "parts")).alias("own"))
    return materialise(own.mapInArrow(frugal(run), "row long, start long, n long, prow long, pstart long"), "matches")


def _blocks(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prow, block, words): BLOCK words from word block * BLOCK of a text, joined by spaces; none where the text has ended."""

    def run(batches):
        import pyarrow as pa

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, prow, own in _lists(batch, "prow", "blocks"):
                words = tool.decompress(packed).split()
                rows += [(prow, b, b" ".join(words[b * BLOCK : (b + 1) * BLOCK])) for b in own if b * BLOCK < len(words)]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["prow", "block", "words"])

    own = wanted.groupBy("prow").agg(F.collect_set("block").alias("blocks"))  # as many as a text has
    met = texts.select(F.col("row").alias("prow"), "packed").join(own, "prow")
    return materialise(met.mapInArrow(frugal(run), "prow long, block long, words binary"), "blocks")


def _side_by_side(texts: DataFrame, matches: DataFrame, reach: int = 1, how: str = "left") -> DataFrame:
    """texts plus `own`, the matches of each, and `passages`, the blocks of their partners' words, `reach` words further both ways."""
    span = F.expr(f"sequence(greatest(0L, pstart - {reach}L) div {BLOCK}L, (pstart + n + {reach - 1}L) div {BLOCK}L)")
    need = materialise(matches.select("row", "prow", F.explode(span).alias("block")).distinct(), "needed")
    met = need.join(_blocks(texts, need), ["prow", "block"])
    passages = met.groupBy("row").agg(F.collect_list(F.struct("prow", "block", "words")).alias("passages"))
    own = matches.groupBy("row").agg(F.collect_list(F.struct("start", "n", "prow", "pstart")).alias("own"))
    return texts.join(own.join(passages, "row"), "row", how)


def extended(words: list[bytes], own: list, passages: list, reach: int = 1) -> set[tuple[int, int, int, int, bool]]:
    """(start, n, prow, pstart, open) of matches compared and extended both ways over the passages at hand, n words each.

    `open`: the words at hand ended before they differed or a text ended.
    """
    at = {(x["prow"], x["block"]): x["words"] for x in passages}
    out = set()
    for x in own:
        start, n, prow, pstart = x["start"], x["n"], x["prow"], x["pstart"]
        base, last = max(0, pstart - reach) // BLOCK, (pstart + n + reach - 1) // BLOCK
        theirs = b" ".join(at[prow, b] for b in range(base, last + 1) if (prow, b) in at).split()
        i = off = pstart - base * BLOCK
        lo = start
        while lo and i and words[lo - 1] == theirs[i - 1]:
            lo, i = lo - 1, i - 1
        hi, j = (start + n, off + n) if words[start : start + n] == theirs[off : off + n] else (start, off)
        while hi < len(words) and j < len(theirs) and words[hi] == theirs[j]:
            hi, j = hi + 1, j + 1
        more = (lo > 0 and i == 0 and base > 0) or (hi < len(words) and j == (last + 1 - base) * BLOCK)
        if hi - lo >= WINDOW:
            out.add((lo, hi - lo, prow, base * BLOCK + i, more))
    return out


def _removed(words: list[bytes], own: list | None, passages: list | None) -> np.ndarray:
    """Which words a match covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n, *_ in extended(words, own, passages or ()) if own else ():
        edge[start] += 1
        edge[start + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def _met(texts: DataFrame) -> DataFrame:
    """texts plus the matches of each and their partners' words.

    One block further than a match is enough to remove by: each repeated window lies in a match of its own.
    """
    return _side_by_side(texts, seed_matches(texts)).drop("row")


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, n, other_id, other_key, other_start): matches of WINDOW words or more that end both ways in different words or at an end of a text.

    The n words from word `start` of a row are those from `other_start` of another row, or of the same one
    elsewhere. Every repeated window of every row lies in at least one match; a row is matched with one place
    for each of them, not with all. Matches that are longer than what was fetched of their partner are
    fetched again with twice as much. Null and short texts have none; repeated rows match each other.
    """
    texts = packed_texts(docs)
    left, reach, done = seed_matches(texts), 1, []
    while True:
        found = materialise(_extensions(texts.select("row", "packed"), left, reach), "extended")
        done.append(found.filter("not open").drop("open"))
        left = found.filter("open").drop("open")
        if left.isEmpty():
            break
        reach = max(BLOCK, 2 * reach)
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    name = texts.select("row", "doc_id", "text_key")
    other = name.select(F.col("row").alias("prow"), F.col("doc_id").alias("other_id"), F.col("text_key").alias("other_key"))
    met = every.distinct().join(name, "row").join(other, "prow")
    return met.select("doc_id", "text_key", "start", "n", "other_id", "other_key", F.col("pstart").alias("other_start"))


def _extensions(texts: DataFrame, matches: DataFrame, reach: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, row, own, passages in _lists(batch, "row", "own", "passages"):
                rows += [(row, *x) for x in extended(tool.decompress(packed).split(), own, passages, reach)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.bool_()) for k, c in enumerate(columns)], names=["row", "start", "n", "prow", "pstart", "open"])

    return _side_by_side(texts, matches, reach, "inner").mapInArrow(frugal(run), "row long, start long, n long, prow long, pstart long, open boolean")


def without_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept_sha256[, text]) for every row of docs.

    Words are maximal runs without space and 0x09-0x0D, compared unchanged. A word goes if a window that
    covers it has a word sequence that also starts at another place: another row's (repeated rows count)
    or the same text's. Texts under WINDOW words keep all; null and empty texts have no words. The kept
    words are joined by one space. Null or repeated doc_ids and other columns make no difference.
    """
    schema = "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text

    def run(batches):
        import pyarrow as pa

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, own, passages in _lists(batch, "own", "passages"):
                words = tool.decompress(packed).split() if packed else []
                gone = _removed(words, own, passages)
                kept = b" ".join(w for w, out in zip(words, gone.tolist(), strict=True) if not out) if own else b" ".join(words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "replace")] * keep_text))
            columns = list(zip(*rows, strict=True)) or [()] * (3 + keep_text)
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=False))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return _met(packed_texts(docs)).mapInArrow(frugal(run), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated windows removed from `text`, and n_chars, if there is one, set anew for the texts that changed.

    Rules are those of without_repeats; a text that holds no repeat, null ones included, stays as it is. Keeps
    every row and all columns, which travel with the text.
    """
    others = [c for c in docs.columns if c != "text"]
    texts = packed_texts(docs, F.struct(*(F.col(f"`{c}`") for c in others)).alias("doc")).drop("doc_id", "text_key")

    def run(batches):
        import pyarrow as pa

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, own, passages in _lists(batch, "own", "passages"):
                text = packed and tool.decompress(packed)
                if own:
                    words = text.split()
                    text = b" ".join(w for w, out in zip(words, _removed(words, own, passages).tolist(), strict=True) if not out)
                rows.append((None if text is None else text.decode(), bool(own)))
            texts, changed = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(changed, pa.bool_())], names=["doc", "text", "changed"])

    schema = T.StructType([texts.schema["doc"], T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    out = _met(texts).mapInArrow(frugal(run), schema)
    value = {c: F.col(f"doc.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(value["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(value[c].alias(c) for c in docs.columns))


def op5_substring(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).drop("text_key")
