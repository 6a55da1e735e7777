"""Filter interactions, target resampling and token files against plain versions; and workers that are never reused."""

import collections
import hashlib
import itertools
import json
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fadeline.llm import interactions, resample, tokenfiles
from fadeline.llm.eliasfano import EliasFano
from fadeline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "The first text, the FIRST.", "en", "s", 10), (1, "The first text, the FIRST.", "en", "s", 10), (2, None, "en", None, None), (3, "", None, "s", 0), (None, "no id at all", "en", "s", 5),
    (None, None, None, None, None), (4, "wort " * 30_000, "de", "s", 1), (5, " \t\n ", "", "s", 4), (6, "x" * 50_000, "en", "s", 50_000), (6, "same id, another text #", "en", "s", 21),
    (7, "The first text, the FIRST.", "de", "s", 10), (-3, "É ß a_b c\x1cd", "en", "s", 9), (8, " ".join(f"w{k}" for k in range(150)), "en", "s", 9), (9, " ".join(f"w{k}" for k in range(150)), "de", "s", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def wide(df):
    names = ("text_key", "bits", "mask", "first", "part", "part2", "n", "sums", "grams", "counts", "score", "place", "rank", "ids", "own_id", "key", "id", "doc")
    return df.select("*", *(F.lit("clash").alias(c) for c in names))


# --- filter interactions ---


def failing(rows):
    """The set of filters that each row (doc_id, text, part) fails, from the contract's words."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t) is not None, d is not None and d > first[t])
        out.append({c for c, no in zip("ABCDE", tests, strict=True) if no})
    return out


def plain_audit(rows, labels):
    good, toxic = ({d for d, *y in labels if d is not None and y[k] == 1} for k in (0, 1))
    fails, out = failing(rows), []
    for part in {p or "" for *_, p in rows}:
        own = [(d, f) for (d, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        found = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                earlier = set(order[:k])
                found.append(["".join(order), k + 1, len(left), len(gone), sum(c in f and bool(f & earlier) for _, f in own), sum(f == {c} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
        total = collections.Counter()
        for o, k, _, gone, *_ in found:
            total[o[k - 1]] += gone
        out += [(part, *x, total[x[0][x[1] - 1]]) for x in found]
    return sorted(out)


def test_audit_against_every_order(spark, odd):
    rng = random.Random(5)
    rows = [(d, t, p, "s", 0) for d, t, p, *_ in ODD]
    for k in range(150):
        n = rng.choice((5, 90, 99, 100, 101, 200))
        words = [rng.choice((f"w{rng.randrange(n + 1)}", f"v{j}")) for j in range(n)]
        if k % 3 == 0:
            words = [w.upper() for w in words[: n // 4]] + words[n // 4 :]
        if k % 7 == 0:
            words[0] += rng.choice("#$%&*|")
        rows.append((100 + k, " ".join(words) if k % 5 else "the same text again and again", rng.choice(("en", "de", None, "")), "s", 0))
    labels = [(r[0], rng.choice((0, 1, None)), rng.choice((0, 1))) for r in rows if rng.random() < 0.6] + [(100, 1, 0), (100, 0, 1), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.audit(spark.createDataFrame(rows, DOCS), lab).collect()
    assert sorted(map(tuple, got)) == plain_audit([(d, t, p) for d, t, p, *_ in rows], labels)
    assert sorted(map(tuple, interactions.audit(wide(odd), lab).collect())) == plain_audit([r[:3] for r in ODD], labels)
    assert interactions.audit(odd.limit(0), lab).collect() == []
    assert sorted(map(tuple, interactions.audit(odd, lab.limit(0)).collect())) == plain_audit([r[:3] for r in ODD], [])


def test_transform_is_inverted_exactly(spark):
    counts = {m: (m * 7919) % 13 for m in range(32)}
    rows = spark.createDataFrame([(k * 100 + m, "x", m) for m, n in counts.items() for k in range(n)], "doc_id long, part string, mask int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sums = interactions.transformed(rows, labels)
    assert sums.first().sums == [sum(n * (-1) ** (m & s).bit_count() for m, n in counts.items()) for s in range(32)]
    assert {r.mask: r.n for r in interactions.cells(sums).collect()} == counts


# --- resampling ---


def plain_grams(text, most_n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[k : k + n]) for n in range(1, most_n + 1) for k in range(len(w) - n + 1)]


def plain_resample(rows, target, most_n=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    grams = [plain_grams(t, most_n) for _, t in rows]
    s = collections.Counter(bucket(g) for _, own in grams for g in own)
    t = collections.Counter(bucket(g) for x in target for g in plain_grams(x, most_n)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (d, _), (w, own) in zip(rows, grams, strict=True):
        weight = math.floor(sum(gain[bucket(g)] for g in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in out if x[-1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:-1]) for x in out), key=repr)


@pytest.mark.parametrize("most_n", [1, 3])
def test_resample_against_plain(spark, odd, most_n):
    rng = random.Random(most_n)
    rows = [(d, t) for d, t, *_ in ODD] + [(100 + k, " ".join(rng.choice(("Wa", "wb", "É", "x9", "ganz")) + str(rng.randrange(9)) for _ in range(rng.choice((0, 3, 19, 20, 21, 60))))) for k in range(200)]
    target = ["wa1 wb2 É3", None, "", "ganz ganz1 ganz1"]
    names = ("doc_id", "n_features", "weight", "score", "rank")
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    for table in (docs, wide(docs)):
        got = resample.resample(table, aim, most_n=most_n).select(*names).collect()
        assert sorted(map(tuple, got), key=repr) == plain_resample(rows, [t or "" for t in target], most_n)
    best = resample.drawn(docs, aim, most_n=most_n)
    assert best.columns == docs.columns and {r.doc_id for r in best.collect()} == {r.doc_id for r in got if r.rank}
    assert resample.resample(docs.limit(0), aim).collect() == []
    none = resample.resample(odd, aim.limit(0)).select(*names).collect()
    assert sorted(map(tuple, none), key=repr) == plain_resample([r[:2] for r in ODD], [])


@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=6), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_runs_are_the_different_ngrams(texts, depth):
    split = [[f"w{x}" for x in t] for t in texts]
    found, sizes = resample.bucketed([" ".join(t).encode() for t in split], depth, 97)
    want = [[zlib.crc32(" ".join(t[k : k + n]).encode()) % 97 for n in range(1, depth + 1) for k in range(len(t) - n + 1)] for t in split]
    assert [f.tolist() for f in found] == want and sizes.tolist() == [len(t) for t in texts]
    _, ids, starts = resample.numbered_words([" ".join(t).encode() for t in split])
    order, lcp, length = resample.suffix_array(ids, starts, depth)
    suffixes = sorted(tuple(t[k : k + depth]) for t in split for k in range(len(t)))
    assert len(order) == len(suffixes) and sorted(length.tolist()) == sorted(map(len, suffixes))
    for n in range(1, depth + 1):  # one run per different n-gram
        assert int(((length >= n) & (lcp < n)).sum()) == len({s[:n] for s in suffixes if len(s) >= n})


# --- token files ---


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = np.array(sorted(values), np.uint64)
    own = EliasFano.of(values)
    again, end = EliasFano.read(b"xx" + own.tobytes(), 2)
    assert again.values().tolist() == values.tolist() and end == 2 + len(own.tobytes())
    assert [again.select(k) for k in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(1, 2000, 200_000)).astype(np.uint64)
    own = EliasFano.of(values)
    bits = 8 * (len(own.low) + len(own.high) + 4 * len(own.samples)) / len(values)
    assert bits < 2.3 + math.log2(int(values[-1]) / len(values)) and own.samples.dtype == np.dtype("<u4")
    assert all(own.select(k) == values[k] for k in rng.integers(0, len(values), 500).tolist())
    gap = np.array([0] * 300 + [1 << 40] * 300, np.uint64)
    assert [EliasFano.of(gap).select(k) for k in range(600)] == gap.tolist()
    with pytest.raises(IndexError):
        own.select(len(values))


def plain_ids(rows, tokenizer=TOKENIZER, end_id=2):
    own, out, at = Tokenizer.from_file(tokenizer), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, end_id]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_against_the_library(spark, odd, tmp_path, name):
    path = public_tokenizers.path(name)
    extra = [(20, "it's <|endoftext|>we'll<|endoftext|> 1234 don't", "en", "s", 0), (21, "Σ ΑΣ İ é ́x  y", "en", "s", 0)]
    docs = odd.unionByName(spark.createDataFrame(extra, DOCS)).filter("doc_id is null or doc_id not in (1, 6)")
    want = plain_ids([(r.doc_id, r.text) for r in docs.orderBy(F.asc_nulls_first("doc_id")).collect()], path)
    tokenfiles.write_ids(wide(docs), path, f"{tmp_path}/out")
    got = [tuple(r) for r in tokenfiles.read_ids(spark, f"{tmp_path}/out", keep_ids=True).orderBy("start").collect()]
    without = lambda rows: sorted(x[2:] for x in rows if x[0] is None)  # noqa: E731  documents without an id come in any order
    assert without(got) == without(want) and [x for x in got if x[0] is not None] == [x for x in want if x[0] is not None]


def test_token_files_roll_and_open_at_random(spark, tmp_path, monkeypatch):
    rows = [(k * 3 - 500, f"number {k} " * (k % 40)) for k in range(1000)]
    monkeypatch.setattr(tokenfiles, "FILE_DOCS", 37)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokenfiles.write_ids(docs, TOKENIZER, f"{tmp_path}/out")
    want = {x[0]: x for x in plain_ids(rows)}
    files = spark.read.parquet(f"{tmp_path}/out/manifest").orderBy("part", "number").collect()
    assert sum(f.n_docs for f in files) == 1000
    seen = []
    fs, root = tokenfiles.opened(f"{tmp_path}/out")
    for f in files:
        own = tokenfiles.FileReader(fs.open_input_file(f"{root}/{f.file}"))
        for k in reversed(range(own.n_docs)):
            assert own.document(k).tolist() == want[own.doc_id(k)][4]
        seen += [own.doc_id(k) for k in range(own.n_docs)]
    assert seen == sorted(want)
    got = {r.doc_id: tuple(r) for r in tokenfiles.read_ids(spark, f"{tmp_path}/out").collect()}
    assert got == {d: x[:4] for d, x in want.items()}


def test_repeated_rows_and_no_rows(spark, odd, tmp_path):
    tokenfiles.write_ids(odd, TOKENIZER, f"{tmp_path}/odd")
    got = tokenfiles.read_ids(spark, f"{tmp_path}/odd").orderBy("start").collect()
    assert len(got) == len(ODD) and [r.start for r in got] == list(itertools.accumulate((r.n_tokens for r in got[:-1]), initial=0))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((x[0] or 0, x[2], x[3]) for x in plain_ids([r[:2] for r in ODD]))
    tokenfiles.write_ids(odd.limit(0), TOKENIZER, f"{tmp_path}/none")
    assert tokenfiles.read_ids(spark, f"{tmp_path}/none").collect() == []


def test_half_written_files_are_refused(tmp_path):
    import pyarrow.fs

    whole = tmp_path / "a.ids"
    out = tokenfiles.FileWriter(pyarrow.fs.LocalFileSystem().open_output_stream(str(whole)), 2)
    out.add(1, b"\x01\x00")
    out.close()
    (tmp_path / "b.ids").write_bytes(whole.read_bytes()[:-3])
    with pytest.raises(ValueError):
        tokenfiles.FileReader(pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "b.ids")))


# --- fresh workers ---


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_queries_in_workers_that_are_never_reused():
    """Every training-data query, each Python task in a process of its own that has imported nothing yet."""
    code = f"""
import json
import __spark_entry__ as entry
from fadeline.session import session
spark = session("fresh", 4, **{{"spark.python.worker.reuse": "false"}})
spark.sparkContext.setLogLevel("ERROR")
print(json.dumps({{n: len(entry.queries()[n](spark, {SF!r}).collect()) for n in {sorted(QUERIES)!r}}}))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), env=os.environ, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    rows = json.loads(out.stdout.strip().splitlines()[-1])
    assert set(rows) == set(QUERIES) and all(rows.values())
