"""Matches of op5: seeds of partners, extension both ways, maximal repeats against a plain version."""

import collections
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fadeline.llm import substring

W = substring.WINDOW


def maximal_matches(texts):
    """(doc, start, n, other, other_start) of all pairs of places whose W words or more agree and cannot go on together, by every diagonal."""
    out = set()
    for a, u in enumerate(texts):
        for b, v in enumerate(texts):
            for shift in range(-len(u) + 1, len(v)):
                if a == b and shift == 0:
                    continue
                run = 0
                for i in range(max(0, -shift), min(len(u), len(v) - shift) + 1):
                    if i < min(len(u), len(v) - shift) and u[i] == v[i + shift]:
                        run += 1
                        continue
                    if run >= W:
                        out.add((a, i - run, run, b, i - run + shift))
                    run = 0
    return out


def covered(matches, sizes):
    out = [[False] * n for n in sizes]
    for doc, start, n, *_ in matches:
        out[doc][start : start + n] = [True] * n
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.start, r.n, r.other_id, r.other_start) for r in substring.maximal_repeats(docs).collect()]
    want = maximal_matches(texts)
    assert len(got) == len(set(got)) and set(got) <= want
    sizes = [len(t) for t in texts]
    assert covered(got, sizes) == covered(want, sizes)
    windows = collections.Counter(tuple(t[k : k + W]) for t in texts for k in range(len(t) - W + 1))
    for doc, t in enumerate(texts):
        own = [(start, start + n) for d, start, n, *_ in got if d == doc]
        for k in range(len(t) - W + 1):
            assert (windows[tuple(t[k : k + W])] > 1) == any(a <= k and k + W <= b for a, b in own)
    return got


def test_maximal_repeats_against_every_diagonal(spark):
    rng = random.Random(4)
    word = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passages = [word(n) for n in (34, 35, 36, 80, 150)]
    texts = [word(rng.randrange(20)) + list(rng.choice(passages)) + word(rng.randrange(3)) + list(rng.choice(passages)) + word(rng.randrange(20)) for _ in range(30)]
    for k in range(0, 30, 4):
        texts[k][rng.randrange(len(texts[k]))] = f"changed{k}"
    texts += [passages[4][5:70], passages[4][40:140], passages[3] + passages[4], list(texts[0]), list(texts[0])]
    got = check(spark, texts)
    assert any(n > 150 for _, _, n, *_ in got)


def test_matches_go_on_past_what_was_fetched_first(spark):
    """A long passage whose stretches have other first places: the match with each must still end where the words differ."""
    rng = random.Random(5)
    long = [f"x{k}" for k in range(700)]
    texts = [long[300:340] + ["a"], long[330:380] + ["b"], ["c", *long], [*long[:690], "d"], ["e", *long[2:]]]
    texts += [[f"y{rng.randrange(9)}" for _ in range(60)]]
    got = check(spark, texts)
    assert (3, 0, 690, 2, 1) in got


def test_periodic_texts_match_themselves_along_one_diagonal(spark):
    texts = [["a"] * 300, ["a", "b", "c"] * 60, ["a"] * 34, ["a"] * 35 + ["z"]]
    got = check(spark, texts)
    assert len([g for g in got if g[0] == 0]) <= 3


def test_no_matches(spark):
    for texts in ([], [["a"] * 34], [[f"u{k}" for k in range(200)]]):
        assert check(spark, texts) == []
    odd = spark.createDataFrame([(None, None), (1, ""), (None, " ".join(f"p{k}" for k in range(40))), (None, " ".join(f"p{k}" for k in range(40)))], "doc_id long, text string")
    assert sorted((r.start, r.n, r.other_start) for r in substring.maximal_repeats(odd).collect()) == [(0, 40, 0)] * 2


@given(st.lists(st.integers(0, 1), min_size=0, max_size=60), st.lists(st.integers(0, 1), min_size=0, max_size=60))
@settings(max_examples=50, deadline=None)
def test_partners_are_other_places_of_the_same_words(u, v):
    window = 3
    places = collections.defaultdict(list)
    for row, t in ((7, u), (9, v)):
        for k in range(len(t) - window + 1):
            places[tuple(t[k : k + window])].append((row, k))
    rows = [(row, k, 1, *min(p), *max(p)) for p in places.values() if len(p) > 1 for row, k in p]
    found = substring.partners(*np.array(rows, np.int64).reshape(-1, 7).T)
    text = {7: u, 9: v}
    met = []
    for row, start, n, prow, pstart in zip(*(x.tolist() for x in found), strict=True):
        assert (row, start) != (prow, pstart)
        assert text[row][start : start + n + window - 1] == text[prow][pstart : pstart + n + window - 1]
        met += [(row, start + k) for k in range(n)]
    assert sorted(met) == sorted(r[:2] for r in rows)
