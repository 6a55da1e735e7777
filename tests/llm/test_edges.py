"""Every operator and stage over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fadeline.llm import mih, packing, pii, quality, simhash, spm, substring, topk, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 30_000
ROWS = [
    (1, "The first text mentions a@b.cc and 1.2.3.4 here.", "en", "s", 10),
    (1, "The first text mentions a@b.cc and 1.2.3.4 here.", "en", "s", 10),
    (2, None, "en", None, None),
    (3, "", None, "s", 0),
    (None, "no id", "en", "s", 5),
    (None, None, None, None, None),
    (4, LONG, "de", "s", len(LONG)),
    (5, " \t\n ", "en", "s", 4),
    (6, "x" * 50_000, "en", "s", 50_000),
    (6, "same id, another text", "en", "s", 21),
]
CLASH = ("text_key", "key", "id", "doc", "row", "spans", "base", "own", "own_id", "own_key", "seed", "stretch", "score", "fp", "component_id", "keep_id", "keep_key", "kept", "n_removed", "label", "toxic")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")


def wide(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


def operators(labels, docs):
    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    return {
        "spm": lambda d: spm.encode_documents(d, model),
        "substring": substring.without_repeats,
        "pii": lambda d: pii.find_pii(d).select("doc_id", "text_key", F.size("spans")),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "packing": lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")),
        "simhash": simhash.near_duplicates,
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
    }


@pytest.mark.parametrize("name", ["spm", "substring", "pii", "toxicity", "packing", "simhash", "quality"])
def test_odd_rows_and_clashing_columns(name, docs, labels):
    run = operators(labels, docs)[name]
    drop = {"sequence_id", "offset"}
    plain = [tuple(v for k, v in r.asDict().items() if k not in drop) for r in run(docs).collect()]
    clash = [tuple(v for k, v in r.asDict().items() if k not in drop) for r in run(wide(docs)).collect()]
    assert sorted(plain, key=repr) == sorted(clash, key=repr)
    if name != "packing":
        assert len(plain) == len(ROWS)
    else:
        ends = {}
        for r in sorted(run(docs).collect(), key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= packing.CAPACITY
            ends[r.sequence_id] = r.offset + r.length
    assert run(docs.limit(0)).collect() == []


def test_rows_of_odd_texts(docs):
    got = {(r.doc_id, r.n_words): r for r in substring.without_repeats(docs).collect()}
    assert got[(4, 30_000)].n_removed == 30_000  # every window of one repeated word starts elsewhere too
    assert got[(2, 0)].text == got[(5, 0)].text == ""
    near = simhash.near_duplicates(docs).collect()
    assert {r.fp for r in near if r.doc_id in (2, 3, 5)} == {0}
    assert {r.component_id for r in near if r.fp == 0} == {2}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, labels, name, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    wider = stage(spark, wide(docs), str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns and wider.columns == wide(docs).columns
        assert len(wider.collect()) == len(rows)
    if name == "near_duplicates":
        assert len(rows) < len(ROWS) and len({r.doc_id for r in rows if r.doc_id == 1}) == 1 == sum(r.doc_id == 1 for r in rows)
    if name == "personal_data":
        assert {r.text for r in rows if r.doc_id == 1} == {"The first text mentions <email> and <ip> here."}
        assert sum(r.text is None for r in rows) == 2
    if name == "repeated_passages":
        assert {r.text for r in rows if r.doc_id == 4} == {""} and len(rows) == len(ROWS)


VECTORS = [
    (20, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
    (7, [0.0, 0.0]), (8, []), (9, [0.5]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (40, [1e30, -1e30]),
]


def test_vectors(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    rows = topk.exact_top_k(v, lambda c: c % 20 == 0, 3).collect()
    assert {r.query_id for r in rows} == {0, 20, 40}
    assert [(r.rank, r.vec_id, r.score) for r in sorted(rows) if r.query_id == 20] == [(1, 40, None), (2, 0, 2048), (3, 1, 2048)]  # 64 * 64e30 is beyond 64 bits
    rows = mih.nearest(v, lambda c: c % 20 == 0, 3).collect()
    assert [(r.rank, r.vec_id) for r in sorted(rows) if r.query_id == 0] == [(1, 1), (2, 1), (3, 2)]
    assert not {7, 8, 3, 4, 5, 6} & {r.vec_id for r in rows}
    for empty in (v.limit(0), v.filter("vec_id = 20"), v.filter("vec_id = 3")):
        assert topk.exact_top_k(empty, lambda c: c % 20 == 0, 3).collect() == []
        assert mih.nearest(empty, lambda c: c % 20 == 0, 3).collect() == []


def test_one_vector_of_great_width(spark):
    rows = [(k, [float(k % 7), 1.0]) for k in range(120)] + [(500, [1.0] + [0.0] * 30_000 + [2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(topk.exact_top_k(v, lambda c: c == 500, 2).collect())
    assert [(r.vec_id, r.score) for r in got] == [(6, 64 * 64 * 6), (13, 64 * 64 * 6)]
    got = sorted(mih.nearest(v, lambda c: c == 20, 2).collect())
    assert [r.vec_id for r in got] == [6, 13] and got[0].score == pytest.approx(1.0)


def test_urls(spark):
    rows = [(1, "https://A.Example.com/en/7x?q", "<a href='http://bad.net/de/'>"), (2, None, None), (3, "nohost", None), (4, "http://x.org?/es/", ""), (5, "http://bad.net/de/1", None),
            (6, "http://mid.zz/a", '<a href="//bad.net/x"><a href=https://good.zz/>'), (7, "http://xcom/en/1", ""), (8, "http://com/en/", ""), (8, "http://com/en/", ""), (9, "a://B#://c", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("x.org", "", None, "allow"), 5: ("bad.net", "/de/1", "net/de/", "block"),
        6: ("mid.zz", "/a", None, "block"), 7: ("xcom", "/en/1", None, "allow"), 8: ("com", "/en/", "com/en/", "block"), 9: ("b", "", None, "allow"),
    }
    assert urls.judge(pages).count() == len(rows)
    assert urls.judge(pages.limit(0)).collect() == []
