"""The pipeline, stage by stage, against plain versions of each; and the SQL of queries that have one."""

import os
import re

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import base_spans, fingerprint, removed

from fadeline.llm.common import materialise
from fadeline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), made.collect())
        docs = made
    return out


def test_quality_rejects_low_labels(spark, stages):
    given, kept = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept}
    marked = [r.doc_id for r in given if r.doc_id in labels]
    assert np.mean([(d in ids) == bool(labels[d]) for d in marked]) > 0.95
    assert {r.doc_id: r for r in kept}.items() <= {r.doc_id: r for r in given}.items()


def test_one_of_each_group_stays(stages):
    given, kept = stages["near_duplicates"]
    fp = {r.doc_id: fingerprint(r.text or "") for r in given}
    root = {d: d for d in fp}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in kept) == sorted({top(d) for d in fp})


def test_repeats_go(stages):
    given, kept = stages["repeated_passages"]
    want = dict(zip((r.doc_id for r in given), removed([r.text or "" for r in given]), strict=True))
    texts = {r.doc_id: r.text for r in given}
    assert len(kept) == len(given)
    for r in kept:
        n, gone, _ = want[r.doc_id]
        assert r.text == texts[r.doc_id] if gone == 0 else len(r.text.split()) == n - gone and r.n_chars == len(r.text)


def test_personal_data_goes(stages):
    given, kept = stages["personal_data"]
    texts = {r.doc_id: r.text for r in given}
    for r in kept:
        spans = base_spans(texts[r.doc_id] or "")
        if not spans:
            assert r.text == texts[r.doc_id]
        out, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                out += texts[r.doc_id][at:a] + f"<{kind}>"
            at = max(at, b)
        assert r.text == out + (texts[r.doc_id] or "")[at:]


def test_every_token_is_packed(stages):
    from tokenizers import Tokenizer

    given, pieces = stages["packing"]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {}
    for r in pieces:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in given}
    assert len({r.sequence_id for r in pieces}) <= sum(lengths.values()) / 2048 * 1.03 + 1


def test_run_is_its_stages(spark, stages):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages["packing"][1]))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, got = QUERIES[name](spark, SF), db.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(got.fetchall(), key=repr)


def test_registered_queries_return_their_contract(spark):
    rows = QUERIES["op5_substring"](spark, SF)
    assert rows.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and all(re.fullmatch("[0-9a-f]{64}", r.kept_sha256) for r in rows.collect())
    columns = {n: QUERIES[n](spark, SF).dtypes for n in ("op1_urls", "op3_topk", "op4_nearest", "op6_pii", "op8_packing", "op9_simhash", "op10_quality")}
    assert columns["op1_urls"][:5] == [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]
    assert columns["op3_topk"] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert columns["op4_nearest"] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert columns["op6_pii"] == [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k in ("email", "ip", "card", "phone")), ("base_sha256", "string"), ("spans", "string")]
    assert columns["op8_packing"] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    assert columns["op9_simhash"] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert columns["op10_quality"] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
