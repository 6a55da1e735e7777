"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fadeline.plans.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 5)
    return v


def rows(names, table):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in table), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = db.execute(ORACLE[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"regression_metrics"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_one_exchange_per_sequence(spark):
    """A chain of window operators over one sequence shuffles it once."""
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    plan = QUERIES["persistence_h10"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_whole_queries_read_every_order(spark, db):
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    (n,) = db.execute("SELECT count(*) FROM (SELECT DISTINCT l_suppkey % 4, l_partkey % 5 = 0, l_orderkey FROM lineitem WHERE l_suppkey % 4 <> 0)").fetchone()
    assert QUERIES["global_test_rank"](spark, SF).count() == n


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_isolation_scores_of_every_vector(spark, db):
    own = QUERIES["isolation_scores"](spark, SF).collect()
    usable = db.execute("SELECT vec_id, embedding IS NOT NULL AND len(embedding) > 0 FROM embeddings").fetchall()
    assert sorted(r.vec_id for r in own) == sorted(v for v, _ in usable)
    assert all(r.latent_score is None or 0 < r.latent_score < 1 for r in own) and any(r.latent_score for r in own)
