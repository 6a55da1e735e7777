"""URL rules word by word as their contract lists them, in the query and in its SQL."""

import duckdb
import pytest

from fadeline.llm.queries import ORACLE_SQL, QUERIES
from fadeline.llm.urls import RULES

CONTRACT = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_rules_are_those_of_the_contract():
    assert list(RULES) == CONTRACT


@pytest.mark.parametrize("way", ["query", "sql"])
def test_verdicts_of_every_rule(spark, tmp_path, way):
    urls = ["http://a.com/en/1", "http://x.example.com/en/70", "http://a.net/de/1", "http://example.net/de/81", "http://b.example.net/de/9", "http://a.org/es/"]
    spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    if way == "query":
        got = [(r.rule, r.verdict) for r in QUERIES["op1_urls"](spark, str(tmp_path)).orderBy("page_id").collect()]
    else:
        with duckdb.connect() as db:
            db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
            got = db.execute(f"SELECT rule, verdict FROM ({ORACLE_SQL['op1_urls']}) ORDER BY page_id").fetchall()
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
