"""Baselines of rows that come out a little different each time they are computed, as means over executors do."""

from fadeline.operators import ranking, rollup
from pyspark.sql import functions as F


def shaky(spark):
    def run(batches):
        import random

        for batch in batches:
            batch["mae"] += random.SystemRandom().random() * 1e-9
            yield batch

    rows = [(h, m, 0.5 + m) for h in range(8) for m in range(4)] + [(None, 0, 0.5), (None, 1, 0.4)]
    return spark.createDataFrame(rows, "horizon int, model int, mae double").mapInPandas(run, "horizon int, model int, mae double")


def test_a_baseline_does_not_gain_on_itself(spark):
    rows = rollup.against_baseline(shaky(spark), ("horizon",), "mae", 0)
    own = rows.filter("model = 0").select("gain", "gain_percent", "skill").collect()
    assert len(own) == 9 and {tuple(r) for r in own} == {(0.0, 0.0, 0.0)}
    first = ranking.winners_first(rows, "gain", [F.col("horizon").asc_nulls_last(), "model"]).limit(3).select("horizon", "model").collect()
    assert [tuple(r) for r in first] == [(None, 1), (0, 0), (0, 1)]


def test_gaps_of_a_baseline_to_itself_are_none(spark):
    own = rollup.gaps(shaky(spark), ("horizon",), ("mae",), 0).filter("model = 0").select("mae_gap", "mae_ratio").collect()
    assert len(own) == 9 and {tuple(r) for r in own} == {(0.0, 1.0)}
