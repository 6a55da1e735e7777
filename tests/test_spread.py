"""Documents out of one small file are parsed by as many tasks as a shuffle has."""

import pytest
from fadeline.plans.experiments import BASE_CONFIG
from fadeline.sources import configs
from pyspark.sql import functions as F


@pytest.mark.parametrize("way", ["configurations", "merged"])
def test_documents_of_one_task_are_dealt_to_many(spark, way):
    docs = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("path"), F.format_string('{"lr": 0.0%d, "dropout": "x"}', F.col("id") % 9 + 1).alias("value"))
    if way == "merged":
        rows = configs.merged(docs, BASE_CONFIG)
    else:
        rows = configs.entries(docs.withColumn("value", F.concat(F.lit("["), "value", F.lit("]"))))
    own = rows.select("path", F.spark_partition_id().alias("task")).collect()
    assert sorted(int(r.path) for r in own) == list(range(400))
    assert len({r.task for r in own}) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
