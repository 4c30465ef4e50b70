"""Scratch folders and settled tables."""

import pytest
from pyspark.sql import functions as F

from wardlight import session as S


class FakeContext:
    master = "spark://cluster:7077"

    def getConf(self):
        return {}


class FakeSession:
    sparkContext = FakeContext()

    def __init__(self, root):
        self.conf = {"spark.checkpoint.dir": root} if root else {}


def test_named_folder_is_used():
    path = S.scratch_dir(FakeSession("hdfs://shared/scratch/"), "t")
    assert path.startswith("hdfs://shared/scratch/t-")
    assert path != S.scratch_dir(FakeSession("hdfs://shared/scratch/"), "t")


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError):
        S.scratch_dir(FakeSession(None), "t")


def test_settled_aggregate_is_broadcast_by_its_size(spark):
    fact = spark.range(1000).withColumn("k", F.col("id") % 7)
    means = S.settle(fact.groupBy("k").agg(F.avg("id").alias("m")), "means")
    joined = fact.join(means, "k")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "SortMergeJoin" in fact.join(means, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
