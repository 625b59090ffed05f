"""Both ways of bringing a per-key value to rows give the same rows; a hot key is spread."""

import re

import pytest
from pyspark.sql import functions as F

from incidentkit.operators import beside as B


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_both_ways_agree(spark, monkeypatch, how):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 97).otherwise(7).alias("k"), "id")
    per_key = rows.where("k < 50").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = sorted(map(tuple, B.beside(rows, per_key, ["k"], how).collect()))
    monkeypatch.setattr(B, "BROADCAST_KEYS", 0)
    large = sorted(map(tuple, B.beside(rows, per_key, ["k"], how).collect()))
    assert small == large == sorted(map(tuple, rows.join(per_key, ["k"], how).collect()))


def test_hot_key_is_spread(spark, monkeypatch):
    """Without broadcast no partition holds more than a few shares of a key with nine rows in ten."""
    monkeypatch.setattr(B, "BROADCAST_KEYS", 0)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 997).otherwise(7).alias("k"), "id")
        joined = B.beside(rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and re.search("SortMergeJoin|ShuffledHashJoin", plan)
        assert max(sizes) < 0.6 * 200_000 and sum(sizes) == 200_000
    finally:
        for k in off:
            spark.conf.unset(k)
