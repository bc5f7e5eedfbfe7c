"""A limited feed is ranked within the tasks in which its pairs meet."""

from __future__ import annotations

from meritlake.plans import queries

SF = "/root/testdata/sf0.001"


def test_pairs_of_a_limited_feed_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.match_feed(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffle = next(k for k, line in enumerate(plan) if "Exchange hash" in line)
    assert any("BroadcastHashJoin [gate" in line for line in plan[:shuffle])
