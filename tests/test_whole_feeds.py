"""Whole feeds: ranked as numbers, one array for each profile."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meritlake.operators import matching
from meritlake.plans import domain, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [queries.whole_feed, queries.whole_tiered_feed])
def test_pairs_of_a_whole_feed_are_not_sorted_as_rows(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]


def test_whole_feeds_are_ranked_by_score_award_and_number(spark):
    u, o = domain.profiles(spark, SF), domain.opportunities(spark, SF).withColumn("award", F.expr("case opp_id % 4 when 0 then null when 1 then -7 else opp_id % 3 end"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc(F.coalesce("award", F.lit(0))), "opp_id")
    pairs = matching.eligible_pairs(matching.ready_profiles(u), matching.ready_opportunities(o))
    got = sorted(map(str, matching.ranked_pairs(u, o).select("user_id", "opp_id", "award", "score", "rank").collect()))
    assert got == sorted(map(str, pairs.withColumn("rank", F.row_number().over(order)).select("user_id", "opp_id", "award", "score", "rank").collect())) and got
