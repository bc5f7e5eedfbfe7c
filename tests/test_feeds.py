"""Feeds: limited ones in rounds, whole ones without a shuffle of pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meritlake.operators import matching
from meritlake.plans import domain as d
from meritlake.plans import queries, queries_more

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("with_dismissed", [False, True])
def test_rounds_give_what_the_whole_feed_begins_with(spark, monkeypatch, with_dismissed):
    monkeypatch.setattr(matching, "FIRST_ROWS", 8)
    monkeypatch.setattr(matching, "MORE_ROWS", 3)
    sides = d.profiles(spark, SF), d.opportunities(spark, SF)
    gone = d.trackings(spark, SF).where("is_dismissed") if with_dismissed else None
    rows = lambda df: sorted(tuple(r) for r in df.select("user_id", "rank", "opp_id", "score").collect())
    got = rows(matching.ranked_pairs(*sides, dismissed=gone, top=3))
    assert got == rows(matching.ranked_pairs(*sides, dismissed=gone).where("rank <= 3")) and got


def test_prefixes_are_in_the_order_of_feeds(spark, monkeypatch):
    monkeypatch.setattr(matching, "FIRST_ROWS", 8)
    monkeypatch.setattr(matching, "MORE_ROWS", 2)
    offered = spark.range(64).select(F.col("id").alias("opp_id"), F.when(F.col("id") % 3 > 0, 5).alias("award"))
    parts = [[r["opp_id"] for r in p.collect()] for p in matching._prefixes(offered)]
    whole = sorted(range(64), key=lambda k: (-5 if k % 3 else 0, k))
    assert len(parts) == 3 and all(sorted(p) == sorted(whole[: len(p)]) for p in parts) and len(parts[-1]) == 64 and len(parts[0]) < 16


@pytest.mark.parametrize("query", [queries.whole_feed, queries.whole_tiered_feed, queries_more.feed_pages])
def test_pairs_of_a_whole_feed_are_not_shuffled(spark, query):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffle = next(k for k, line in enumerate(plan) if "Exchange hash" in line)
    assert any("BroadcastHashJoin [gate" in line for line in plan[:shuffle])


def test_label_sets_of_given_pairs_are_joined_last(spark):
    sides = d.profiles(spark, SF), d.opportunities(spark, SF)
    pairs = d.trackings(spark, SF).select("user_id", "opp_id")
    got = matching.known_pairs(pairs, *sides)
    want = pairs.join(matching.ready_profiles(sides[0]), "user_id").join(matching.ready_opportunities(sides[1]), "opp_id").select(*got.columns)
    rows = sorted(map(repr, got.collect()))
    assert rows == sorted(map(repr, want.collect())) and rows


def test_arrays_of_profiles_do_not_move_with_given_pairs(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.score_tracked(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = [k for k, line in enumerate(plan) if "Exchange hashpartitioning(opp_id" in line]
    assert at and not any("u_disciplines" in plan[k + 1] or "u_tags" in plan[k + 1] for k in at)
