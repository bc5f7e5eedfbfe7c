"""Matching by signatures against every pair of rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meritlake.operators import matching, signatures
from meritlake.sources.tables import numbered

PROFILE = "user_id long, u_disciplines array<string>, u_credentials array<string>, u_level string, u_gpa double, u_state string, u_metro string, u_sai int, u_affiliations array<string>, u_tags array<string>"
OPPORTUNITY = "opp_id long, award int, min_gpa double, max_sai int, o_disciplines array<string>, o_credentials array<string>, o_levels array<string>, o_states array<string>, o_metros array<string>, o_required array<string>, o_tags array<string>, o_competition string"


def some(rng, labels, most, null=0.05):
    return [rng.choice([*labels, None]) if rng.random() < null else rng.choice(labels) for _ in range(rng.randrange(most + 1))]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    states, metros = [f"S{k}" for k in range(20)], [f"m{k}" for k in range(20)]
    users = [
        (k, some(rng, "abc", 2), some(rng, "xy", 1), rng.choice(["l1", "l2", None]), rng.choice([None, 2.0, 2.5, 3.0, 3.7]), rng.choice([*states, None]), rng.choice([*metros, None]), rng.choice([None, -5, 0, 1000, 5000]), some(rng, "pqr", 2), some(rng, "tuv", 2))
        for k in range(120)
    ]
    offers = [
        (k, rng.choice([None, 0, 100, 250]), rng.choice([None, 0.0, 2.5, 3.0]), rng.choice([None, 0, 1000]), some(rng, "abc", 2), some(rng, "xy", 1), some(rng, ["l1", "l2"], 1), sorted(rng.sample(states, rng.randrange(8))), sorted(rng.sample(metros, rng.randrange(8))) if k % 2 else [], sorted(set(some(rng, "pqr", 2, 0))), some(rng, "tuv", 2), rng.choice(["low", "medium"]))
        for k in range(1500)
    ]
    return spark.createDataFrame(users, PROFILE), spark.createDataFrame(offers, OPPORTUNITY)


def plain(sides):
    """Every pair, by the tests on labels themselves."""
    u, o = sides
    pairs = u.join(o.withColumns({"metros": F.col("o_metros"), "states": F.col("o_states")}), how="cross").where(F.coalesce(matching.discipline_gate() & matching.credential_gate() & matching.level_gate(), F.lit(False)))
    return matching.with_scores(pairs)


def test_counts_by_score_without_pairs(sides):
    got = {(r["user_id"], r["score"]): (r["n"], r["total"]) for r in signatures.score_counts(signatures.coded(*sides)).collect()}
    want = {(r["user_id"], r["score"]): (r["n"], r["total"]) for r in plain(sides).groupBy("user_id", "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("award", F.lit(0))).alias("total")).collect()}
    assert got == want and len(want) > 400


def test_pairs_have_the_same_scores(sides):
    rows = lambda df: sorted(tuple(r) for r in df.select("user_id", "opp_id", "score").collect())
    assert rows(matching.eligible_pairs(*sides)) == rows(plain(sides))


def test_nothing_meets_nothing(sides):
    u, o = sides
    assert matching.feed_totals(u.where("false"), o).count() == 0 == matching.feed_totals(u, o.where("false")).count()


def test_ten_thousand_places_without_a_product_of_rows(spark):
    rng = random.Random(7)
    states = [f"S{k}" for k in range(60)]
    users = [(k, [], [], None, 3.0, states[k % 60], None, 100, [], []) for k in range(3000)]
    offers = [(k, 1, None, None, [], [], [], sorted(rng.sample(states, 4)), [], [], [], "low") for k in range(10_000)]
    u, o = spark.createDataFrame(users, PROFILE), spark.createDataFrame(offers, OPPORTUNITY)
    c = signatures.coded(u, o)
    assert c.fits.where("relation = 'place'").count() == 60  # kinds of profiles, not profiles
    totals = matching.feed_totals(u, o)
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    got = {r["user_id"]: (r["n"], r["best"], r["perfect"]) for r in totals.collect()}
    assert got == {k: (10_000, 85, 0) for k in range(3000)}


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).repartition(5).selectExpr("id", "id % 3 as kind")
    for kind in range(3):
        assert sorted(r["n"] for r in numbered(df, "n", "kind").where(f"kind = {kind}").collect()) == list(range(334 if kind == 0 else 333))
    assert numbered(df.where("false"), "n", "kind").count() == 0
