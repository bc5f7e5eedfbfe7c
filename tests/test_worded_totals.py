"""Totals of feeds for a word, from counts, against all pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meritlake.operators import matching
from meritlake.plans import domain, queries_more

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("word", ["ring", "gpa", "yours is 1", "france", "financial need", "a", "nothing says this"])
def test_totals_for_a_word_are_those_of_all_pairs(spark, monkeypatch, word):
    sides = domain.profiles(spark, SF), domain.opportunities(spark, SF)
    monkeypatch.setattr(matching, "LOOKS_A_TASK", 1000)
    got = sorted(tuple(r) for r in matching.worded_totals(*sides, word, keep=("u_tier",)).collect())
    pairs = matching.worded_pairs(*sides, word, keep=("u_tier",)).where("in_area")
    want = pairs.groupBy("user_id").agg(F.count(F.lit(1)), F.sum(F.coalesce("award", F.lit(0))).cast("long"), F.max("score"), F.first("u_tier"))
    assert got == sorted(tuple(r) for r in want.collect()) and bool(got) == (word != "nothing says this")


def test_a_feed_for_a_word_is_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "LOOKS_A_TASK", 1000)
    monkeypatch.setattr(matching, "flagged_pairs", None)
    assert queries_more.feed_pages(spark, SF).columns == ["user_id", "total", "visible", "worth", "best"]
