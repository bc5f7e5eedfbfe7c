"""Pages that share an address, sums of many digits, and ampersands that begin no reference."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from meritlake.functions import labelled, parsing
from meritlake.operators import crawling, ingesting, writing
from meritlake.sources import readers


def test_each_fetch_of_an_address_has_a_row(spark):
    pages = spark.createDataFrame([(2, "a", "x")], "page_id long, url string, html string")
    wanted = spark.createDataFrame([(1, "a"), (2, "a")], "page_id long, url string")
    got = readers.fetched(wanted, pages)
    assert sorted((r["page_id"], r["ok"]) for r in got.collect()) == [(1, False), (2, True)]
    codes = spark.createDataFrame([("a", 200), ("a", 404)], "url string, code int")
    errors = readers.fetch_errors(got, codes).select("page_id", "error").collect()
    assert sorted((r["page_id"], str(r["error"])) for r in errors) == [(1, "empty"), (1, "http"), (2, "None"), (2, "http")]


def test_each_check_of_an_address_has_its_code(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "a")], "page_id long, url string")
    answers = spark.createDataFrame([(1, "a", 404, None), (2, "a", 200, None)], "page_id long, url string, head int, get int")
    assert sorted(tuple(r) for r in crawling.link_codes(asked, answers, "page_id").collect()) == [("a", 200), ("a", 404)]


def test_a_link_is_valid_if_one_check_of_its_address_is(spark):
    asked = spark.createDataFrame([(1, "http://h/a"), (2, "http://h/a")], "page_id long, url string")
    answers = spark.createDataFrame([(1, "http://h/a", 200, None), (2, "http://h/a", 405, 500)], "page_id long, url string, head int, get int")
    links = spark.createDataFrame([("http://h/a", "http://h/a")], "url string, source string")
    assert [r["is_valid"] for r in crawling.verified(links, crawling.link_codes(asked, answers, "page_id")).collect()] == [True]


def test_pages_are_checked_by_number(spark):
    from meritlake.plans import domain, queries_more

    pages = domain.table(spark, "/root/testdata/check_s", "pages")
    assert queries_more.link_codes(spark, "/root/testdata/check_s").count() == pages.count() + 1


def test_the_first_source_of_an_address_counts(spark):
    page = spark.createDataFrame([(1, "a", "t", 1, dt.date(2026, 1, 1), [], [], [], None)], "page_id long, url string, title string, award int, deadline date, disciplines array<string>, credentials array<string>, metros array<string>, state string")
    rows = [("a", n, f"Source {n}", "registry", "any", ["RN"], None) for n in (10, 9)]
    sources = spark.createDataFrame(rows, "url string, nth long, name string, category string, primary_discipline string, target_credentials array<string>, state_restriction string")
    assert [r["provider"] for r in ingesting.completed(page, sources).collect()] == ["Source 9"]


def test_sums_of_many_digits_are_kept(spark):
    rows = spark.createDataFrame([("$1142126282388588",), ("$99,999,999,999,999,999,999.5",), ("$5,000.75",)], "x string")
    assert [r[0] for r in rows.select(parsing.amount(F.col("x"))).collect()] == [1142126282388588, Decimal("99999999999999999999"), 5000]


def test_an_upsert_may_go_by_some_columns(spark):
    now = spark.createDataFrame([("k", 1, 2)], "k string, a int, b int")
    new = spark.createDataFrame([("k", 1, 3, 1)], "k string, a int, b int, nth int")
    assert [(r["b"], r["action"]) for r in writing.upsert(now, new, ["k"], "nth", judged=["a"]).collect()] == [(3, "unchanged")]


def test_only_whole_references_are_read(spark):
    page = labelled.Page('<title>A &amp;&amp &lt;b&gt; &eacute;</title><a href="/x?a=1&amp;b=2&lt">l</a>')
    assert page.first("title") == "A &&amp <b> é" and page.links() == ["/x?a=1&b=2&lt"]
