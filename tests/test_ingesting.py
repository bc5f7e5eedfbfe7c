"""Extraction, completion and persistence of pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meritlake.operators import ingesting

PAGE = "<html><title>{}</title><nav>Deadline: 2020-01-01</nav><p>Award: $2,500 for nursing students.</p><p>Deadline: {}</p></html>"


def test_sanitized(spark):
    rows = spark.createDataFrame([(["Public-Health Emergency", "law", "nursing", "nursing"], "x"), (["any"], "for pharmacists"), (None, None)], "l array<string>, t string")
    assert [r[0] for r in rows.select(ingesting.sanitized(F.col("l"), F.col("t"))).collect()] == [["public_health_emergency", "nursing"], ["pharmacy"], []]
    assert rows.select(ingesting.sanitized(F.col("l"), F.col("t"), keep_any=True)).collect()[1][0] == ["any"]


def test_pages_become_opportunities(spark):
    rows = [(1, "http://a ", PAGE.format("New", "March 1, 2026")), (2, "http://b", PAGE.format("Old", "2024-03-01")), (3, "http://c", PAGE.format("", "2026-03-01")), (4, "http://d", None), (5, "http://b", PAGE.format("Old", "2024-04-01"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sources = spark.createDataFrame([("http://a", "A", "x", "any", ["BSN"], "oh")], "url string, name string, category string, primary_discipline string, target_credentials array<string>, state_restriction string")
    found = ingesting.completed(ingesting.extracted(pages, "2026-01-01"), sources)
    got = {r["page_id"]: r for r in found.collect()}
    a = got[1]
    assert (a["title"], a["provider"], a["award"], a["deadline"], a["disciplines"], a["state"], a["complete"]) == ("New", "A", 2500, dt.date(2026, 3, 1), ["nursing"], "OH", True)
    assert (got[2]["category"], got[3]["complete"], got[4]["complete"]) == ("general", False, False)
    now = spark.createDataFrame([("New", "http://a", 1, dt.date(2026, 3, 1), False)], "title string, portal_url string, award int, deadline date, is_archived boolean")
    table, counts = ingesting.persisted(now, found, "2026-01-01")
    assert {(r["title"], r["deadline"], r["is_archived"], r["action"]) for r in table.collect()} == {("New", dt.date(2026, 3, 1), False, "updated"), ("Old", dt.date(2024, 4, 1), True, "created")}
    assert {r["action"]: r["n"] for r in counts.collect()} == {"updated": 1, "created": 1, "incomplete": 2}


def test_tokens_are_stable(spark):
    rows = spark.createDataFrame([(1, None), (2, "t")], "user_id long, feed_token string")
    a, b = (sorted(tuple(r) for r in ingesting.with_tokens(rows, "s").collect()) for _ in range(2))
    assert a == b and a[1] == (2, "t") and len(a[0][1]) == 64


def test_records_are_kept_or_put_aside(spark):
    raw = spark.createDataFrame([(1, "A", "$5,000", "March 1, 1999", "x"), (2, " ", "none", "1998-02-31", "x"), (3, "C", None, "", "x"), (3, "C", None, "", "x"), (4, None, None, None, None)], "id int, title string, award string, deadline string, reasonsless string")
    kept, aside = ingesting.sorted_out(raw, "1998-06-01")
    assert sorted((r["id"], r["award"], str(r["deadline"])) for r in kept.collect()) == [(1, 5000, "1999-03-01"), (3, None, "None"), (3, None, "None")]
    assert sorted((r["id"], r["award"], r["reasons"]) for r in aside.collect()) == [(2, "none", ["no title", "no sum of money", "no date"]), (4, None, ["no title"])]
    assert [df.count() for df in ingesting.sorted_out(raw.where("false"), "1998-06-01")] == [0, 0]
