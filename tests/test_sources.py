"""Readers, shown values and labels in HTML."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from meritlake.functions import display, labelled
from meritlake.sources import readers


def test_registry(spark, tmp_path):
    rows = [{"name": "A ", "url": "u1"}, {"url": "u2", "category": "x", "primary_discipline": "Nursing (BSN)", "state_restriction": "OH"}, {"name": "no url"}, {"name": "a", "url": "u3", "category": "x"}]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(rows))
    got = readers.registry(spark, str(path))
    assert [(r["name"], r["category"], r["primary_discipline"], r["target_credentials"], r["scraper_type"]) for r in got.orderBy("nth").collect()][1] == ("", "x", "nursing", [], "deterministic")
    assert [r["url"] for r in readers.chosen(got, category="x", limit=1).collect()] == ["u2"] and [r["url"] for r in readers.chosen(got, state="oh").collect()] == ["u2"]
    assert {r["name"]: r["url"] for r in readers.url_by_name(got).collect()} == {"a": "u3"}
    path.write_text(json.dumps([{"url": " "}, {"url": "u"}]))
    assert readers.seed_urls(spark, str(path)).count() == 1


def test_seed_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("title,category,target_level,state,seed_url,typical_cycle\nAcme Scholarship Program,c,BSN,ALL,http://a,spring\nScholarship,,,OH,http://b,\nx,c,c,c,,\n")
    a, b = readers.seed_csv(spark, str(path)).orderBy("portal_url").collect()
    assert (a["provider"], a["disciplines"], a["credentials"], a["states"], a["tags"]) == ("Acme", ["nursing"], ["BSN"], [], ["c", "spring"])
    assert (b["provider"], b["disciplines"], b["credentials"], b["states"], b["tags"]) == ("Scholarship", ["pharmacy"], [], ["OH"], [])


def test_inline_rows_and_pages(spark):
    rows = spark.createDataFrame([('[{"url":"a","priority":2},{"url":"b"}]',), (None,), ("broken",)], "j string")
    assert {(r["url"], r["priority"]) for r in readers.inline_rows(rows, "j", "url string, priority int").where("url is not null").collect()} == {("a", 2), ("b", None)}
    pages = spark.createDataFrame([(1, "a", "old"), (2, "a", "new")], "page_id long, url string, html string")
    got = {r["url"]: (r["html"], r["ok"]) for r in readers.fetched(spark.createDataFrame([("a",), ("z",)], "url string"), pages).collect()}
    assert got == {"a": ("new", True), "z": (None, False)}
    shells = spark.createDataFrame([(None,), ("x",), ("JS " + "y" * 700,), ("JS <H1>" + "y" * 700,)], "h string")
    assert [r[0] for r in shells.select(readers.unrendered(F.col("h"), ["JS"])).collect()] == [True, True, True, False]


def test_labels_in_html(spark):
    html = "<dl><dt>Award Amount</dt><dd> $5,000 </dd><dt>Deadline</dt><dd>March 1</dd></dl><p>GPA: 3.0<p>other</p><h2>Eligibility</h2><p>A</p><ul><li>B</li></ul><h3>Next</h3><p>C</p>"
    rows = spark.createDataFrame([(html,), (None,), ("<b>broken",)], "h string")
    assert [r[0] for r in rows.select(labelled.labelled(F.col("h"), ["amount", "award"])).collect()] == ["$5,000", "", ""]
    assert labelled.value_of("<ul><li>GPA: 3.0</li></ul>", ["gpa"]) == "3.0"
    assert [r[0] for r in rows.select(labelled.criteria(F.col("h"))).collect()] == ["A B", "", ""]


def test_pages_are_read_as_trees(spark):
    html = """<title> A &amp; B </title><nav><a href="/in-nav">x<nav>deep</nav></a>still hidden</nav><!-- <a href="/no">no</a> --><script>var t = '<a href="/no">';</script>
      <p>seen<p>too<header>h</header> <a HREF='/yes?a=1&amp;b=2'>link</a><footer>f<div>g</footer> end"""
    page = labelled.Page(html)
    assert (page.first("title"), page.links(), page.visible()) == ("A & B", ["/in-nav", "/yes?a=1&b=2"], "A & B seen too link end")
    rows = spark.createDataFrame([(html,), (None,)], "h string").select(labelled.facts(F.col("h")).alias("f")).select("f.*").collect()
    assert tuple(rows[0]) == ("A & B", "A & B seen too link end", ["/in-nav", "/yes?a=1&b=2"]) and tuple(rows[1]) == ("", "", [])
    deep = labelled.Page("<div>" * 5000 + "bottom")
    assert deep.text(1) == deep.visible() == "bottom"


def test_shown_values(spark):
    at = spark.createDataFrame([(dt.datetime(2024, 2, 15, 12), "x" * 30, 1250)], "t timestamp, s string, c int")
    later = F.col("t") + F.expr("interval 26 hours")
    row = at.select(
        display.countdown(later, F.col("t")), display.countdown(F.col("t") + F.expr("interval 90 minutes"), F.col("t")), display.countdown(F.col("t"), F.col("t")), display.shortened(F.col("s")), display.dollars(F.col("c")),
        display.fallback_score(F.lit(20)), F.size(display.month_grid(F.col("t").cast("date"))), display.discipline_of_major(F.lit("Exercise Science")), display.days_left(F.lit(dt.date(2024, 2, 17)), F.col("t")),
    ).first()
    assert tuple(row) == ("in 1d 2h", "in 1h 30m", "soon", "x" * 23 + "…", "$12.50", 50, 35, "therapeutics_rehab", 2)
    lists = spark.createDataFrame([([{"id": "a", "completed": True}, {"id": "b", "completed": False}, {"id": "c", "completed": True}],), ([],)], "l array<struct<id:string,completed:boolean>>")
    assert [r[0] for r in lists.select(display.share_done(F.col("l"))).collect()] == [67, 0]
