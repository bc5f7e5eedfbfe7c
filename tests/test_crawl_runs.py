"""A crawl's candidates taken into the table of opportunities."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meritlake.operators import crawl_runs
from meritlake.sources.tables import folder
from meritlake.sources.versions import Versions

PAGE = "<html><title>{}</title><p>Award: $2,500</p><p>Deadline: {}</p></html>"
FOUND = "url string, depth int, place array<long>, title string, relevance int, state string, metros array<string>"
CODES = "url string, code int"


def begun(spark, rows):
    store = Versions(spark, folder(spark, "t"))
    store.commit(0, replace={"opportunities": spark.createDataFrame(rows, crawl_runs.OPPORTUNITIES)})
    return store


def test_each_candidate_meets_its_end(spark):
    old = ("Old", "http://a.org/1", "P", "c", 1, dt.date(2024, 2, 29), [], [], [], [], False, None)
    gone = ("Gone", "http://a.org/9", "P", "c", 1, dt.date(2020, 1, 1), [], [], [], [], True, dt.date(2021, 1, 1))
    store = begun(spark, [old, gone])
    urls = [f"http://a.org/{n}" for n in range(1, 8)]
    pages = spark.createDataFrame([(n, u, PAGE.format(f"T{n % 5}" if n != 2 else "", "March 1, 2027")) for n, u in enumerate(urls, 1)], "page_id long, url string, html string")
    found = spark.createDataFrame([(u, 0, [n], "Site" if n != 4 else None, n, "OH" if n == 4 else None, ["boise"]) for n, u in enumerate(urls, 1)], FOUND)
    codes = spark.createDataFrame([(u, 404 if u.endswith("3") else 200) for u in urls], CODES)
    own = crawl_runs.own_words("2026-01-01")
    # 6 and 1 have one title; 6 and 7 name one address that does not answer, or none
    extract = lambda asked: own(asked).withColumns({"portal_url": F.when(F.col("page_id") == 6, "/nowhere"), "title": F.when(F.col("page_id") == 7, "T1").otherwise(F.col("title"))})
    assert crawl_runs.ingest(store, 1, found, pages, "2026-01-01", codes, extract)
    got = {r["url"][-1]: r["action"] for r in store.read("outcomes").collect()}
    assert got == {"1": "duplicate", "2": "incomplete", "3": "dead", "4": "created", "5": "created", "6": "created", "7": "created"}
    table = {r["portal_url"][-1]: r for r in store.read("opportunities").collect()}
    assert sorted(table) == ["1", "4", "5", "6", "7", "9"]
    assert (table["4"]["provider"], table["4"]["states"], table["5"]["provider"], table["5"]["states"], table["5"]["metros"]) == ("http://a.org/4", ["OH"], "Site", [], ["boise"])
    assert (table["1"]["is_archived"], table["1"]["next_cycle"], table["9"]["next_cycle"]) == (True, dt.date(2025, 2, 28), dt.date(2021, 1, 1))
    assert store.read("archived").collect()[0][0] == 1
    # a step that is taken again does nothing; the next one finds all there
    assert not crawl_runs.ingest(store, 1, found, pages, "2026-01-01", codes, extract)
    assert crawl_runs.ingest(store, 2, found, pages, "2026-01-01", codes, extract)
    assert {r["action"] for r in store.read("outcomes").collect()} == {"duplicate", "incomplete", "dead"} and store.read("opportunities").count() == 6


def test_of_records_with_one_key_the_last_counts(spark):
    store = begun(spark, [])
    pages = spark.createDataFrame([(n, f"http://a.org/{n}", PAGE.format("T", f"March {n}, 2027")) for n in (1, 2, 3)], "page_id long, url string, html string")
    found = spark.createDataFrame([(f"http://a.org/{n}", d, [n], "", r, None, None) for n, d, r in ((1, 1, 5), (2, 0, 5), (3, 0, 9))], FOUND)
    extract = lambda asked: crawl_runs.own_words("2026-01-01")(asked).withColumn("portal_url", F.lit("/x"))
    crawl_runs.ingest(store, 1, found, pages, "2026-01-01", extract=extract)
    assert [(r["portal_url"], r["deadline"].day) for r in store.read("opportunities").collect()] == [("http://a.org/x", 1)]
    assert [r["action"] for r in store.read("outcomes").collect()] == ["created"] * 3


def test_a_whole_run_counts(spark):
    store = begun(spark, [])
    body = "<p>scholarship award for nursing students</p>"
    pages = spark.createDataFrame([(1, "http://a.org/", f'<a href="/scholarships/2">x</a>{PAGE.format("A", "May 1, 2027")}{body}'), (2, "http://a.org/scholarships/2", PAGE.format("B", "soon") + body)], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://a.org/", 0), ("http://gone.org/", 1)], "url string, pos long")
    c = crawl_runs.run(store, 1, pages, seeds, "2026-01-01").collect()[0].asDict()
    assert (c["pages_crawled"], c["errors"], c["candidates"], c["created"], c["incomplete"], c["archived"]) == (2, 1, 2, 1, 1, 0)
    empty = crawl_runs.run(begun(spark, []), 1, pages.where("false"), seeds.where("false"), "2026-01-01", limit=5).collect()[0].asDict()
    assert set(empty.values()) == {0}
