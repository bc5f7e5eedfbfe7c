"""Rules and edge cases that the tables do not show."""

from __future__ import annotations

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from meritlake.functions import labels, parsing, web
from meritlake.operators import crawling, events, exports, lifecycle, matching, planning, tiering, writing
from meritlake.plans.queries import QUERIES

PROFILE = """user_id long, disciplines array<string>, primary_discipline string, target_credentials array<string>, target_credential string, clinical_phase string, gpa double, state string, metro string,
  sai int, first_gen boolean, minority boolean, affiliations array<string>, tier string"""
OPPORTUNITY = """opp_id long, title string, provider string, portal_url string, award int, deadline date, disciplines array<string>, credentials array<string>, levels array<string>, min_gpa double, max_sai int,
  states array<string>, metros array<string>, required_affiliations array<string>, tags array<string>, competition string, is_archived boolean, has_service_commitment boolean, employment_required boolean"""


def profile(spark, **kw):
    base = dict(user_id=1, disciplines=[], target_credentials=[], affiliations=[], first_gen=False, minority=False, tier="free")
    return spark.createDataFrame([base | kw], PROFILE)


def opportunity(spark, *rows):
    base = dict(
        opp_id=1, title="t", provider="p", portal_url="u", award=5000, deadline=dt.date(2030, 1, 1), disciplines=[], credentials=[], levels=[], min_gpa=0.0, states=[], metros=[], required_affiliations=[], tags=[],
        competition="medium", is_archived=False, has_service_commitment=False, employment_required=False,
    )
    return spark.createDataFrame([base | r for r in rows], OPPORTUNITY)


def feed(spark, p, *rows):
    return [r.asDict() for r in matching.ranked_feed(profile(spark, **p), opportunity(spark, *rows)).orderBy("rank").collect()]


def test_breakdown_of_a_partial_match(spark):
    (r,) = feed(spark, dict(gpa=3.5, state="NY", first_gen=True), dict(min_gpa=3.0, states=["CA"], tags=["first_gen"]))
    assert (r["gpa_points"], r["geo_points"], r["sai_points"], r["affiliation_points"], r["score"]) == (25, 0, 25, 25, 75)
    assert r["messages"] == ["Restricted to residents of: CA"]


def test_perfect_match_and_cap(spark):
    a, b = feed(spark, dict(gpa=3.9, state="CA", first_gen=True), dict(min_gpa=3.0, states=["CA"], tags=["first_gen"]), dict(opp_id=2, award=1, states=["ca"], tags=["FIRST_GEN"], competition="low"))
    assert (a["score"], b["score"], b["local_points"], a["messages"]) == (100, 100, 10, [])


@pytest.mark.parametrize(("states", "points"), [(["OH"], 10), (["PA"], 0)])
def test_local_points_need_the_place(spark, states, points):
    (r,) = feed(spark, dict(state="OH"), dict(states=states, competition="low"))
    assert r["local_points"] == points


def test_unrestricted_without_tags_has_75(spark):
    (r,) = feed(spark, dict(gpa=3.0, state="OH", sai=5), dict(disciplines=["any"], competition="high", has_service_commitment=True))
    assert r["score"] == 75 and r["messages"] == ["Includes post-graduation service commitment"]


def test_gates(spark):
    rows = [
        dict(opp_id=1, disciplines=["pharmacy"]), dict(opp_id=2, disciplines=["Nursing"]), dict(opp_id=3, credentials=["RN"]), dict(opp_id=4, credentials=["rn"]),
        dict(opp_id=5, levels=["Doctoral"]), dict(opp_id=6, levels=["undergraduate"]), dict(opp_id=7, is_archived=True), dict(opp_id=8, is_archived=None),
    ]
    got = {r["opp_id"] for r in feed(spark, dict(disciplines=["Nursing (BSN)"], target_credentials=["RN"], clinical_phase=" PhD "), *rows)}
    assert got == {2, 3, 5, 8}
    assert {r["opp_id"] for r in feed(spark, {}, *rows)} == {1, 2, 3, 4, 5, 6, 8}


def test_nulls_in_soft_criteria(spark):
    (r,) = feed(spark, dict(sai=None, gpa=None), dict(min_gpa=3.5, max_sai=0, metros=["chicago"], required_affiliations=["APhA"]))
    assert (r["gpa_points"], r["sai_points"], r["geo_points"], r["affiliation_points"]) == (25, 0, 25, 0)
    assert r["messages"] == ["Requires demonstrated financial need", "Requires affiliation(s): APhA"]


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in ("Pharmacy (PharmD)", " Applied Physics", "", None, "any", "law")], "x string")
    assert [r[0] for r in rows.select(labels.discipline_of(F.col("x"))).collect()] == ["pharmacy", "medicine", "any", "any", "any", "any"]
    rows = spark.createDataFrame([(x,) for x in ("cbsa:35620", "New York-Newark-Jersey City", " SEATTLE ", "cbsa:1", None)], "x string")
    assert [r[0] for r in rows.select(labels.metro_of(F.col("x"))).collect()] == ["new_york", "new_york", "seattle", "cbsa:1", ""]


def test_counties_are_whole_words_and_the_later_area_has_them(spark):
    rows = spark.createDataFrame([("Thinking of cooking",), ("In Suffolk and King county, near San Francisco Bay",), (None,)], "x string")
    assert [r[0] for r in rows.select(labels.metros_in(F.col("x"))).collect()] == [[], ["san_francisco", "seattle", "boston"], []]


def test_masks(spark):
    rows = spark.createDataFrame([("Big Award of It", "ACME"), ("Solo", ""), ("", None)], "t string, p string")
    got = rows.select(tiering.mask_title(F.col("t")), tiering.mask_provider(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("Big █████ ████ ████", "A ████"), ("S ██████", "█" * 10), ("█" * 10, "█" * 10)]


def test_quota_resets_exactly_after_seven_days(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(minutes=i), i) for i in range(12)] + [(1, t + dt.timedelta(days=7), 99)]
    (r,) = tiering.quota(spark.createDataFrame(rows, "user_id long, at timestamp, seq long")).collect()
    assert (r["used"], r["allowed"], r["blocked"]) == (1, 11, 2)


def test_loans(spark):
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    budgets = spark.createDataFrame([(1, 40000, 0, 0, 4, 7.5), (2, 12000, 0, 0, 4, 0.0), (3, 10000, 0, 10000, 4, 7.5)], "user_id long, direct int, living int, income int, program_years int, interest_rate double")
    rows = {r["user_id"]: r for r in planning.plan(users, budgets, spark.createDataFrame([], "user_id long, planned long")).collect()}
    assert rows[1]["monthly_payment"] == 1899.23
    assert (rows[2]["monthly_payment"], rows[2]["lifetime_interest"]) == (400.0, 0.0)
    assert (rows[3]["debt"], rows[3]["monthly_payment"], rows[3]["cushion_percent"]) == (0, 0.0, 33.3)
    assert (rows[4]["expenses"], rows[4]["cushion_percent"]) == (0, 0.0)


def test_csv_and_links(spark):
    items = spark.createDataFrame([(1, 7, 'A "big", one', dt.date(2026, 3, 15), "http://x/y", "P", 5000, "planned"), (1, 8, None, None, "u", "P", None, "in PROGRESS")], "user_id long, opp_id long, title string, deadline date, portal_url string, provider string, award int, status string")
    (r,) = exports.task_csv(items).collect()
    lines = r["csv"].split("\r\n")
    assert lines[1].startswith(",,Apply at u,Provider: P. Award: $0. Apply at u,In progress,")
    assert lines[2] == '"A ""big"", one",03/15/2026,Apply at http://x/y,"Provider: P. Award: $5,000. Apply at http://x/y",Planned,"Meritlake,Scholarship"'
    (link,) = items.where("opp_id = 7").select(exports.percent_encoded(F.lit("a b/c~d*e&é"))).first()
    assert link == "a%20b/c~d%2Ae%26%C3%A9"


def test_archive_on_leap_days_and_the_day_itself(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 2, 29), False), (2, dt.date(2024, 6, 1), False), (3, dt.date(2024, 1, 1), None)], "opp_id long, deadline date, is_archived boolean")
    got = {r["opp_id"]: (r["is_archived"], r["next_cycle"]) for r in lifecycle.archive_expired(rows, "2024-06-01").collect()}
    assert got == {1: (True, dt.date(2025, 2, 28)), 2: (False, None), 3: (None, None)}


def test_parsing(spark):
    rows = spark.createDataFrame([("$5,000",), ("Up to $2,500 per year",), ("3 x 500",), ("varies",), ("$0",), (None,)], "x string")
    assert [r[0] for r in rows.select(parsing.amount(F.col("x"))).collect()] == [5000, 2500, 3, None, None, None]
    rows = spark.createDataFrame([("March 1st, 2026 (rolling)",), ("Deadline: 03/15/2026",), ("today",), ("never",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(parsing.day(F.col("x"), "2026-01-02")).collect()] == [dt.date(2026, 3, 1), dt.date(2026, 3, 15), dt.date(2026, 1, 2), None, None, None]
    rows = spark.createDataFrame([("Must be an Ohio resident",), ("for PA residents",), ("none",), (None,)], "x string")
    assert [r[0] for r in rows.select(parsing.residency(F.col("x"))).collect()] == ["OH", "PA", None, None]


def test_addresses(spark):
    cases = [("/a", "https://w.org/x/y?q", "https://w.org/a"), ("b", "https://w.org/x/y", "https://w.org/x/b"), ("b", "https://w.org", "https://w.org/b"), ("//z.org/q#f", "http://w.org", "http://z.org/q"), ("#t", "http://w.org", None), ("mailto:a", "http://w.org", None), ("?p=1", "http://w.org/s#f", "http://w.org/s?p=1")]
    rows = spark.createDataFrame(cases, "h string, p string, e string")
    got = rows.select(web.normal_url(web.resolved(F.col("h"), F.col("p"))).alias("u"), "e").collect()
    assert [r["u"] for r in got] == [r["e"] for r in got]
    rows = spark.createDataFrame([("https://WWW.A.org:80/x",), ("ftp://a",), (None,)], "u string")
    assert [r[0] for r in rows.select(web.domain_of(F.col("u"))).collect()] == ["a.org:80", "a", None]


def test_crawl_is_breadth_first(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["node"]: (r["depth"], r["outcome"]) for r in QUERIES["C12_crawl"](spark, sf).collect()}
    domains = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", web.domain_of(F.col("url"))).collect()}
    n, want, used = len(domains), {}, {}
    queue = deque((s, 0) for s in range(0, n, 3))
    while queue:
        x, depth = queue.popleft()
        if x in want:
            continue
        if used.get(domains[x], 0) >= 15:
            want[x] = (depth, "capped")
        elif x % 10 == 3:
            want[x] = (depth, "failed")
        else:
            want[x] = (depth, "fetched")
            used[domains[x]] = used.get(domains[x], 0) + 1
            if depth < 3:
                queue.extend((t % n, depth + 1) for t in (2 * x + 1, 3 * x + 2, 7 * x + 5, x + 1, *(11 * x + k for k in range(6))))
    assert got == want


def test_crawl_of_many_pages_keeps_its_order(spark):
    n, depth, cap = 30_000, 3, 40
    links = lambda x: [(2 * x + 1) % n, (3 * x + 2) % n, (7 * x + 5) % n]
    pages = spark.range(n).select(F.col("id").alias("node"), F.concat(F.lit("d"), F.col("id") % 501).alias("domain"), (F.col("id") % 10 != 3).alias("ok"))
    edges = pages.select("node", F.posexplode(F.array((F.col("node") * 2 + 1) % n, (F.col("node") * 3 + 2) % n, (F.col("node") * 7 + 5) % n)).alias("nth", "target"))
    seeds = pages.where("node % 2 = 0").select("node", (F.lit(n) - F.col("node")).alias("pos"))
    taken = crawling.crawl(pages, edges, seeds, depth, cap).orderBy("depth", "place").collect()
    want, used, queue = {}, {}, deque((x, 0) for x in range(n - 2, -1, -2))
    while queue:
        x, at = queue.popleft()
        if x in want:
            continue
        d = x % 501
        want[x] = (at, "capped" if used.get(d, 0) >= cap else "failed" if x % 10 == 3 else "fetched")
        if want[x][1] == "fetched":
            used[d] = used.get(d, 0) + 1
            if at < depth:
                queue.extend((t, at + 1) for t in links(x))
    assert [r["node"] for r in taken] == list(want) and all((r["depth"], r["outcome"]) == want[r["node"]] for r in taken)


def test_dates_in_other_words(spark):
    cases = [("Applications close on the 3rd of April 2027", "2027-04-03"), ("Apr 5", "2026-04-05"), ("25/12/2026", "2026-12-25"), ("12-25-26", "2026-12-25"), ("2026/2/30", None), ("Spring 2027", "2027-01-01"), ("June 2026", "2026-06-01"), ("20260704", "2026-07-04"), ("rolling", None)]
    rows = spark.createDataFrame(cases, "x string, e string").select(parsing.day(F.col("x"), "2026-01-02").cast("string").alias("d"), "e").collect()
    assert [r["d"] for r in rows] == [r["e"] for r in rows]


def test_terms_stand_for_those_they_begin_with(spark):
    rows = spark.createDataFrame([("In Greater Chicago and cook county, not bookcook",), ("The King-fisher; king county",), (None,)], "t string")
    assert [r[0] for r in rows.select(labels.metros_in(F.col("t"))).collect()] == [["chicago"], ["seattle"], []]
    assert [r[0] for r in rows.select(labels.first_metro(F.col("t"))).collect()] == ["chicago", "seattle", None]


def test_repair_takes_the_first_that_is_alive(spark):
    rows = [(1, "Acme", "http://a.org/x", False), (2, "Acme", "http://b.org/x", False), (3, "The Acme Fund", "http://c.org/x", False), (4, "Zed", "http://d.org/x", False), (5, "", "http://d.org/x", None), (6, "q", "http://d.org", True)]
    opps = spark.createDataFrame(rows, "opp_id long, provider string, portal_url string, is_archived boolean")
    status = spark.createDataFrame([("http://a.org/x", 200), ("http://b.org", 301), ("http://s.org/", 200), ("http://d.org", 404)], "url string, code int")
    sources = spark.createDataFrame([("acme", "http://s.org/", 1), ("other", "http://d.org/z", 2)], "name string, url string, nth int")
    got = {r["opp_id"]: (r["action"], r["new_url"]) for r in crawling.repaired(opps, status, sources).collect()}
    assert got == {1: ("ok", "http://a.org/x"), 2: ("root", "http://b.org"), 3: ("source", "http://s.org/"), 4: ("archived", "http://d.org/x"), 5: ("archived", "http://d.org/x"), 6: ("already_archived", "http://d.org")}


def test_upsert_takes_the_last_of_a_batch(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    new = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 3, 3), ("c", None, 4), ("d", 9, 5)], "k string, v int, nth int")
    got = {r["k"]: (r["v"], r["action"]) for r in writing.upsert(now, new, ["k"], "nth").collect()}
    assert got == {"a": (1, "unchanged"), "b": (3, "updated"), "c": (None, "unchanged"), "d": (9, "created")}
    assert {r["action"] for r in writing.upsert(now, new, ["k"], "nth", strict=True).collect()} == {"updated", "created"}
    assert [r["k"] for r in writing.insert_new(now, new, "k", "nth").collect()] == ["d"]


def test_support_turns(spark):
    rows = [(1, i, t) for i, t in enumerate(["What is my Search Limit?", "tell me a JOKE", None, "x", "late"])] + [(2, 0, "drag")]
    got = {r["conv_id"]: r for r in events.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert (got[1]["turn_count"], got[1]["is_escalated"], got[1]["n_refused"], got[1]["first_topic"]) == (4, True, 1, "quota")
    assert got[1]["summary"] == "What is my Search Limit? tell me a JOKE  x" and (got[2]["is_escalated"], got[2]["first_topic"]) == (False, "board")


def test_parts_are_found_by_their_rarest_run(spark):
    rng = random.Random(2)
    words = lambda n, most: sorted({"".join(rng.choices("abc ", k=rng.randrange(1, most))) for _ in range(n)})
    texts, parts = words(300, 12), words(80, 6) + ["", "zz", "é"]
    got = crawling.holding(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in parts], "p string"), "p")
    assert sorted(tuple(r) for r in got.collect()) == sorted((t, p) for t in texts for p in parts if p and p in t)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
