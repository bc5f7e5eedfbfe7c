"""The engine's operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meritlake.functions import display, labels, parsing, vocabulary, web
from meritlake.operators import crawling, events, exports, ingesting, lifecycle, matching, planning, tiering, writing
from meritlake.plans import domain as d
from meritlake.plans.domain import AS_OF
from meritlake.sources import readers
from meritlake.sources.tables import few, folder
from meritlake.streaming import quota as stream

FEED = 10


def _tracked(spark: SparkSession, sf: str) -> DataFrame:
    """Trackings with their opportunities."""
    return d.trackings(spark, sf).join(d.opportunities(spark, sf).select("opp_id", "title", "provider", "portal_url", "award", "deadline"), "opp_id")


def match_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The best opportunities of each profile."""
    feed = matching.ranked_pairs(d.profiles(spark, sf), d.opportunities(spark, sf), top=FEED)
    return feed.select("user_id", "rank", "opp_id", "score", "award")


def whole_feed(spark: SparkSession, sf: str) -> DataFrame:
    """All eligible opportunities of each profile, ranked."""
    return matching.ranked_pairs(d.profiles(spark, sf), d.opportunities(spark, sf)).select("user_id", "rank", "opp_id", "score", "award")


def score_tracked(spark: SparkSession, sf: str) -> DataFrame:
    """Gates, points and messages of every tracked pair."""
    pairs = matching.known_pairs(d.trackings(spark, sf), d.profiles(spark, sf), d.opportunities(spark, sf))
    scored = matching.with_messages(matching.with_scores(pairs))
    gates = [f().alias(n) for n, f in (("discipline_ok", matching.discipline_gate), ("credential_ok", matching.credential_gate), ("level_ok", matching.level_gate))]
    return scored.select("user_id", "opp_id", *gates, "gpa_points", "geo_points", "sai_points", "affiliation_points", "local_points", "score", F.array_join("messages", "; ").alias("messages"))


def tiered_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Each profile's feed without dismissed ones, as its tier may see it."""
    gone = d.trackings(spark, sf).where("is_dismissed")
    shown = d.opportunities(spark, sf).select("opp_id", "title", "provider", "portal_url")
    ranked = matching.ranked_pairs(d.profiles(spark, sf), d.opportunities(spark, sf), dismissed=gone, top=FEED, keep=("u_tier",))
    feed = tiering.gated(ranked.join(shown, "opp_id"))
    return feed.select("user_id", "rank", "opp_id", "score", "is_locked", "shown_title", "shown_provider", "portal_url")


def whole_tiered_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Each profile's whole feed without dismissed ones, as its tier may see it."""
    gone = d.trackings(spark, sf).where("is_dismissed")
    shown = tiering.with_masks(d.opportunities(spark, sf).select("opp_id", "title", "provider", "portal_url"))
    ranked = matching.ranked_pairs(d.profiles(spark, sf), d.opportunities(spark, sf), dismissed=gone, keep=("u_tier",))
    feed = tiering.gated(ranked.join(few(shown), "opp_id"))
    return feed.select("user_id", "rank", "opp_id", "score", "is_locked", "shown_title", "shown_provider", "portal_url")


def feed_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How many opportunities a profile may have, what they are worth, and its best score."""
    return matching.feed_totals(matching.ready_profiles(d.profiles(spark, sf)), matching.ready_opportunities(d.opportunities(spark, sf)))


def planner(spark: SparkSession, sf: str) -> DataFrame:
    """C05, G03, M01-M04."""
    return planning.plan(d.profiles(spark, sf), d.budgets(spark, sf), planning.planned_totals(d.trackings(spark, sf), d.opportunities(spark, sf)))


def task_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Planned trackings as task lists."""
    return exports.task_csv(_tracked(spark, sf).where("is_planned")).select("user_id", "n_items", F.md5("csv").alias("csv_md5"), F.length("csv").cast("long").alias("n_chars"))


def day_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Trackings that are not dismissed as all-day calendars."""
    out = exports.day_calendar(_tracked(spark, sf).where("not is_dismissed"), "19980601T000000Z")
    return out.select("user_id", "n_events", F.md5(F.regexp_replace("ics", r"UID:[^\r]*", "UID:")).alias("ics_md5"))


def timed_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Trackings of the shown statuses as timed calendars."""
    out = exports.timed_calendar(_tracked(spark, sf))
    return out.select("user_id", "n_events", F.md5("ics").alias("ics_md5"))


def calendar_links(spark: SparkSession, sf: str) -> DataFrame:
    """A web calendar link for every opportunity."""
    link = exports.calendar_link(F.col("title"), F.col("deadline"), F.col("portal_url"), F.col("provider"))
    return d.opportunities(spark, sf).select("opp_id", link.alias("link"))


def archive_expired(spark: SparkSession, sf: str) -> DataFrame:
    """C06, F11, D02."""
    return lifecycle.archive_expired(d.opportunities(spark, sf), AS_OF).select("opp_id", F.col("deadline").cast("string").alias("deadline"), "is_archived", F.col("next_cycle").cast("string").alias("next_cycle"))


def archival_summary(spark: SparkSession, sf: str) -> DataFrame:
    """G01."""
    return lifecycle.archival_summary(d.opportunities(spark, sf), AS_OF)


def deadline_digest(spark: SparkSession, sf: str) -> DataFrame:
    """C07, F12, F14, F16, J05, G07, O04, K16, T15-T17."""
    out = lifecycle.deadline_digest(d.profiles(spark, sf), d.trackings(spark, sf), d.opportunities(spark, sf), AS_OF)
    return out.select("user_id", "email", "n_entries", "subject", F.md5("body").alias("body_md5"))


def reengagement_digest(spark: SparkSession, sf: str) -> DataFrame:
    """C08, F13, F17, J06, G02."""
    return lifecycle.reengagement_digest(d.profiles(spark, sf), d.opportunities(spark, sf), AS_OF)


def search_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is a search."""
    searches = d.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    return tiering.quota(searches).select("user_id", F.date_format("cycle_start", "yyyy-MM-dd HH:mm:ss").alias("cycle_start"), "used", "allowed", "blocked")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "C03_match_feed": match_feed,
    "C02_score_tracked": score_tracked,
    "C04_tiered_feed": tiered_feed,
    "G06_feed_totals": feed_totals,
    "C05_planner": planner,
    "K11_task_csv": task_csv,
    "K12_day_calendar": day_calendar,
    "K13_timed_calendar": timed_calendar,
    "T20_calendar_links": calendar_links,
    "C06_archive_expired": archive_expired,
    "G01_archival_summary": archival_summary,
    "C07_deadline_digest": deadline_digest,
    "C08_reengagement_digest": reengagement_digest,
    "B01_search_quota": search_quota,
}


def text_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What each document's text says of disciplines, credentials, areas and residency."""
    joined = lambda c: F.array_join(c, ",")
    text = F.col("text")
    return d.table(spark, sf, "documents").select(
        "doc_id", joined(labels.disciplines_in(text)).alias("disciplines"), joined(labels.credentials_in(text)).alias("credentials"), joined(labels.metros_in(text)).alias("metros"), parsing.residency(text).alias("residency")
    )


def page_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Title, words of interest and regional points of each page, and whether it is a candidate."""
    pages = d.table(spark, sf, "pages").select("page_id", "url", web.title_in(F.col("html")).alias("title"), web.text_in(F.col("html")).alias("text"))
    scored = crawling.scored_pages(pages)
    path = web.path_of(F.col("url"))
    candidate = (F.col("base") + F.col("regional") >= 2) & ~F.exists(labels.strings(vocabulary.NEGATIVE_PATHS), lambda p: path.contains(p))
    return scored.select("page_id", "title", web.domain_of(F.col("url")).alias("domain"), F.length("text").cast("long").alias("n_chars"), "base", "regional", F.array_join("metros", ",").alias("metros"), "residency", candidate.alias("candidate"))


def link_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every link of every page, resolved and judged."""
    return crawling.page_links(d.table(spark, sf, "pages"))


def next_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The next batch of seeds."""
    return crawling.next_seeds(d.seeds(spark, sf), AS_OF).select("url", "status", "priority")


def seeds_after_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Every third page's seed was crawled, with success unless its id divides by nine."""
    done = d.table(spark, sf, "pages").where("page_id % 3 = 0").groupBy(F.regexp_replace(F.trim("url"), "#.*$", "").alias("url")).agg(F.min(F.col("page_id") % 9 != 0).alias("success"))
    out = crawling.after_crawl(d.seeds(spark, sf), done, AS_OF)
    return out.select("url", "status", F.col("last_crawled_on").cast("string").alias("last_crawled_on"), "error_count")


def new_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """Directories to enqueue; the first word of each link's path becomes a kind of page, as these pages name none."""
    links = crawling.page_links(d.table(spark, sf, "pages"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("/grants/", "/about/", "/scholarships/", "/login/", "/awards/")]), (F.col("nth") % 5 + 1).cast("int"))
    urls = links.select(F.concat(web.root_of(F.col("url")), kinds, F.col("page_id").cast("string")).alias("url"), F.col("page_id").alias("parent"))
    return crawling.new_hubs(urls, d.seeds(spark, sf))


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl of depth 3, at most 15 pages a domain, over links that ids make; every tenth page fails."""
    pages = d.table(spark, sf, "pages").select(F.col("page_id").alias("node"), web.domain_of(F.col("url")).alias("domain"), (F.col("page_id") % 10 != 3).alias("ok"))
    n = F.lit(pages.count())
    targets = [F.col("node") * 2 + 1, F.col("node") * 3 + 2, F.col("node") * 7 + 5, F.col("node") + 1, *[F.col("node") * 11 + k for k in range(6)]]
    edges = pages.select("node", F.posexplode(F.array(*[t % n for t in targets])).alias("nth", "target"))
    seeds = pages.where("node % 3 = 0").select("node", F.col("node").alias("pos"))
    taken = crawling.crawl(pages, edges, seeds, depth=3, cap=15)
    return taken.select("node", "depth", F.array_join(F.col("place").cast("array<string>"), ",").alias("place"), "outcome")


def repair_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Link checks of opportunities, with all suppliers as the registry of sources, under the names of the 25 brands."""
    opps = d.opportunities(spark, sf).select("opp_id", "provider", "portal_url", "is_archived")
    roots = opps.select(web.root_of(F.col("portal_url")).alias("url")).distinct().where("cast(regexp_extract(url, 'brand([0-9]+)', 1) as int) % 4 = 0")
    sources = d.table(spark, sf, "supplier").select(F.concat(F.lit("brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("name"), F.concat(F.lit("https://s"), F.col("s_suppkey"), F.lit(".example.net/")).alias("url"), F.col("s_suppkey").alias("nth"))
    alive = opps.where("opp_id % 4 <> 0").select(F.col("portal_url").alias("url")).unionByName(roots).unionByName(sources.where("nth % 2 = 0").select("url"))
    return crawling.repaired(opps, alive.withColumn("code", F.lit(200)), sources).select("opp_id", "action", "new_url")


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of changed, equal, new and repeated opportunities."""
    now = d.opportunities(spark, sf).select("title", "portal_url", "award", "min_gpa")
    part = d.table(spark, sf, "part")
    batch = d.opportunities(spark, sf).where("opp_id % 3 <> 0").select(
        F.when(F.col("opp_id") % 10 == 1, F.concat("title", F.lit(" II"))).otherwise(F.col("title")).alias("title"), "portal_url",
        F.when(F.col("opp_id") % 4 == 0, F.col("award") + 1).otherwise(F.col("award")).alias("award"), "min_gpa", F.col("opp_id").alias("nth"),
    )
    again = batch.where("nth % 7 = 0").withColumns({"award": F.col("award") + 5, "nth": F.col("nth") + part.count()})
    return writing.upsert(now, batch.unionByName(again), ["title", "portal_url"], "nth")


def erase_users(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each table after every ninth user is erased."""
    users = d.profiles(spark, sf).select("user_id")
    left = writing.without_users({"profiles": users, "trackings": d.trackings(spark, sf), "budgets": d.budgets(spark, sf)}, users.where("user_id % 9 = 0"))
    counts = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("ids")).select(F.lit(name).alias("name"), "n", "ids") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def fill_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that set what they have, for every second profile."""
    now = d.profiles(spark, sf).select("user_id", "gpa", "sai", "metro")
    changes = now.where("user_id % 2 = 0").select("user_id", F.when(F.col("user_id") % 3 == 0, F.lit(3.5)).alias("gpa"), F.when(F.col("user_id") % 5 == 0, F.lit(1200)).alias("sai"))
    return writing.fill_update(now, changes, "user_id").withColumn("sai", F.col("sai").cast("double"))


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Signups, purchases, errors and clicks as billing events."""
    kinds = labels.lookup({"signup": "created", "purchase": "paid", "error": "failed", "click": "deleted"})
    billing = d.table(spark, sf, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.col("event_type")).alias("kind"))
    return events.subscriptions(billing)


def support_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """B04, F23, T23, T24, C20."""
    said = d.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return events.conversations(said).withColumn("summary", F.md5("summary"))


def status_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's trackings by status, and whether a free user is at the limit of three."""
    by = d.trackings(spark, sf).groupBy("user_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("saved", "in_progress", "submitted", "awarded", "archived")])
    return by.withColumn("at_limit", F.col("saved") + F.col("in_progress") + F.col("submitted") + F.col("awarded") >= 3)


def deadlines_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Live deadlines by day, with the three most valuable of each."""
    live = d.opportunities(spark, sf).where("not is_archived")
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("award", "opp_id")))), 1, 3)
    return live.groupBy("deadline").agg(F.count(F.lit(1)).alias("n"), F.sum("award").cast("long").alias("total"), F.array_join(F.transform(best, lambda x: x["opp_id"].cast("string")), ",").alias("best")).withColumn("deadline", F.col("deadline").cast("string"))


def parsed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts, dates, lists and labels from texts that parts make."""
    texts = d.table(spark, sf, "part").selectExpr(
        "p_partkey as id",
        "case p_partkey % 5 when 0 then concat('Up to $', format_number(floor(p_retailprice), 0), ' per year') when 1 then concat('  ', floor(p_retailprice), ' x 4') when 2 then 'varies' when 3 then concat('€', p_retailprice) end as amount",
        "case p_partkey % 5 when 0 then date_format(date_add(date'1998-01-01', cast(p_partkey % 365 as int)), 'MMMM d, yyyy') when 1 then concat('Due ', date_format(date_add(date'1998-01-01', cast(p_partkey % 365 as int)), 'MM/dd/yyyy'), ' (rolling)') when 2 then 'Tomorrow' when 3 then cast(date_add(date'1998-01-01', cast(p_partkey % 365 as int)) as string) else 'soon' end as due",
        "concat(p_type, ' ; ', p_brand, '|, ', p_name) as list",
        "case p_partkey % 6 when 0 then 'Pharmacy (PharmD)' when 1 then ' Pre-Med ' when 2 then 'Applied Physics' when 3 then p_type when 4 then '' else 'Nursing' end as label",
    )
    return texts.select(
        "id", parsing.amount(F.col("amount")).cast("double").alias("amount"), parsing.day(F.col("due"), AS_OF).cast("string").alias("due"), F.array_join(parsing.split_list(F.col("list")), "/").alias("parts"), labels.discipline_of(F.col("label")).alias("discipline")
    )


def quota_stream(spark: SparkSession, sf: str) -> DataFrame:
    """B01 as a stream: events read as a stream to their end, one state a user; the last state of each."""
    states = folder(spark, "quota")
    path = f"{sf}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "events*.parquet").parquet(sf)
    searches = source.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{states}/states")

    run = stream.quota_stream(searches).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{states}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{states}/states").groupBy("user_id").agg(F.max_by(F.struct("cycle_start", "used", "allowed", "blocked"), "batch").alias("s"))
    return last.select("user_id", F.date_format("s.cycle_start", "yyyy-MM-dd HH:mm:ss").alias("cycle_start"), "s.used", "s.allowed", "s.blocked")


QUERIES |= {
    "T05_text_labels": text_labels,
    "C13_page_scores": page_scores,
    "F20_link_rules": link_rules,
    "O03_next_seeds": next_seeds,
    "B05_seeds_after_crawl": seeds_after_crawl,
    "C16_new_hubs": new_hubs,
    "C12_crawl": crawl,
    "C17_repair_urls": repair_urls,
    "K02_upsert": upsert,
    "K09_erase_users": erase_users,
    "K05_fill_profiles": fill_profiles,
    "B03_subscriptions": subscriptions,
    "B04_support_conversations": support_conversations,
    "G08_status_lists": status_lists,
    "G09_deadlines_by_day": deadlines_by_day,
    "T03_parsed_fields": parsed_fields,
    "B01_quota_stream": quota_stream,
}


def profile_strength(spark: SparkSession, sf: str) -> DataFrame:
    """How complete each profile is, and what it lacks."""
    return d.profiles(spark, sf).select("user_id", display.profile_strength().alias("strength"), F.array_join(display.profile_gaps(), ", ").alias("gaps"))


def unrendered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's address as fetched, and whether its html needs a browser."""
    pages = d.table(spark, sf, "pages")
    got = readers.fetched(pages.select(parsing.clean(F.col("url")).alias("url")).distinct(), pages)
    return got.select("url", "ok", readers.unrendered(F.col("html"), ["track(", "__NEXT_DATA__"]).alias("unrendered"))


def upcoming(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's ten next deadlines among trackings that are not dismissed."""
    rows = _tracked(spark, sf).where(~F.col("is_dismissed") & (F.col("deadline") >= F.lit(AS_OF).cast("date")))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("deadline", "opp_id"))
    return rows.withColumn("rank", rank).where("rank <= 10").select("user_id", "rank", "opp_id", F.datediff("deadline", F.lit(AS_OF).cast("date")).alias("days"))


def keyword_feed(spark: SparkSession, sf: str) -> DataFrame:
    """tracked pairs whose title, provider or messages hold a word, in any case; percent signs and underscores are themselves."""
    pairs = matching.known_pairs(d.trackings(spark, sf), d.profiles(spark, sf), d.opportunities(spark, sf))
    scored = matching.with_messages(matching.with_scores(pairs))
    return scored.where(matching.holds_word("ring")).groupBy("opp_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


QUERIES |= {"M05_profile_strength": profile_strength, "S10_unrendered_pages": unrendered_pages, "O07_upcoming": upcoming, "F09_keyword_feed": keyword_feed}


def page_extracts(spark: SparkSession, sf: str) -> DataFrame:
    """What each page says, with its source's data; every second page has a source."""
    pages = d.table(spark, sf, "pages")
    sources = pages.where("page_id % 2 = 0").select(
        F.trim("url").alias("url"), F.col("page_id").alias("nth"), F.concat(F.lit("Source "), F.col("page_id")).alias("name"), F.lit("registry").alias("category"), F.when(F.col("page_id") % 4 == 0, "nursing").otherwise("any").alias("primary_discipline"),
        F.array(F.lit("RN")).alias("target_credentials"), F.when(F.col("page_id") % 6 == 0, "oh").alias("state_restriction"),
    )
    found = ingesting.completed(ingesting.extracted(pages, AS_OF), sources)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("page_id", "title", "provider", "category", F.col("award").cast("double").alias("award"), F.col("deadline").cast("string").alias("deadline"), joined("disciplines"), joined("credentials"), joined("metros"), "state", "complete")


def latest_turn(spark: SparkSession, sf: str) -> DataFrame:
    """The last conversation turn of each conversation."""
    last = ingesting.latest(d.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    return last.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


QUERIES |= {"C09_page_extracts": page_extracts, "O06_latest_turn": latest_turn}

QUERIES |= {"C03_whole_feed": whole_feed, "C04_whole_tiered_feed": whole_tiered_feed}
