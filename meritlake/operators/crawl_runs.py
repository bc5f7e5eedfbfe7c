"""From a crawl's candidates to the table of opportunities: look-up, extraction, links, fills, upsert and archiving as one step of versioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.functions import web
from meritlake.functions.labels import filled, strings
from meritlake.operators import crawling
from meritlake.operators.ingesting import extracted
from meritlake.operators.lifecycle import archive_expired, expired
from meritlake.operators.writing import upsert
from meritlake.sources.tables import discard, written
from meritlake.sources.versions import Versions

#: The table of opportunities that runs change.
OPPORTUNITIES = "title string, portal_url string, provider string, category string, award int, deadline date, disciplines array<string>, credentials array<string>, states array<string>, metros array<string>, is_archived boolean, next_cycle date"
#: What becomes of a candidate.
ACTIONS = ("duplicate", "incomplete", "dead", "created", "updated", "unchanged")

Extraction = Callable[[DataFrame], DataFrame]


def own_words(as_of: str) -> Extraction:
    """The extraction that goes by what a page itself says; its address is the page's."""
    return lambda pages: extracted(pages, as_of).withColumn("portal_url", F.col("url"))


def _read(fresh: DataFrame, pages: DataFrame, extract: Extraction) -> DataFrame:
    """(url, said): what extract says of the last page of each fresh address; only these pages are read in full."""
    asked = pages.withColumn("url", web.normal_url(F.col("url"))).join(fresh.select("url"), "url", "left_semi")
    last = asked.groupBy("url").agg(F.max_by(F.struct("page_id", "html"), "page_id").alias("p")).select("p.page_id", "url", "p.html")
    said = extract(last)
    return said.select("url", F.struct(*[c for c in said.columns if c not in ("url", "page_id")]).alias("said")).dropDuplicates(["url"])


def ingest(store: Versions, step: int, found: DataFrame, pages: DataFrame, as_of: str, codes: DataFrame | None = None, extract: Extraction | None = None) -> bool:
    """Take candidates (url, depth, place, title, relevance, state, metros) into the store's table opportunities, as its step.

    A candidate whose address an opportunity has before the step is a duplicate. The pages (page_id, url, html) of the others go
    through extract, which gives (url, title, portal_url, award, deadline, disciplines, credentials, metros, state); one
    without title, award and deadline is incomplete. A portal_url is resolved against the page; one that does not answer
    (codes (url, code); all answer without) gives way to the page, and is dead if that does not answer either. The page's
    title, or its address, is the provider; the crawl's state and areas fill what the extraction leaves out. Of records with
    one title and portal_url the last in order of relevance (falling), depth and place counts, and what becomes of it
    becomes of all. Then what is past its deadline is archived. The store's table outcomes (url, portal_url, action) holds
    the candidates of the step. False, and nothing done, if the store has taken the step before.
    """
    if step <= store.current()["step"]:
        return False
    now = store.read("opportunities")
    known = now.select(F.col("portal_url").alias("url")).distinct()
    fresh = written(found.join(known, "url", "left_anti"), "fresh")
    both = fresh.join(_read(fresh, pages, extract or own_words(as_of)), "url", "left")
    some = lambda own, other: F.when(F.size(filled(own)) > 0, own).otherwise(filled(other))
    state = F.coalesce("said.state", "state")
    full = both.select(
        F.col("url").alias("source"), F.col("said.portal_url").alias("url"), F.col("said.title").alias("title"), F.coalesce(F.nullif("title", F.lit("")), "url").alias("provider"), F.lit("crawled").alias("category"),
        F.col("said.award").try_cast("int").alias("award"), F.col("said.deadline").alias("deadline"), filled(F.col("said.disciplines")).alias("disciplines"), filled(F.col("said.credentials")).alias("credentials"),
        F.when(state.isNotNull(), F.array(state)).otherwise(strings([])).alias("states"), some(F.col("said.metros"), F.col("metros")).alias("metros"),
        F.struct((-F.col("relevance")).alias("r"), "depth", "place").alias("nth"),
    )
    checked = crawling.verified(full, codes) if codes is not None else full.withColumns({"final_url": web.resolved_or_page(F.col("url"), F.col("source")), "is_valid": F.lit(True)})
    complete = (F.coalesce("title", F.lit("")) != "") & F.col("award").isNotNull() & F.col("deadline").isNotNull()
    read = written(checked.withColumn("why", F.when(~complete, "incomplete").when(~F.col("is_valid"), "dead")), "extracts")
    batch = read.where("why is null").withColumn("portal_url", F.col("final_url")).drop("source", "url", "final_url", "is_valid", "why")
    merged = written(upsert(now, batch, ["title", "portal_url"], "nth").withColumn("is_archived", F.coalesce("is_archived", F.lit(False))), "merged")
    done = read.where("why is null").select("source", "title", F.col("final_url").alias("portal_url")).join(merged.where("action <> 'kept'").select("title", "portal_url", "action"), ["title", "portal_url"])
    again = found.join(known, "url", "left_semi").select("url", F.col("url").alias("portal_url"), F.lit("duplicate").alias("action"))
    failed = read.where("why is not null").select(F.col("source").alias("url"), F.lit(None).cast("string").alias("portal_url"), F.col("why").alias("action"))
    outcomes = again.unionByName(failed).unionByName(done.select(F.col("source").alias("url"), "portal_url", "action"))
    table = archive_expired(merged.withColumnRenamed("next_cycle", "before"), as_of).withColumn("next_cycle", F.coalesce("next_cycle", "before"))
    n_archived = merged.agg(F.count_if(expired(F.lit(as_of).cast("date"))).alias("archived"))
    taken = store.commit(step, replace={"opportunities": table.select([F.col(c).cast(t).alias(c) for c, t in now.dtypes]), "outcomes": outcomes, "archived": n_archived})
    for df in (fresh, read, merged):
        discard(df)
    return taken


def run(
    store: Versions, step: int, pages: DataFrame, seeds: DataFrame, as_of: str, *, depth: int = 2, cap: int = 15, limit: int | None = None, codes: DataFrame | None = None, extract: Extraction | None = None
) -> DataFrame:
    """A crawl from seeds (url, pos) taken into the store's opportunities by ingest(); limit: only the most relevant candidates. One row of counters."""
    taken = crawling.crawled_pages(pages, seeds, depth, cap)
    found = written(crawling.best_candidates(crawling.candidates(pages, taken), limit), "candidates")
    ingest(store, step, found, pages, as_of, codes, extract)
    return counters(store, taken)


def counters(store: Versions, taken: DataFrame) -> DataFrame:
    """One row: pages and errors of a crawl, what became of its candidates, and how many opportunities the step archived."""
    pages = taken.agg(F.count_if(F.col("outcome") == "fetched").alias("pages_crawled"), F.count_if(F.col("outcome") == "failed").alias("errors"))
    each = store.read("outcomes").agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])
    return pages.join(each, how="cross").join(store.read("archived"), how="cross")  # one row each
