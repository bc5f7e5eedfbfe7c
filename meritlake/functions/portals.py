"""Pages of known portals: which rules a page's address calls for, and what the page says by them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.functions import labelled
from meritlake.functions.labels import credentials_in, disciplines_in, strings
from meritlake.functions.parsing import amount, clean, day, split_list, state_hint

# Portals in order of precedence: what the address holds, the provider, labels of award and deadline, the title and the disciplines of pages that name none, tags.
PORTALS = [
    ("pharmacist.com", "American Pharmacists Association", ["Award", "Amount", "Stipend", "Scholarship Amount"], ["Deadline", "Application Deadline", "Due Date"], "APhA Scholarship", ["pharmacy"], ["apha", "pharmacy"]),
    ("aacnnursing.org", "American Association of Colleges of Nursing", ["Award", "Amount", "Funding"], ["Deadline", "Application Deadline"], "AACN Scholarship", ["nursing"], ["aacn", "nursing"]),
    (".gov", None, ["Award", "Amount", "Maximum Award", "Scholarship Value"], ["Deadline", "Application Deadline", "Apply By"], "State Scholarship", [], ["state", "higher-ed"]),
    ("scholarship", "", ["Award", "Amount", "Value", "Prize"], ["Deadline", "Due", "Closes"], "", [], []),
]
BOARD = "State Higher Education Board"
FACTS = "page_title string, text string, heading string, publisher string, sponsor string, award string, due string, criteria string, tags string"


def portal_of(url: Column) -> Column:
    """The place in PORTALS of the first portal that an address belongs to, or null."""
    low, out = F.lower(url), F.lit(None).cast("int")
    for k, p in reversed([*enumerate(PORTALS)]):
        out = F.when(low.contains(p[0]), k).otherwise(out)
    return out


def _facts(html: Column, portal: Column) -> Column:
    @F.pandas_udf(FACTS)
    def read(pages: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = []
        for h, k in zip(pages, kinds, strict=True):
            page, p = labelled.Page(h), PORTALS[int(k)]  # parsed once for all that is read
            rows.append((page.first("title"), page.visible(), page.first("h1", "h2"), page.publisher(), page.sponsor(), page.value(p[2]), page.value(p[3]), page.criteria(), page.value(["Tags", "Categories"])))
        return pd.DataFrame(rows, columns=["page_title", "text", "heading", "publisher", "sponsor", "award", "due", "criteria", "tags"])

    return read(html, portal)


def portal_extracts(pages: DataFrame, as_of: str) -> DataFrame:
    """(page_id, url, portal, title, provider, award, deadline, disciplines, credentials, states, tags) of pages (page_id, url, html) that a portal's rules cover.

    Only the HTML itself is read in Python, as tags nest; amounts, dates and labels are columns.
    """
    known = pages.select("page_id", "url", "html", portal_of(F.col("url")).alias("k")).where("k is not null")
    read = known.withColumn("f", _facts(F.col("html"), F.col("k"))).withColumn("whole", clean(F.concat_ws(" ", "f.criteria", "f.page_title", "f.text")))
    by = lambda field: F.get(F.array(*[field(p) for p in PORTALS]), F.col("k"))
    blob = F.when(F.col("k") == 2, F.col("f.criteria")).otherwise(F.col("whole"))
    page_title = clean(F.substring_index(F.substring_index("f.page_title", "|", 1), "-", 1))
    board = F.coalesce(F.nullif(F.col("f.publisher"), F.lit("")), F.when(F.col("f.page_title") == "", BOARD).otherwise(page_title))
    found = disciplines_in(blob)
    return read.select(
        "page_id", "url", by(lambda p: F.lit(p[0])).alias("portal"), F.coalesce(F.nullif(F.col("f.heading"), F.lit("")), by(lambda p: F.lit(p[4]))).alias("title"),
        F.when(F.col("k") == 2, board).when(F.col("k") == 3, F.col("f.sponsor")).otherwise(by(lambda p: F.lit(p[1]))).alias("provider"),
        amount(F.col("f.award")).alias("award"), day(F.col("f.due"), as_of).alias("deadline"),
        F.when(F.size(found) > 0, found).otherwise(by(lambda p: strings(p[5]))).alias("disciplines"), credentials_in(blob).alias("credentials"),
        F.when(F.col("k") == 2, F.array_compact(F.array(state_hint(F.col("url"))))).otherwise(strings([])).alias("states"),
        F.when(F.col("k") == 3, split_list(F.col("f.tags"))).otherwise(by(lambda p: strings(p[6]))).alias("tags"),
    )
