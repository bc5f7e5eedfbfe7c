"""From pages to opportunities: what a page says, what its source adds, whether it is complete, and what a batch changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritlake.functions import web
from meritlake.functions.labels import credentials_in, disciplines_in, filled, metros_in, strings
from meritlake.functions.parsing import amount, day, residency
from meritlake.operators.writing import upsert
from meritlake.sources.tables import written

#: The labels of disciplines that an extraction may use.
KNOWN = ["pharmacy", "medicine", "nursing", "therapeutics_rehab", "diagnostic_imaging", "public_health_emergency"]


def sanitized(labels: Column, text: Column, keep_any: bool = False) -> Column:
    """Known disciplines of extracted labels, each once; without any, those of the text's words.

    keep_any: a label that opens an award to all stays; else it is dropped, and words may then restrict the award.
    """
    tidy = F.transform(filled(labels), lambda x: F.translate(F.lower(F.trim(x)), "- ", "__"))
    known = F.array_distinct(F.filter(tidy, lambda x: x.isin(*KNOWN, *(["any"] if keep_any else []))))
    return F.when(F.size(known) > 0, known).otherwise(disciplines_in(text))


def extracted(pages: DataFrame, as_of: str) -> DataFrame:
    """(page_id, url, title, award, deadline, disciplines, credentials, metros, state) as each page (page_id, url, html) itself says.

    The award is the first sum of money, the deadline the first date behind the word; either may be missing.
    """
    read = pages.select("page_id", F.trim("url").alias("url"), web.title_in(F.col("html")).alias("title"), web.text_in(F.col("html")).alias("text"))
    money = F.regexp_extract("text", r"[$£€]\s*\d[\d,]*(?:\.\d+)?", 0)
    due = F.regexp_extract("text", r"(?i)\bdeadline:?\s+([A-Za-z]{3,9}\.? \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})", 1)
    return read.select(
        "page_id", "url", "title", amount(money).alias("award"), day(due, as_of).alias("deadline"), disciplines_in(F.col("text")).alias("disciplines"),
        credentials_in(F.col("text")).alias("credentials"), metros_in(F.col("text")).alias("metros"), residency(F.col("text")).alias("state"),
    )


def sorted_out(raw: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) of raw records (..., title, award, deadline, as texts): what parses, with award and deadline as values, and the rest as it came, with reasons.

    A record without a title, with an award that says a sum of no number, or with a deadline that is no date does not parse;
    one without an award or a deadline does. Either table is read from one written pass, and each record is in one of them.
    """
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    sum_, due = amount(F.col("award")), day(F.col("deadline"), as_of)
    reasons = F.array_compact(F.array(
        F.when(said("title") == "", "no title"), F.when((said("award") != "") & sum_.isNull(), "no sum of money"), F.when((said("deadline") != "") & due.isNull(), "no date"),
    ))
    read = written(raw.select("*", sum_.alias("_award"), due.alias("_deadline"), reasons.alias("reasons")), "sorted")
    fine = F.size("reasons") == 0
    kept = read.where(fine).drop("award", "deadline", "reasons").withColumnsRenamed({"_award": "award", "_deadline": "deadline"})
    return kept, read.where(~fine).drop("_award", "_deadline")


def completed(extracts: DataFrame, sources: DataFrame) -> DataFrame:
    """Extracts with what their source (url, name, category, primary_discipline, target_credentials, state_restriction) adds where they say nothing, and whether they are complete.

    Complete is what has a title, an award and a deadline. Of several sources of an address the first by nth counts, if they have one, else by name and the other columns.
    """
    given = F.struct(*(["nth"] if "nth" in sources.columns else []), F.col("name").alias("source_name"), "category", "primary_discipline", "target_credentials", "state_restriction")
    s = sources.groupBy("url").agg(F.min(given).alias("s")).select("url", "s.source_name", "s.category", "s.primary_discipline", "s.target_credentials", "s.state_restriction")
    joined = extracts.join(s, "url", "left")
    own = F.when(F.coalesce("primary_discipline", F.lit("any")) != "any", F.array("primary_discipline")).otherwise(strings([]))
    return joined.select(
        "page_id", "url", "title", F.coalesce("source_name", F.lit("")).alias("provider"), F.coalesce("category", F.lit("general")).alias("category"), "award", "deadline",
        F.when(F.size("disciplines") > 0, F.col("disciplines")).otherwise(own).alias("disciplines"),
        F.when(F.size("credentials") > 0, F.col("credentials")).otherwise(filled(F.col("target_credentials"))).alias("credentials"),
        "metros", F.coalesce("state", F.upper("state_restriction")).alias("state"),
        ((F.coalesce("title", F.lit("")) != "") & F.col("award").isNotNull() & F.col("deadline").isNotNull()).alias("complete"),
    )


def persisted(current: DataFrame, extracts: DataFrame, as_of: str, judged: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The table (title, portal_url, award, deadline, is_archived) after an upsert of complete extracts, and (action, n) of the batch.

    An opportunity past its deadline is archived as it is written. judged: the columns whose change makes an update; all by default.
    """
    batch = extracts.where("complete").select("title", F.col("url").alias("portal_url"), "award", "deadline", (F.col("deadline") < F.lit(as_of).cast("date")).alias("is_archived"), F.col("page_id").alias("nth"))
    table = upsert(current, batch, ["title", "portal_url"], "nth", judged=judged)
    skipped = extracts.where(~F.col("complete")).groupBy(F.lit("incomplete").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return table, table.where("action <> 'kept'").groupBy("action").agg(F.count(F.lit(1)).alias("n")).unionByName(skipped)


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key by at."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def with_tokens(profiles: DataFrame, salt: str) -> DataFrame:
    """profiles whose missing feed_token is a digest of salt and user_id, the same at every run."""
    return profiles.withColumn("feed_token", F.coalesce("feed_token", F.sha2(F.concat(F.lit(salt), F.col("user_id").cast("string")), 256)))
