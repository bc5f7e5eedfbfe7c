"""Batch jobs over opportunities and users: expiry, counts and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.functions.display import first_name
from meritlake.operators.exports import money

WINDOW_DAYS, LOOKBACK_DAYS = 14, 30


def expired(as_of: Column) -> Column:
    """Past its deadline and not archived yet; a null flag is never true, as in a filter."""
    return (F.col("deadline") < as_of) & (~F.col("is_archived"))


def archive_expired(opportunities: DataFrame, as_of: str) -> DataFrame:
    """opportunities with expired ones archived, and next_cycle a year after their deadline (28 February for the 29th)."""
    now = F.lit(as_of).cast("date")
    gone = F.coalesce(expired(now), F.lit(False))
    return opportunities.withColumns({"next_cycle": F.when(gone, F.add_months("deadline", 12)), "is_archived": F.when(gone, True).otherwise(F.col("is_archived"))})


def archival_summary(opportunities: DataFrame, as_of: str) -> DataFrame:
    """One row of counts, in one pass: total, active, archived, and expired though active."""
    now = F.lit(as_of).cast("date")
    return opportunities.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_archived")).alias("active"), F.count_if("is_archived").alias("archived"), F.count_if(expired(now)).alias("expired_active")
    )


def deadline_digest(profiles: DataFrame, trackings: DataFrame, opportunities: DataFrame, as_of: str, days: int = WINDOW_DAYS) -> DataFrame:
    """(user_id, email, n_entries, subject, body): for each user who opted in, the tracked deadlines from as_of to days ahead, soonest first."""
    now = F.lit(as_of).cast("date")
    users = profiles.where("marketing_opt_in and email is not null").select("user_id", "email", "full_name")
    live = trackings.where("not is_dismissed and status <> 'archived'").select("user_id", "opp_id")
    due = opportunities.where(~F.coalesce("is_archived", F.lit(False)) & F.col("deadline").between(now, F.date_add(now, days)))
    left = F.datediff("deadline", now)
    line = F.concat(
        F.lit("  • "), F.col("title"), F.lit(" — "), money(F.col("award")), F.lit(" (due in "), left.cast("string"), F.when(left == 1, " day)").otherwise(" days)"), F.lit("\n    Apply: "), F.col("portal_url"), F.lit("\n\n")
    )
    entries = live.join(due, "opp_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(left.alias("left"), "opp_id", line.alias("line")))).alias("entries"))
    n = F.size("entries")
    many = F.when(n == 1, " scholarship deadline approaching").otherwise(" scholarship deadlines approaching")
    body = F.concat(F.lit("Hi "), F.coalesce("full_name", F.lit("there")), F.lit(",\n\nYou have "), n.cast("string"), many, F.lit(f" in the next {days} days:\n\n"), F.array_join("entries.line", ""), F.lit("Stay on track!\n"))
    return users.join(entries, "user_id").select("user_id", "email", n.cast("long").alias("n_entries"), F.concat(n.cast("string"), many).alias("subject"), body.alias("body"))


def reengagement_digest(profiles: DataFrame, opportunities: DataFrame, as_of: str, days: int = LOOKBACK_DAYS) -> DataFrame:
    """(user_id, email, n_new, total, subject): recent active opportunities for each free user who opted in; users without any are left out.

    A user with a single discipline counts opportunities that list it in the same words; others count all. Opportunities are
    counted by discipline first, so the join is with one small row a discipline.
    """
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    recent = opportunities.where(~F.coalesce("is_archived", F.lit(False)) & (F.col("created_on") >= since) & (F.col("created_on") <= F.lit(as_of).cast("date")))
    tally = [F.count(F.lit(1)).alias("n_new"), F.coalesce(F.sum("award"), F.lit(0)).cast("long").alias("total")]
    listed = recent.select("award", F.explode(F.array_distinct("disciplines")).alias("discipline")).groupBy("discipline").agg(*tally)
    every = recent.agg(*tally).select(F.lit("*").alias("discipline"), "n_new", "total")
    users = profiles.where("marketing_opt_in and email is not null and tier = 'free'").select("user_id", "email", F.coalesce("primary_discipline", F.lit("*")).alias("discipline"))
    subject = F.concat(F.col("n_new").cast("string"), F.when(F.col("n_new") == 1, " new scholarship").otherwise(" new scholarships"), F.lit(" worth "), money(F.col("total")))
    return users.join(listed.unionByName(every), "discipline").where("n_new > 0").select("user_id", "email", "n_new", "total", subject.alias("subject"))


def receipt_text(first: Column, amount: Column, plan: Column) -> Column:
    """A receipt for first name, shown amount (may be null) and plan."""
    return F.concat(F.lit("Hi "), first, F.lit(",\n\nThank you for your payment"), F.when(amount.isNotNull(), F.concat(F.lit(" of "), amount)).otherwise(""), F.lit(" for "), plan, F.lit(".\n"))


def reengagement_mails(profiles: DataFrame, opportunities: DataFrame, as_of: str, days: int = LOOKBACK_DAYS) -> DataFrame:
    """(user_id, n_new, total, subject, body, html): a mail for each free user who opted in; without anything new a shorter one."""
    users = profiles.where("marketing_opt_in and email is not null and tier = 'free'").select("user_id", "full_name")
    found = users.join(reengagement_digest(profiles, opportunities, as_of, days).select("user_id", "n_new", "total"), "user_id", "left").withColumns({"n_new": F.coalesce("n_new", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    n, worth, first, none = F.col("n_new").cast("string"), money(F.col("total")), first_name(F.col("full_name")), F.col("n_new") == 0
    soon = "We're constantly indexing new scholarships for clinical health students. Check back soon for fresh opportunities matched to your discipline."
    news = lambda a, b: F.concat(F.lit(f"Update: {a}"), n, F.lit(f" new scholarships{b} ({a}"), worth, F.lit(f" total{b}) were just indexed for your discipline!"))
    text = F.when(none, soon).otherwise(F.concat(news("", ""), F.lit("\n\nLog in to see your fresh matches and start applying.")))
    html = F.when(none, f"<p>{soon}</p>").otherwise(F.concat(F.lit("<p>"), news("<strong>", "</strong>"), F.lit("</p><p>Log in to see your fresh matches and start applying.</p>")))
    return found.select(
        "user_id", "n_new", "total", F.when(none, "New scholarships coming soon").otherwise(F.concat(F.lit("Update: "), n, F.lit(" new scholarships ("), worth, F.lit(" total) for your discipline!"))).alias("subject"),
        F.concat(F.lit("Hi "), first, F.lit(",\n\n"), text, F.lit("\n")).alias("body"), F.concat(F.lit("<html><body><p>Hi "), first, F.lit(",</p>"), html, F.lit("</body></html>")).alias("html"),
    )
