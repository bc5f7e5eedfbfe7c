"""What a free profile sees: the first rows of a feed, the others masked; and the weekly search quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VISIBLE, SEARCHES, CYCLE_DAYS = 3, 10, 7
BLOCK = "█"


def mask_title(title: Column) -> Column:
    """The first word, and a block of four or more for each other; of one word its first character and a block; of none ten."""
    words = F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: w != "")
    rest = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.repeat(F.lit(BLOCK), F.greatest(F.lit(4), F.length(w))))
    single = F.concat(F.left(title, F.lit(1)), F.lit(" "), F.repeat(F.lit(BLOCK), F.greatest(F.lit(6), F.length(title) - 2)))
    return F.when(F.coalesce(title, F.lit("")) == "", BLOCK * 10).when(F.size(words) <= 1, single).otherwise(F.concat_ws(" ", F.get(words, F.lit(0)), F.array_join(rest, " ")))


def mask_provider(provider: Column) -> Column:
    """The first character and a block."""
    masked = F.concat(F.left(provider, F.lit(1)), F.lit(" "), F.repeat(F.lit(BLOCK), F.greatest(F.lit(4), F.length(provider) - 1)))
    return F.when(F.coalesce(provider, F.lit("")) == "", BLOCK * 10).otherwise(masked)


def with_masks(opportunities: DataFrame) -> DataFrame:
    """Opportunities with masked_title and masked_provider, so that a feed need not make them for each row."""
    return opportunities.withColumns({"masked_title": mask_title(F.col("title")), "masked_provider": mask_provider(F.col("provider"))})


def gated(feed: DataFrame, visible: int = VISIBLE) -> DataFrame:
    """A ranked feed as its profile's tier may see it: free profiles see the first rows whole, the others masked (with_masks, or here) and without messages."""
    feed = feed if "masked_title" in feed.columns else with_masks(feed)
    locked = (F.col("u_tier") != "premium") & (F.col("rank") > visible)
    return feed.withColumns({
        "is_locked": locked,
        "shown_title": F.when(locked, F.col("masked_title")).otherwise(F.col("title")),
        "shown_provider": F.when(locked, F.col("masked_provider")).otherwise(F.col("provider")),
        "portal_url": F.when(locked, "").otherwise(F.col("portal_url")),
    }).drop("masked_title", "masked_provider")


def quota(searches: DataFrame, limit: int = SEARCHES, days: int = CYCLE_DAYS) -> DataFrame:
    """(user_id, cycle_start, used, allowed, blocked) after all of each user's searches (user_id, at, seq), in order of (at, seq).

    A search at or after the cycle's end starts a new cycle with itself; the first starts the first one. At the limit
    searches are blocked. Native: an ordered fold over each user's searches.
    """
    events = searches.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros("at").alias("t"), "seq"))).alias("events"))
    span = days * 86_400_000_000
    start = F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("allowed"), F.lit(0).cast("bigint").alias("blocked"))

    def step(s: Column, e: Column) -> Column:
        fresh = s["start"].isNull() | (e["t"] >= s["start"] + span)
        used = F.when(fresh, F.lit(0).cast("bigint")).otherwise(s["used"])
        ok = used < limit
        return F.struct(
            F.when(fresh, e["t"]).otherwise(s["start"]).alias("start"),
            (used + ok.cast("bigint")).alias("used"),
            (s["allowed"] + ok.cast("bigint")).alias("allowed"),
            (s["blocked"] + (~ok).cast("bigint")).alias("blocked"),
        )

    end = events.select("user_id", F.aggregate("events", start, step).alias("s"))
    return end.select("user_id", F.timestamp_micros("s.start").alias("cycle_start"), "s.used", "s.allowed", "s.blocked")


def feed_totals(totals: DataFrame, visible: int = VISIBLE) -> DataFrame:
    """(user_id, total, visible, worth, best): a filtered feed's rows before gating, those that stay unlocked, their awards and best score. totals: all but visible, with u_tier."""
    return totals.select("user_id", "total", F.when(F.col("u_tier") == "premium", F.col("total")).otherwise(F.least("total", F.lit(visible))).alias("visible"), "worth", "best")


def tracking_limits(trackings: DataFrame, profiles: DataFrame, most: int = VISIBLE) -> DataFrame:
    """(user_id, n_active, at_limit): trackings that are not archived; premium users are never at the limit."""
    active = trackings.groupBy("user_id").agg(F.count_if(F.col("status") != "archived").alias("n_active"))
    joined = profiles.select("user_id", "tier").join(active, "user_id", "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)))
    return joined.select("user_id", "n_active", ((F.col("tier") != "premium") & (F.col("n_active") >= most)).alias("at_limit"))


def counted_searches(searches: DataFrame, profiles: DataFrame) -> DataFrame:
    """The searches that are debited: with a keyword, by users who are not premium."""
    return searches.where("keyword").join(profiles.where("tier <> 'premium'").select("user_id"), "user_id", "left_semi")


def usage(states: DataFrame, now: Column, limit: int = SEARCHES, days: int = CYCLE_DAYS) -> DataFrame:
    """(user_id, used, remaining, resets_at) as shown at now: a cycle that is over begins anew with the look."""
    span = F.expr(f"interval {days} days")
    over = now >= F.col("cycle_start") + span
    used = F.when(over, F.lit(0).cast("long")).otherwise(F.col("used"))
    return states.select("user_id", used.alias("used"), (F.lit(limit) - used).alias("remaining"), (F.when(over, now).otherwise(F.col("cycle_start")) + span).alias("resets_at"))
