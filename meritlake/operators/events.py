"""Subscriptions from billing events, and support conversations from turns: ordered folds over each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritlake.functions.labels import strings
from meritlake.functions.vocabulary import REFUSED, TOPICS

MAX_TURNS = 4


def subscriptions(events: DataFrame) -> DataFrame:
    """(user_id, tier, status, renewals, dunnings, ignored) after all billing events (user_id, at, seq, kind), in order.

    created: premium and active; deleted: free and canceled; paid: premium, active, a renewal; failed: a dunning mail, no
    change; others are ignored. The last event that changes anything decides, so that sums and one maximum for each user do.
    """
    kind, order = F.col("kind"), F.struct("at", "seq")
    last = F.max_by("kind", F.when(kind.isin("created", "paid", "deleted"), order))
    counts = [F.count_if(kind == "paid").alias("renewals"), F.count_if(kind == "failed").alias("dunnings"), F.count_if(~kind.isin("created", "paid", "deleted", "failed")).alias("ignored")]
    each = events.groupBy("user_id").agg(last.alias("last"), *counts)
    return each.select(
        "user_id", F.when(F.col("last").isin("created", "paid"), "premium").otherwise("free").alias("tier"),
        F.when(F.col("last") == "deleted", "canceled").when(F.col("last").isNotNull(), "active").alias("status"), "renewals", "dunnings", "ignored",
    )


def named_events(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """Billing events (seq, kind, meta_user, customer, subscription, state, reason) with named: whether the user they name has a profile."""
    users = profiles.select(F.col("user_id").alias("meta_user"), F.lit(True).alias("named")).distinct()
    return events.join(users, "meta_user", "left").withColumn("named", F.coalesce("named", F.lit(False)))


def account_links(named: DataFrame) -> DataFrame:
    """(of, key, owner, since): whose each customer and subscription is, by the first created event that names a user with a profile."""
    made = named.where("kind = 'created' and named")
    each = [made.where(f"{of} is not null").select(F.lit(of).alias("of"), F.col(of).alias("key"), F.col("meta_user").alias("owner"), F.col("seq").alias("since")) for of in ("customer", "subscription")]
    return first_links(each[0].unionByName(each[1]))


def profile_links(profiles: DataFrame) -> DataFrame:
    """The links that profiles (user_id, customer) begin with, before all events."""
    return profiles.where("customer is not null").select(F.lit("customer").alias("of"), F.col("customer").alias("key"), F.col("user_id").alias("owner"), F.lit(-1).cast("long").alias("since"))


def first_links(links: DataFrame) -> DataFrame:
    """The first link of each customer and subscription."""
    return links.groupBy("of", "key").agg(F.min_by("owner", F.struct("since", "owner")).alias("owner"), F.min("since").alias("since"))


def resolved(named: DataFrame, links: DataFrame) -> DataFrame:
    """(seq, user_id, outcome, status) of named_events(), by links that are older than an event."""
    of = lambda key: links.where(F.col("of") == key).select(F.col("key").alias(key), F.col("owner").alias(f"{key}_owner"), F.col("since").alias(f"{key}_since"))
    found = named.join(of("customer"), "customer", "left").join(of("subscription"), "subscription", "left")
    kind = F.col("kind")
    by_customer = F.when(F.col("customer_since") < F.col("seq"), F.col("customer_owner"))
    by_sub = F.when((kind == "deleted") & (F.col("subscription_since") < F.col("seq")), F.col("subscription_owner"))
    user = F.coalesce(F.when((kind == "created") & F.col("named"), F.col("meta_user")), by_customer, by_sub)
    skipped = ~kind.isin("created", "deleted", "paid", "failed") | ((kind == "paid") & (F.coalesce("reason", F.lit("")) != "subscription_cycle"))
    outcome = F.when(skipped, "ignored").when(user.isNull(), "no_profile").when(kind == "created", "updated").when(kind == "deleted", "downgraded").when(kind == "paid", "renewed").otherwise("dunning_sent")
    status = F.when(kind == "created", F.col("state")).when(kind == "deleted", "canceled").when(kind == "paid", "active")
    return found.select("seq", F.when(~skipped, user).alias("user_id"), outcome.alias("outcome"), F.when(~skipped & user.isNotNull(), status).alias("status"))


def billed(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """(seq, user_id, outcome, status) of billing events (seq, kind, meta_user, customer, subscription, state, reason).

    An event is that of the user it names, else of the customer's, else (deleted only) of the subscription's; created
    events tell whose customer and subscription are, before later ones. A customer belongs to one user, the first. Outcomes:
    updated, renewed (cycle invoices only), downgraded, dunning_sent, no_profile, ignored. profiles: (user_id, customer).
    """
    named = named_events(profiles, events)
    return resolved(named, first_links(profile_links(profiles).unionByName(account_links(named))))


def billed_profiles(billed_events: DataFrame) -> DataFrame:
    """(user_id, tier, status, n_events): what all of a user's billed events leave; created counts as premium only if active or trialing."""
    e = billed_events.where("user_id is not null")
    tier = F.when((F.col("outcome") == "renewed") | ((F.col("outcome") == "updated") & F.col("status").isin("active", "trialing")), "premium").when(F.col("outcome") == "downgraded", "free")
    named = e.withColumn("tier", tier)
    return named.groupBy("user_id").agg(
        F.coalesce(F.max_by("tier", F.when(F.col("tier").isNotNull(), F.col("seq"))), F.lit("free")).alias("tier"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), F.count(F.lit(1)).alias("n_events"),
    )


def refused(message: Column) -> Column:
    """Whether a message is off topic or tries to change the rules; an empty one is not."""
    low = F.lower(F.trim(message))
    return F.coalesce(F.exists(strings(REFUSED), lambda p: low.contains(p)), F.lit(False))


def topic(message: Column) -> Column:
    """The first topic with a word in the message, or other."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("other")
    for name, words in reversed(TOPICS.items()):
        out = F.when(F.exists(strings(words), lambda w: low.contains(w)), name).otherwise(out)
    return out


def conversations(turns: DataFrame, most: int = MAX_TURNS) -> DataFrame:
    """(conv_id, turn_count, is_escalated, n_refused, first_topic, summary) of each conversation's user turns (conv_id, turn, text).

    A conversation counts most turns, refused ones too; with the last of them it is escalated for good, and later turns
    count nowhere. The summary has the first 500 characters of the turns that counted.
    """
    first = turns.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("nth") <= most)  # before they are gathered
    said = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("said"))
    texts = F.transform("said", lambda t: t["text"])
    return said.select(
        "conv_id", F.size("said").cast("long").alias("turn_count"), (F.size("said") >= most).alias("is_escalated"),
        F.size(F.filter(texts, refused)).cast("long").alias("n_refused"), topic(F.get(texts, F.lit(0))).alias("first_topic"), F.left(F.array_join(texts, " "), F.lit(500)).alias("summary"),
    )
