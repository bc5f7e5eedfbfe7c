"""Support: replies by topic, conversation histories, and tickets of escalated conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritlake.functions.labels import lookup
from meritlake.functions.vocabulary import REPLIES
from meritlake.operators.events import MAX_TURNS, topic

OTHER = "I can only assist with questions about this product. Please ask about your account, matches or deadlines."
NOTHING_SAID = "No user messages captured."


def reply(message: Column, other: str = OTHER) -> Column:
    """The answer to a message's topic, or the one for all others."""
    return F.coalesce(F.try_element_at(lookup(REPLIES), topic(message)), F.lit(other))


def history(transcript: Column) -> Column:
    """The turns of a transcript array<struct<role, content>> that a user or the assistant filled, in order."""
    return F.filter(transcript, lambda t: t["role"].isin("user", "assistant") & (F.coalesce(t["content"], F.lit("")) != ""))


def tickets(turns: DataFrame, users: DataFrame, most: int = MAX_TURNS) -> DataFrame:
    """(conv_id, subject, summary, n_turns, status): a ticket for each conversation (conv_id, turn, role, text) with most user turns.

    The transcript ends with the turn that escalates it; its user turns, 500 characters at most, are the summary. users:
    (conv_id, email). Turns behind the last that counts are dropped before they are gathered.
    """
    asked = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = turns.withColumn("asked", asked).where((F.col("asked") < most) | ((F.col("asked") == most) & (F.col("role") == "user")))
    of_user = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))))
    made = counted.groupBy("conv_id").agg(of_user.alias("said"), F.count(F.lit(1)).alias("n_turns")).where(F.size("said") >= most)
    summary = F.left(F.array_join(F.col("said.text"), " "), F.lit(500))
    out = made.join(users.select("conv_id", "email"), "conv_id", "left")
    return out.select("conv_id", F.concat(F.lit("Support escalation from "), F.coalesce("email", F.lit(""))).alias("subject"), F.when(summary == "", NOTHING_SAID).otherwise(summary).alias("summary"), "n_turns", F.lit("open").alias("status"))


def latest_tickets(asks: DataFrame, tickets: DataFrame) -> DataFrame:
    """asks (user_id, at, ask_id) with ticket_id and opened_at of the user's latest ticket (user_id, at, ticket_id) at that time or before; null without one.

    Both tables go in one order, so an ask costs no range of tickets. Of tickets of one time the largest id counts. Asks or
    tickets without a user or a time meet nothing.
    """
    none = F.lit(None)
    both = asks.select("user_id", "at", "ask_id", none.cast("long").alias("ticket_id"), F.lit(1).alias("turn")).unionByName(
        tickets.where("user_id is not null and at is not null").select("user_id", "at", none.cast("long").alias("ask_id"), "ticket_id", F.lit(0).alias("turn"))
    )
    before = Window.partitionBy("user_id").orderBy("at", "turn", "ticket_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("turn") == 0, F.struct("ticket_id", F.col("at").alias("opened_at"))), ignorenulls=True).over(before)
    met = F.when(F.col("user_id").isNotNull() & F.col("at").isNotNull(), F.col("last"))
    return both.withColumn("last", last).where("turn = 1").select("user_id", "at", "ask_id", met["ticket_id"].alias("ticket_id"), met["opened_at"].alias("opened_at"))
