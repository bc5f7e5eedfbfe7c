"""Billing events as a stream: whose each event is settles as links arrive, in whatever order batches come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.operators import events
from meritlake.sources.tables import written
from meritlake.sources.versions import Versions

TABLES = ("log", "links", "effects")


def begin(store: Versions, profiles: DataFrame) -> None:
    """The tables before the first batch: the links of profiles (user_id, customer). Does nothing where there are any."""
    store.commit(0, replace={"links": events.first_links(events.profile_links(profiles))})


def taker(store: Versions, profiles: DataFrame) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls with a batch of billing events and its number.

    An event id that has come before is dropped, so is a batch that was taken before. A batch's links are merged with those
    there are, the first of each customer or subscription staying. Events whose link is new or has become older, among them
    those held back as no_profile until now, are settled anew with the batch's own. log and effects only grow: of an
    event's effects the last batch's counts.
    """

    def take(batch: DataFrame, number: int) -> None:
        step, now = number + 1, store.current()
        if step <= now["step"]:
            return
        named = events.named_events(profiles, batch.dropDuplicates(["seq"]))
        log = store.read("log") if "log" in now["tables"] else None
        if log is not None:
            named = named.join(log.select("seq"), "seq", "left_anti")
        new, links = written(named, "billing"), store.read("links")
        merged = written(events.first_links(links.unionByName(events.account_links(new))), "links")
        due = new
        if log is not None:
            changed = merged.join(links, ["of", "key", "owner", "since"], "left_anti")
            hit = [log.join(changed.where(F.col("of") == of).select(F.col("key").alias(of)), of, "left_semi") for of in ("customer", "subscription")]
            due = new.unionByName(hit[0].unionByName(hit[1]).dropDuplicates(["seq"]).select(new.columns))
        effects = events.resolved(due, merged).withColumn("step", F.lit(step))
        store.commit(step, replace={"links": merged}, append={"log": new, "effects": effects})

    return take


def settled(store: Versions) -> DataFrame:
    """(seq, user_id, outcome, status) of all events so far, as events.billed() has them."""
    last = store.read("effects").groupBy("seq").agg(F.max_by(F.struct("user_id", "outcome", "status"), "step").alias("e"))
    return last.select("seq", "e.*")
