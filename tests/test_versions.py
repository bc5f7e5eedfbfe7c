"""Tables that change in steps, and what is built on them: upserts and billing in batches, the queue in rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meritlake.operators import crawling, events, writing
from meritlake.sources.versions import Versions
from meritlake.streaming import billing


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_steps_are_whole_and_taken_once(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/store")
    one, two = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(2, "b")], "k long, v string")
    assert store.current()["step"] == -1
    assert store.commit(3, replace={"t": one}, append={"log": one}) and rows(store.read("t")) == [(1, "a")]
    assert not store.commit(3, replace={"t": two}) and not store.commit(2, append={"log": two})
    assert rows(store.read("t")) == rows(store.read("log")) == [(1, "a")]
    bad = two.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit(4, replace={"t": two}, append={"log": bad})
    assert rows(store.read("t")) == [(1, "a")] and store.current()["step"] == 3
    assert store.commit(4, replace={"t": two}, append={"log": two})
    assert (rows(store.read("t")), rows(store.read("log"))) == ([(2, "b")], [(1, "a"), (2, "b")])
    assert rows(Versions(spark, f"file://{tmp_path}/store").read("t", 0)) == [(1, "a")]


def test_upserts_of_a_stream_with_a_repeated_batch(spark, tmp_path):
    kind = "id long, v string, at long"
    store = Versions(spark, f"file://{tmp_path}/store")
    store.commit(0, replace={"t": spark.createDataFrame([(1, "old"), (9, "kept")], "id long, v string")})

    def take(batch, number):
        now = store.read("t")
        store.commit(number + 1, replace={"t": writing.upsert(now, batch, ["id"], "at").select(now.columns)})

    batches = [spark.createDataFrame([(1, "x", 1), (1, "new", 2), (2, "a", 3)], kind), spark.createDataFrame([(2, "b", 4), (3, None, 5)], kind)]
    for number in (0, 0, 1, 0, 1):
        take(batches[number], number)
    assert rows(store.read("t")) == [(1, "new"), (2, "b"), (3, None), (9, "kept")]


def test_billing_in_any_order_of_batches(spark, tmp_path):
    rng = random.Random(3)
    kind = "seq long, kind string, meta_user long, customer string, subscription string, state string, reason string"
    made = [(k, rng.choice(["created", "paid", "deleted", "failed", "other"]), rng.choice([None, 1, 2, 3, 99]), rng.choice([None, "c1", "c2", "c3"]), rng.choice([None, "s1", "s2"]), rng.choice(["active", "trialing", "incomplete"]), rng.choice([None, "subscription_cycle"])) for k in range(120)]
    profiles = spark.createDataFrame([(1, "c1"), (2, None), (3, None)], "user_id long, customer string")
    want = events.billed(profiles, spark.createDataFrame(made, kind))
    for run in range(2):
        rng.shuffle(made)
        store = Versions(spark, f"file://{tmp_path}/store{run}")
        billing.begin(store, profiles)
        take = billing.taker(store, profiles)
        for number, part in enumerate([made[:30], made[20:70], made[70:], made[:10]]):  # some come twice
            batch = spark.createDataFrame(part, kind)
            take(batch, number)
            take(batch, number)  # and a batch is delivered again
        assert rows(billing.settled(store)) == rows(want, *billing.settled(store).columns)
        assert store.read("log").count() == 120
        assert rows(events.billed_profiles(billing.settled(store))) == rows(events.billed_profiles(want))


@pytest.mark.parametrize("batch", [None, 2])
def test_queue_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch, batch):
    url = lambda k: f"https://h.example.edu/grants/{k}"
    seeds = spark.createDataFrame([(url(0), "queued", 1, 2, None), ("https://x.org/", "queued", 0, 0, None), (url(7), "failed", 0, 4, None)], "url string, status string, priority int, error_count int, last_crawled_on date")
    pages = spark.createDataFrame([(url(k),) for k in range(6)], "url string")
    links = spark.createDataFrame([(url(k), url(k + 1)) for k in range(9)] + [(url(2), url(0)), (url(2), "https://h.example.edu/about"), (url(1), url(7))], "url string, target string")
    store = Versions(spark, f"file://{tmp_path}/store")
    store.commit(0, replace={"seeds": seeds})
    whole, left = Versions.commit, [2]

    def lost(self, step, **tables):
        if not left[0]:
            raise RuntimeError("executor lost")
        left[0] -= 1
        return whole(self, step, **tables)

    monkeypatch.setattr(Versions, "commit", lost)
    with pytest.raises(RuntimeError, match="lost"):
        crawling.crawled_queue(store, pages, links, "1998-06-01", batch)
    monkeypatch.setattr(Versions, "commit", whole)
    done = crawling.crawled_queue(store, pages, links, "1998-06-01", batch)
    want = {(url(k), "crawled", 0) for k in range(6)} | {(url(6), "failed", 1), ("https://x.org/", "failed", 1), (url(7), "failed", 4)}
    assert {(r["url"], r["status"], r["error_count"]) for r in done.collect()} == want
