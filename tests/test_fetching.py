"""The bounded source, and terms found by automata."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from meritlake.functions import labels
from meritlake.sources import fetching

RESPONSES = "url string, code int, html binary"


def test_each_address_has_a_row(spark):
    rows = [("http://a", 200, b"<p>a"), ("http://b", 404, b"x"), ("http://c", None, None), ("http://d", 200, b"\xff\xfe"), ("http://e", 200, b"  "), ("http://f", 500, b"x"), ("http://f", 200, b"<p>f"), ("http://other", 200, b"x"), (None, 200, b"x")]
    wanted = spark.createDataFrame([(f"http://{c}", 1) for c in "abcdefgaa"] + [(" ", 2), (None, 3)], "url string, html int")
    got = {r["url"]: (r["html"], r["error"]) for r in fetching.fetched(wanted, spark.createDataFrame(rows, RESPONSES), concurrency=3, bucket_rows=2).collect()}
    assert got == {
        "http://a": ("<p>a", None), "http://b": (None, "http 404"), "http://c": (None, "unreachable"), "http://d": (None, "undecodable"), "http://e": (None, "empty"), "http://f": ("<p>f", None), "http://g": (None, "unreachable"), " ": (None, "blank"), "": (None, "blank"),
    }


def test_readers_are_bounded(spark):
    wanted = spark.range(500).select(F.concat(F.lit("http://"), "id").alias("url"))
    responses = wanted.where("url not like '%7'").select("url", F.lit(200).alias("code"), F.encode("url", "UTF-8").alias("html"))
    got = fetching.fetched(wanted, responses, concurrency=3, bucket_rows=20)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 500
    assert got.where("error = 'unreachable' and url like '%7'").count() == 50 and got.where("html = url").count() == 450
    assert len(fetching.BoundedReader("p", 25, 4).partitions()) == 4
    assert sorted(b for p in fetching.BoundedReader("p", 25, 4).partitions() for b in p.buckets) == list(range(25))
    assert fetching.fetched(wanted.where("false"), responses).count() == 0


def test_terms_as_each_for_itself(spark):
    rng = random.Random(3)
    terms = ["a", "ab", "bab", "a b", "st. c", "é", "ab", "c-a", "b'a", "𝒳y"]
    texts = ["".join(rng.choice(["a", "b", "c", "A", " ", "-", "'", ".", "É", "st. c", "𝒳", "y"]) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", "ab", "a b" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", labels.terms_in(F.col("t"), terms).alias("any"), labels.words_in(F.col("t"), terms).alias("whole")).collect()
    edge = r"[a-z'\-]"
    for r in rows:
        low = (r["t"] or "").lower()
        assert r["any"] == [n for n, t in enumerate(terms) if t in low]
        assert r["whole"] == [n for n, t in enumerate(terms) if re.search(f"(?<!{edge}){re.escape(t)}(?!{edge})", low)]
