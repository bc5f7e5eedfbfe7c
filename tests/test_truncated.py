"""The first characters of a text, also of long ones and of characters of several bytes; texts of few rows are dealt."""

from __future__ import annotations

from pyspark.sql import functions as F

from meritlake.functions import display
from meritlake.plans import queries_more


def test_first_characters_whatever_their_bytes(spark):
    texts = ["", "abc", "abcd", "abcde", "é" * 3, "é" * 9, "aé漢😀" * 4, "😀" * 9, "abcé", "abcdé", "abcd" * 50 + "é", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    for n in (1, 3, 4, 5, 12):
        assert [r[0] for r in rows.select(display.truncated(F.col("x"), n)).collect()] == [None if t is None else t[:n] for t in texts]


def test_texts_of_parts_are_dealt_to_tasks(spark):
    assert queries_more.contract_rules(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
