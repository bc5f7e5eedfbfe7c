"""Connected components by alternating stars, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.llm.base import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Nodes without a link do not appear. Self links and nulls are dropped; repeated links count once. An
    empty table gives an empty one. Each round is a large-star and a small-star step: joins and
    partial aggregations only, so that a node with very many links is never gathered in one task. It ends when
    links are stars: every node has one link, to a node that has none to a smaller one.
    """
    pairs = (
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now = written(pairs, "links")
    while not _stars(now):
        ends = F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("v").alias("m"))))
        low = now.select(ends.alias("x")).groupBy("x.n").agg(F.min("x.m").alias("m"))  # the least around each node, itself included
        large = now.join(low.select(F.col("n").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        # every link now leads to a smaller node: the small star ties a node's smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = written(tied.select("x.u", "x.v").where("u <> v").distinct(), "links")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(links: DataFrame) -> bool:
    """Whether no node has two links to smaller ones, or one to a smaller and one to a larger one."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    each = ends.groupBy("x.n").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
    return each.where("up > 1 or (up = 1 and down = 1)").isEmpty()
