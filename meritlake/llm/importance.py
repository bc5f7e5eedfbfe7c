"""Resampling of documents towards a target's words: gains by hashed feature, noise by id, the highest scores drawn."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.llm.base import texts_of, written
from meritlake.llm.ordering import placed, row_at

#: What parts words (all ASCII but digits and lower-case letters, after A-Z are lower-cased), the noise's scale.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, HASHES = 1000, 1 << 32


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN_WORDS), lambda w: w != "")


def features(said: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words, each joined by one space."""

    def of_length(n: int) -> Column:
        starts = F.when(F.size(said) >= n, F.sequence(F.lit(1), F.size(said) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(said, k, n), " "))

    return F.flatten(F.array(said, *map(of_length, range(2, longest + 1)))) if longest > 1 else said


def hashed(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, buckets): the bucket of every feature of each document's whole text, repeats included."""
    said = texts_of(docs).select("doc_id", words(F.col("text")).alias("said"))
    found = F.transform(features(F.col("said"), longest), lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int"))
    return said.select("doc_id", F.size("said").cast("long").alias("n_words"), found.alias("buckets"))


def bucket_counts(rows: DataFrame) -> dict[int, int]:
    """How often each bucket occurs in hashed() rows; as many entries as there are buckets, at most."""
    return dict(rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect())


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """By bucket: floor(1000 ln) of the target's smoothed share over the corpus's."""
    s, t = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(SCALE * math.log(((target.get(b, 0) + 1) * s) / ((corpus.get(b, 0) + 1) * t))) for b in range(buckets)]


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, by the seed and the id's hash; a null id as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(HASHES)
    return F.floor(-float(SCALE) * F.log(-F.log(share)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is 1, 2, ... for those drawn, else null.

    Weights are sums over a document's array of buckets, by an array of gains that is as long as there are buckets. Of the N
    documents of min_words words or more, the floor(percent * N / 100) of the highest scores are drawn, ties to smaller
    doc_id (null ids last; rows that share score and id in any fixed order). The cut is found by a quantile sketch, exact
    counts and a sort of the bracket (ordering.row_at). Null and empty texts have no features and weight 0. Repeated rows
    count each; an empty target leaves gains to the corpus alone; an empty table gives an empty one; other columns are ignored.
    """
    rows = written(hashed(docs, longest, buckets), "buckets")
    gain = gains(bucket_counts(rows), bucket_counts(hashed(target.withColumn("doc_id", F.lit(0)), longest, buckets)), buckets)
    table = F.expr(f"array({', '.join(f'{g}L' for g in gain)})")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(table, b))
    summed = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    scored = summed.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.select("doc_id", "n_words", "n_features", "weight", "score", F.monotonically_increasing_id().alias("row")), "scores")
    able = scored.where(F.col("n_words") >= min_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    out = ["doc_id", "n_features", "weight", "score"]
    cut = row_at(able, "score", order, able.count() * percent // 100)
    if cut is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    sooner, own = F.coalesce(F.col("doc_id") < cut["doc_id"], F.lit(cut["doc_id"] is None) & F.col("doc_id").isNotNull()), F.col("doc_id").eqNullSafe(F.lit(cut["doc_id"]))
    drawn = (F.col("n_words") >= min_words) & ((F.col("score") > cut["score"]) | (F.col("score") == cut["score"]) & (sooner | own & (F.col("row") <= cut["row"])))
    ranked = placed(scored.where(drawn), order, "rank")
    return ranked.select(*out, "rank").unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
