"""All labelled rows are examples: none is left out of the index, of the terms or of the calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from meritlake.llm import toxicity


def test_more_examples_than_a_sample_would_hold(spark, monkeypatch):
    n = 2100  # the sample of rounds before held 1500 toxic rows and 3000 clean ones
    toxic = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words zq"), F.col("id") % 9, F.lit("qz")).alias("text"))
    clean = spark.range(n, 4 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "zq1qz other").otherwise("plain words only").alias("text"))
    train = toxic.select("doc_id", F.lit(1).alias("toxic")).unionByName(clean.select("doc_id", F.lit(0).alias("toxic")))
    classes, seen = toxicity.example_classes, []
    monkeypatch.setattr(toxicity, "example_classes", lambda rows: seen.append(rows) or classes(rows))
    got = toxicity.scored(toxic.unionByName(clean).unionByName(toxic.where("doc_id < 9").withColumn("doc_id", -F.col("doc_id") - 1)), train=train)
    assert tuple(classes(seen[0]).agg(F.sum("n_toxic"), F.sum("n_clean")).first()) == (n, 63) and seen[0].count() == 4 * n
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(by) == 4 * n + 9 and all(by[k]["predicted"] == 1 and by[k]["evidence"] for k in range(-9, 0))
    assert {by[k]["score"] for k in range(n + 1, n + 90)} == {0.0} and all(k not in r["evidence"] for k, r in by.items())


def test_shards_give_the_votes_of_a_plain_search(spark):
    rng = np.random.default_rng(3)
    idf, made = rng.uniform(1, 4, 30), {}
    for k in range(500):
        t = sorted(rng.choice(30, rng.integers(1, 5), replace=False).tolist())
        made[k] = (t, rng.integers(1, 3, len(t)).tolist(), int(rng.integers(0, 2)))
    examples = spark.createDataFrame([(k, *v) for k, v in made.items()], "doc_id long, term array<int>, times array<int>, toxic int")
    classes = toxicity.example_classes(examples)
    votes = toxicity.votes_of(examples.select("term", "times").distinct(), classes, idf, 0.25, shard=64).collect()
    got = {(tuple(r["term"]), tuple(r["times"])): r["votes"] for r in votes}

    def dense(t, n):
        x = np.zeros(30)
        x[t] = (1 + np.log(n)) * idf[t]
        return x / np.linalg.norm(x)

    every = {k: dense(t, n) for k, (t, n, _) in made.items()}
    for k in range(0, 500, 25):
        t, n, y = made[k]
        cos = {j: float(every[k] @ v) for j, v in every.items() if j != k}
        vector = {}  # rows of one vector come together, in order of the cosine, then of their least id
        for j, c in cos.items():
            if c > 1e-9:
                vector.setdefault((tuple(made[j][0]), tuple(made[j][1])), []).append(j)
        least = {v: min([*js, *([k] if v == (tuple(t), tuple(n)) else [])]) for v, js in vector.items()}
        taken, a, b = 0, 0.0, 0.0
        for v in sorted(vector, key=lambda v: (-round(cos[vector[v][0]], 6), least[v])):
            w = cos[vector[v][0]] ** 2
            a, b, taken = a + w * sum(made[j][2] for j in vector[v]), b + w * len(vector[v]), taken + len(vector[v])
            if taken >= toxicity.NEIGHBOURS:
                break
        assert abs(got[tuple(t), tuple(n)][1 if y else 2] - a / b) < 0.02
