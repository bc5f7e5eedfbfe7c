"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

All labelled rows are examples. Rows of one vector are one class of the index, with the numbers of its labels; classes are
dealt to shards, distinct vectors of documents to chunks, and each chunk is looked up in each shard in a task of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlake.llm.base import by_batch, texts_of, written
from meritlake.sources.tables import few

#: Classes of examples in a shard and distinct vectors in a chunk, at most; vectors in a chunk, if there are few; terms that a task counts at once; steps of votes that are calibrated.
SHARD, CHUNK, SMALL_CHUNK, COUNTED, STEPS = 1 << 14, 1 << 13, 1 << 9, 200_000, 4096
#: Terms, at most: those that speak most for the label, with this log-likelihood ratio at least and so many toxic examples.
TERMS, LEAST_RATIO, LEAST_EXAMPLES = 1024, 20.0, 3
NEIGHBOURS, BLOCK, EVIDENCE = 15, 64, 3
#: Words whose terms a task keeps; a full table is emptied.
KEPT_WORDS = 400_000
_EDGE = ".,;:!?\"'()[]{}|*$%&#<>-_"


def terms_of(word: str) -> set[str]:
    """The terms of a lower-cased word: itself between marks, and all its runs of 4 and 5 characters."""
    w = f"^{word.strip(_EDGE)}$"
    if len(w) < 5:
        return {w} if len(w) > 2 else set()
    return {w} | {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)}


class _Chosen(dict):
    """Word to the numbers of its chosen terms, worked out when first asked for."""

    def __init__(self, chosen: dict[str, int]) -> None:
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found = tuple(k for t in terms_of(word) if (k := self.chosen.get(t)) is not None)
        return found


def train_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) from which may be learnt: crc32 of the id's text modulo 3 is not 1; nulls dropped, one row for an id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    return known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def choose_terms(examples: DataFrame, most: int = TERMS) -> list[str]:
    """The terms of (toxic, text) that speak most for toxic, by log-likelihood ratio."""

    def told(toxic: Counter, every: Counter) -> pa.RecordBatch:
        names = list(every)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([every[t] for t in names], pa.int64())], names=["term", "a", "n"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, every = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                terms = set().union(*map(terms_of, set(text.lower().split()))) if text else set()
                every.update(terms)
                if y:
                    toxic.update(terms)
                if len(every) > COUNTED:
                    yield told(toxic, every)
                    toxic, every = Counter(), Counter()
        if every:
            yield told(toxic, every)

    total, positive = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not positive or positive == total:
        return []
    tally = examples.select("text", F.col("toxic").cast("long")).mapInArrow(run, "term string, a long, n long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    p = positive / total
    cell = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    a, n = F.col("a"), F.col("n")
    ratio = 2 * (cell(a, n * p) + cell(n - a, n * (1 - p)) + cell(positive - a, (total - n) * p) + cell(total - positive - n + a, (total - n) * (1 - p)))
    best = tally.where((a >= LEAST_EXAMPLES) & (a / n > (1 + p) / 2)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    return [r["term"] for r in best.orderBy(F.desc("ratio"), "term").limit(most).collect()]


def term_counts(docs: DataFrame, chosen: list[str]) -> DataFrame:
    """(doc_id, term array<int>, times array<int>): how often each document's whole text holds the chosen terms."""
    sent = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(chosen)})
    kept: dict[int, _Chosen] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if 0 not in kept:
            kept[0] = _Chosen(sent.value)
        known = kept[0]
        terms, times = [], []
        for text in batch.column("text").to_pylist():
            hits = Counter(k for found in map(known.__getitem__, text.lower().split()) if found for k in found)
            order = sorted(hits)
            terms.append(order)
            times.append([hits[k] for k in order])
        cols = [pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "term", "times"])

    return by_batch(texts_of(docs), work, "doc_id long, term array<int>, times array<int>")


class BlockMaxIndex:
    """Examples in blocks, with the largest weight of each term in each block, so that hopeless blocks are never scored."""

    def __init__(self, ids: list[int], toxic: list[int], vectors: list[tuple[list[int], list[int]]], idf: np.ndarray, weight: tuple[float, float]) -> None:
        self.idf = idf
        dense = np.zeros((len(ids), len(idf)), dtype=np.float32)
        for row, (terms, times) in zip(dense, vectors, strict=True):
            row[terms] = (1 + np.log(times)) * idf[terms] if terms else 0
        norm = np.linalg.norm(dense, axis=1)
        dense[norm > 0] /= norm[norm > 0, None]
        order = np.lexsort((np.array(ids), np.where(norm > 0, dense.argmax(axis=1), -1)))  # alike ones share blocks
        self.empty = norm[order] == 0
        self.ids, self.toxic = np.array(ids)[order], np.array(toxic)[order].astype(float)
        self.weight = np.where(self.toxic > 0, weight[1], weight[0])
        self.blocks = [np.ascontiguousarray(dense[order[k : k + BLOCK]].T) for k in range(0, len(ids), BLOCK)]
        self.most = np.array([b.max(axis=1) for b in self.blocks], dtype=np.float32).T  # terms x blocks
        rows = self.weight[self.empty]
        self.prior = float((rows * self.toxic[self.empty]).sum() / rows.sum()) if rows.sum() else 0.0

    def nearest(self, terms: list[int], times: list[int], leave: int | None = None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest examples with a cosine above 0, without that of id leave; ties by row."""
        t = np.array(terms)
        q = ((1 + np.log(times)) * self.idf[t]).astype(np.float32)
        q /= np.linalg.norm(q)
        bound = q @ self.most[t]
        rows, found, least = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(rows) == k and bound[b] < least - 1e-6:
                break
            score = q @ self.blocks[b][t]
            at = np.flatnonzero(score > max(least - 1e-6, 0))
            rows, found = np.append(rows, at + b * BLOCK), np.append(found, score[at])
            keep = self.ids[rows] != leave if leave is not None else slice(None)
            rows, found = rows[keep], found[keep]
            best = np.lexsort((rows, -found))[:k]
            rows, found = rows[best], found[best]
            least = float(found[-1]) if len(rows) == k else 0.0
        return rows, found

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """The toxic share among the nearest, weighted by the square of the cosine and by how many rows an example stands for."""
        w = self.weight[rows] * cosines.astype(float) ** 2
        return float((w * self.toxic[rows]).sum() / w.sum()) if len(rows) else self.prior


def calibrate(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (vote, share of toxic): isotonic regression by pooling neighbours."""
    pools: list[list[float]] = []
    each, of = np.unique(votes, return_inverse=True)  # equal votes are one step, whatever their labels
    for v, y, w in zip(each.tolist(), np.bincount(of, weight * toxic).tolist(), np.bincount(of, weight).tolist(), strict=True):
        pools.append([v, y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] > pools[-1][1] * pools[-2][2]:
            v1, y1, w1 = pools.pop()
            pools[-1] = [v1, pools[-1][1] + y1, pools[-1][2] + w1]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def example_classes(examples: DataFrame) -> DataFrame:
    """(own, term, times, n_toxic, n_clean, lo, hi): the distinct vectors of examples (doc_id, term, times, toxic) that have terms, how many rows of each label they stand for, and two of these."""
    n = lambda y: F.count_if(F.col("toxic") == y)
    grouped = examples.where(F.size("term") > 0).groupBy("term", "times").agg(n(1).alias("n_toxic"), n(0).alias("n_clean"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return grouped.select(F.col("lo").alias("own"), "term", "times", "n_toxic", "n_clean", "lo", "hi")


_CLASS = ("own", "n_toxic", "n_clean", "lo", "hi")


def _near(batches: Iterable[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(q, far, ...): the nearest classes of each vector among those of its shard, which come first."""
    at, held, index = None, [], None
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "asks", "q", "term", "times", *_CLASS)), strict=True):
            if row[:2] != at:
                at, held, index = row[:2], [], None
            if not row[2]:
                held.append(row)
                continue
            if index is None:
                index = BlockMaxIndex(list(range(len(held))), [0] * len(held), [(r[4], r[5]) for r in held], idf, (1.0, 1.0))
            rows, found = index.nearest(row[4], row[5], k=NEIGHBOURS + 1)
            out += [(row[3], -float(c), *held[n][6:]) for n, c in zip(index.ids[rows].tolist(), found, strict=True)]
        if out:
            kinds = [pa.int64(), pa.float64(), *[pa.int64()] * len(_CLASS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["q", "far", *_CLASS])


def share_among(near: list[dict], own: int | None, less: str | None, prior: float) -> float:
    """The toxic share of the NEIGHBOURS nearest rows and of those as near as the last, weighted by the square of the cosine; of class own one row less of the kind less."""
    toxic = every = 0.0
    n = 0
    for x in near:
        a, b = x["n_toxic"], x["n_clean"]
        if less and x["own"] == own:
            a, b = a - (less == "n_toxic"), b - (less == "n_clean")
        w = x["far"] ** 2
        toxic, every, n = toxic + w * a, every + w * (a + b), n + a + b
        if n >= NEIGHBOURS:
            break
    return toxic / every if every else prior


def votes_of(vectors: DataFrame, classes: DataFrame, idf: np.ndarray, prior: float, shard: int = SHARD) -> DataFrame:
    """(term, times, votes, lo, hi, cosines) of distinct vectors: the votes of a row without a label, of one of the toxic examples and of one of the clean ones, each without itself; and the nearest classes."""
    spark = vectors.sparkSession
    asked = written(vectors.join(classes.select("term", "times", "own"), ["term", "times"], "left").withColumn("q", F.monotonically_increasing_id()), "vectors")
    n, m = asked.count(), classes.count()
    shards = max(1, -(-m // shard))
    chunks = max(1, -(-n // CHUNK), min(-(-n // SMALL_CHUNK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    deal = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    none = [F.lit(None).cast("long").alias(c) for c in _CLASS]
    there = classes.select(deal("own", shards).alias("shard"), every(chunks).alias("chunk"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("q"), "term", "times", *_CLASS)
    here = asked.select(every(shards).alias("shard"), deal("q", chunks).alias("chunk"), F.lit(1).alias("asks"), "q", "term", "times", *none)
    dealt = there.unionByName(here).repartition(shards * chunks, "shard", "chunk").sortWithinPartitions("shard", "chunk", "asks", "own", "q")
    found = dealt.mapInArrow(lambda batches: _near(batches, idf), "q long, far double, own long, n_toxic long, n_clean long, lo long, hi long")
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", *_CLASS))), 1, NEIGHBOURS + 1).alias("near"))
    each = asked.join(best, "q", "left").select("term", "times", "own", "near")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes, first = [], []
        for own, near in zip(batch.column("own").to_pylist(), batch.column("near").to_pylist(), strict=True):
            near = near or []
            votes.append([share_among(near, own, less, prior) for less in (None, "n_toxic", "n_clean")])
            first.append(near[: EVIDENCE + 1])
        some = [pa.array([[x[c] for x in f] for f in first], pa.list_(pa.int64())) for c in ("lo", "hi")]
        cols = [pa.array(votes, pa.list_(pa.float64())), *some, pa.array([[-x["far"] for x in f] for f in first], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([batch.column("term"), batch.column("times"), *cols], names=["term", "times", "votes", "lo", "hi", "cosines"])

    return written(by_batch(each, work, "term array<int>, times array<int>, votes array<double>, lo array<long>, hi array<long>, cosines array<double>"), "votes")


def scored(docs: DataFrame, labels: DataFrame | None = None, cut: float = 0.7, train: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, cosines) of every document.

    train: (doc_id, toxic) rows to learn from, if they are not train_rows(labels). Terms are chosen on all rows that may be
    learnt from, the index holds all of them, and all calibrate; terms' document counts come from all documents, and every
    whole text is scored. A score is the calibrated, distance-weighted vote of the nearest examples (never the document
    itself); evidence has ids of the nearest classes. Texts without a chosen term, null and empty ones included, get the
    share of toxic rows among such examples. Without labels of both classes every score is the toxic share of those there
    are, or 0. Repeated rows are scored each; an empty table gives an empty one. A null doc_id is not held out.
    """
    spark = docs.sparkSession
    train = written(train_rows(labels) if train is None else train, "train")
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = size.get(1, 0) / max(sum(size.values()), 1)
    chosen = choose_terms(texts_of(docs).join(few(train), "doc_id"))
    if not chosen:
        nothing = [F.array().cast("array<long>").alias("evidence"), F.array().cast("array<double>").alias("cosines")]
        return texts_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(base).alias("score"), F.lit(int(base >= cut)).alias("predicted"), *nothing)
    counts = written(term_counts(docs, chosen), "terms")
    # of documents that share an id one is the example
    example = counts.join(train, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("term", "times")).alias("v")).select("doc_id", "v.term", "v.times", "toxic")
    example = written(example, "examples")
    n_docs = counts.count()
    df = dict.fromkeys(range(len(chosen)), 0) | {r["k"]: r["n"] for r in counts.select(F.explode("term").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = np.log((1 + n_docs) / (1 + np.array([df[k] for k in range(len(chosen))], dtype=float))) + 1
    bare = example.where(F.size("term") == 0).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    prior = bare["toxic"] / bare["n"] if bare["n"] else 0.0
    has = F.size("term") > 0
    votes = votes_of(counts.where(has).select("term", "times").distinct(), written(example_classes(example), "classes"), idf, prior)
    own_vote = F.get("votes", F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).otherwise(0))
    known = counts.where(has).join(example, ["doc_id", "term", "times"], "left").join(votes, ["term", "times"]).select("doc_id", "toxic", own_vote.alias("vote"), "lo", "hi", "cosines")
    empty = lambda t: F.array().cast(t)
    rest = counts.where(~has).join(example.where(~has).select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "toxic", F.lit(prior).alias("vote"), empty("array<long>").alias("lo"), empty("array<long>").alias("hi"), empty("array<double>").alias("cosines"))
    voted = written(known.unionByName(rest), "voted")
    pools = voted.where("toxic is not null").groupBy(F.round(F.col("vote") * STEPS).alias("step")).agg(F.avg("vote").alias("vote"), F.avg("toxic").alias("share"), F.count(F.lit(1)).alias("n")).collect()
    steps = calibrate(*(np.array([float(r[c]) for r in pools]) for c in ("vote", "share", "n")))
    sent = spark.sparkContext.broadcast(steps)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, share = sent.value
        evidence, cosines = [], []
        for doc, *near in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lo", "hi", "cosines")), strict=True):
            other = [(a if a != doc else b, c) for a, b, c in zip(*near, strict=True) if a != doc or b != doc][:EVIDENCE]
            evidence.append([a for a, _ in other])
            cosines.append([c for _, c in other])
        score = np.clip(np.interp(np.asarray(batch.column("vote")), at, share), 0.0, 1.0)
        cols = [pa.array(score), pa.array(evidence, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "score", "evidence", "cosines"])

    out = by_batch(voted, work, "doc_id long, score double, evidence array<long>, cosines array<double>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"), "evidence", "cosines")
