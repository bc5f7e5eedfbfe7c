"""Quality rules: rule statistics of each text, judged by an isolation forest with a threshold from labelled rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.llm.base import by_batch, least_hashed, texts_of, written

#: Fixed values of the rules.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: The forest: rows it is fitted on at most (those with the least hash of doc_id), trees, rows of a tree.
FIT_ROWS, TREES, TREE_ROWS = 8192, 100, 256
#: A lost clean document weighs as much as so many missed ones when the threshold is set; a share for a share.
CLEAN_WEIGHT = 10.0
#: The verdict where no labelled row says more.
DEFAULT_THRESHOLD = 0.75

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def repeat_words(words: list[bytes]) -> int:
    """Words in 5-word windows that are found twice or more, the first included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    two = np.unique(w[:-1] * n + w[1:], return_inverse=True)[1]
    if two.max() + 1 == len(two):
        return 0
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    if four.max() + 1 == len(four):
        return 0
    _, five, many = np.unique(four[:-1] * n + w[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(many[five] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the forest's features: rates, so length does not count."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines, seen, dups, full = text.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(SPACES):
            full += 1
            dups += line in seen
            seen.add(line)
    repeats = repeat_words(words)
    some = max(n, 1)
    shouted = sum(map(str.isupper, text.split())) / some
    marks = (text.count("!") + text.count("?")) / some
    features = [symbols / some, dups / max(full, 1), repeats / some, chars / some, shouted, marks, len(set(words)) / some]
    return n, chars, symbols, dups, repeats, features


def rule_statistics(docs: DataFrame) -> DataFrame:
    """STATS of every document; a null text has no words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*map(statistics, batch.column("text").to_pylist()), strict=True))
        cols = [pa.array(c, pa.int64()) for c in rows[:5]] + [pa.array(rows[5], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"])

    return by_batch(texts_of(docs), work, STATS)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class Forest:
    """Random splits: a row that few of them set apart is odd."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.scale = max(expected_path(min(tree_rows, len(rows))), 1e-9)
        self.depth = max(1, math.ceil(math.log2(max(2, min(tree_rows, len(rows))))))
        self.trees = [self._tree(rows[rng.choice(len(rows), min(tree_rows, len(rows)), replace=False)], rng) for _ in range(trees)]

    def _tree(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def grow(part: np.ndarray, depth: int) -> int:
            k = len(feature)
            for x in (feature, cut, left, right, path):
                x.append(0)
            left[k] = right[k] = k
            can = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and depth < self.depth else []
            path[k] = depth + expected_path(len(part))
            if len(can):
                feature[k] = f = int(rng.choice(can))
                cut[k] = c = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                below = part[:, f] <= c
                left[k], right[k] = grow(part[below], depth + 1), grow(part[~below], depth + 1)
            return k

        grow(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Near 1: odd; 0.5 and less: ordinary."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                at = np.where(rows[every, feature[at]] <= cut[at], left[at], right[at])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.scale)


def best_threshold(bins: list[tuple[float, int, int]]) -> float:
    """The score from which rows go, for (score, clean rows, bad rows): caught share less CLEAN_WEIGHT times lost share is largest."""
    clean, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not clean or not bad:
        return DEFAULT_THRESHOLD
    best, found, lost, caught = 0.0, 1.01, 0, 0
    for score, c, b in sorted(bins, reverse=True):
        lost, caught = lost + c, caught + b
        gain = caught / bad - CLEAN_WEIGHT * lost / clean
        if gain > best:
            best, found = gain, score
    return found


def judged(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept) of every document.

    labels: (doc_id, quality); rows with a null in either are not used. The forest is fitted on fit_rows documents at
    most; its threshold is set on all labelled documents, by counts of scores in steps of a thousandth. Null and empty
    texts have no words and fail the base rules. Repeated rows are judged each; an empty table gives an empty one. With fewer
    than two documents of words enough there is nothing to compare, and the base rules alone decide.
    """
    stats = written(rule_statistics(docs), "statistics")
    sample = least_hashed(stats.where(F.col("n_words") >= MIN_WORDS), fit_rows, "doc_id", "n_words").select("features").collect()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    if len(sample) < 2:  # nothing to compare with
        return stats.drop("features").withColumns({"base_failed": failed, "anomaly": F.lit(0.5), "kept": ~failed})
    forest = stats.sparkSession.sparkContext.broadcast(Forest(np.array([r[0] for r in sample])))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
        i = batch.schema.get_field_index("features")
        return batch.set_column(i, "anomaly", pa.array(forest.value.score(rows)))

    scored = written(by_batch(stats, work, STATS.replace("features array<double>", "anomaly double")), "anomalies")
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    step = F.floor(F.col("anomaly") * 1000) / 1000
    bins = (
        scored.join(known, "doc_id").groupBy(step.alias("score"))
        .agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("clean"), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad")).collect()
    )
    threshold = best_threshold([tuple(r) for r in bins])
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (step < threshold))
