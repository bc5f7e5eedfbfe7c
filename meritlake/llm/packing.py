"""Best-fit packing of tokenised documents by linear grouping.

Lengths are whole numbers up to the capacity, so their counts are a table of bounded size; the plan is made on that
table. Large lengths are rounded up within groups of equal cardinality, configurations of the few rounded sizes
are optimised by column generation, actual lengths take the places of the rounded ones, and what is left, with the
small ones, goes where it fits best. Documents meet the plan by their rank among equal lengths, as Spark counts it.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritlake.llm.base import by_batch, texts_of, written
from meritlake.llm.tokens import pieces_for

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: Lengths up to a SMALL-th of the capacity are packed last, by best fit; the others are grouped into at most GROUPS sizes.
SMALL, GROUPS = 8, 80
#: Rounding up overstates how many sequences large lengths need; this share of the configurations' use leaves the rest to best fit.
SHARE = 0.5


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole capacities behind a first piece that takes the rest."""
    full, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * full


def tokenised(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """PIECES of every document: its ids and end_id, cut if longer than capacity; nth counts a task's pieces of a length."""

    def run(batches):
        known, part, seen = pieces_for(vocabulary), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            cut = [known.cut(t) for t in batch.column("text").to_pylist()]
            known.learn(cut)
            rows = []
            for doc, pieces in zip(batch.column("doc_id").to_pylist(), cut, strict=True):
                ids, start = known.ids(pieces) + end, 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), part, seen[n]))
                    seen[n] += 1
                    start += n
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return texts_of(docs).mapInArrow(run, PIECES)


def equal_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """The lengths, largest first, in groups that hold about equally many documents; a length is never divided."""
    total, lengths = sum(counts.values()), sorted(counts, reverse=True)
    out, held = [[]], 0
    for k, n in enumerate(lengths):
        out[-1].append(n)
        held += counts[n]
        if held >= total * len(out) / groups and k + 1 < len(lengths):
            out.append([])
    return [g for g in out if g]


def best_value(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity, and how often it holds each."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = sizes <= c
        gain = np.where(fits, worth + value[np.maximum(c - sizes, 0)], -1.0)
        k = int(gain.argmax())
        if gain[k] > value[c - 1] + 1e-12:
            value[c], took[c] = gain[k], k
        else:
            value[c] = value[c - 1]
    many, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c >= sizes.min():
        if took[c] < 0:
            c -= 1
            continue
        many[took[c]] += 1
        c -= int(sizes[took[c]])
    return float(value[capacity]), many


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Configurations of sizes and how often to use each (whole numbers): column generation, rounded down.

    Together they hold at most what is needed of each size; the caller places the rest.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(columns)
    use = inverse @ need
    for step in range(rounds):
        price = inverse.sum(axis=0)
        value, many = best_value(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-7:
            break
        rise = inverse @ many
        can = rise > 1e-9
        if not can.any():
            break
        ratio = np.where(can, use / np.where(can, rise, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = many
        pivot = inverse[out] / rise[out]
        inverse -= np.outer(rise, pivot)
        inverse[out] = pivot
        if step % 100 == 99:
            inverse = np.linalg.inv(columns)
        use = np.maximum(inverse @ need, 0)
    return [(columns[:, k].astype(np.int64), int(use[k] + 1e-7)) for k in range(m) if int(use[k] + 1e-7)]


class _Open:
    """Sequences that are filled alike: how many, the first one's number, what each still holds."""

    __slots__ = ("count", "first", "room")

    def __init__(self, count: int, first: int, room: int) -> None:
        self.count, self.first, self.room = count, first, room


def plan(counts: dict[int, int], capacity: int, small: int = SMALL, groups: int = GROUPS) -> pd.DataFrame:
    """Where documents go, by length and rank among equal lengths: (length, rank, upto, sequence, offset, each).

    Ranks from rank to upto (exclusive) go, each at a time, to sequence, sequence + 1, ..., the first of a sequence at
    offset and the others behind it.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows, open_, made = [], [], 0

    def place(n: int, count: int, bins: _Open, each: int = 1) -> None:
        rows.append((n, used[n], used[n] + count, bins.first, capacity - bins.room, each))
        used[n] += count
        left[n] -= count

    large = {n: c for n, c in left.items() if n * small > capacity}
    if large:
        members = equal_groups(large, groups)
        sizes = np.array([g[0] for g in members])  # rounded up to the group's largest
        need = np.array([sum(large[n] for n in g) for g in members], dtype=float)
        for many, times in ((m, int(t * SHARE)) for m, t in configurations(sizes, need, capacity)):
            slots = [k for k in range(len(sizes)) for _ in range(many[k])]
            slots = slots[:-1] if len(slots) > 1 else slots  # the least is left to best fit, which knows the room that rounding has left
            todo = [_Open(times, made, capacity)]
            made += times
            for k in slots:  # actual documents, the group's longest first
                after = []
                for bins in todo:
                    while bins.count:
                        n = next((x for x in members[k] if left[x]), None)
                        if n is None:
                            after.append(bins)
                            break
                        take = min(bins.count, left[n])
                        head = _Open(take, bins.first, bins.room)
                        place(n, take, head)
                        head.room -= n
                        after.append(head)
                        bins = _Open(bins.count - take, bins.first + take, bins.room)
                todo = after
            open_.extend(b for b in todo if b.count)
    by_room: dict[int, list[_Open]] = defaultdict(list)
    for bins in open_:
        by_room[bins.room].append(bins)
    rooms = np.zeros(capacity + 1, dtype=bool)
    rooms[[r for r in by_room if r]] = True
    for n in sorted(left, reverse=True):  # what configurations left over, then the small ones
        while left[n]:
            tight = int(rooms[n:].argmax()) + n
            if tight > capacity or not rooms[tight]:
                each = capacity // n
                count = -(-left[n] // each)
                by_room[capacity].append(_Open(count, made, capacity))
                rooms[capacity] = True
                made += count
                tight = capacity
            bins = by_room[tight].pop()
            each = tight // n
            full = min(bins.count, left[n] // each)
            if full:
                taken, rest = _Open(full, bins.first, bins.room), _Open(bins.count - full, bins.first + full, bins.room)
                place(n, full * each, taken, each)
                taken.room -= each * n
            else:
                each = left[n]
                taken, rest = _Open(1, bins.first, bins.room), _Open(bins.count - 1, bins.first + 1, bins.room)
                place(n, each, taken, each)
                taken.room -= each * n
            if rest.count:
                by_room[rest.room].append(rest)
            if taken.room:
                by_room[taken.room].append(taken)
                rooms[taken.room] = True
            rooms[tight] = bool(by_room[tight])
    return pd.DataFrame(rows, columns=["length", "rank", "upto", "sequence", "offset", "each"]).astype("int64")


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with rank: the place of each among those of its length, over all tasks."""
    tasks = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return pieces.join(tasks.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and end_id; only longer ones than capacity are cut, and the first piece takes the rest. A
    null or empty text is end_id alone; repeated rows are packed each; an empty table gives an empty one. The driver
    sees one count for each length, capacity at most, and each task a plan that these counts bound.
    """
    pieces = written(tokenised(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, capacity).sort_values(["length", "rank"])
    length, rank, upto, sequence, offset, each = (steps[c].to_numpy() for c in steps.columns)
    # a length's ranks follow those of the lengths below it, so that one search finds the step
    base = np.zeros(capacity + 2, dtype=np.int64)
    for n, c in counts.items():
        base[n + 1] = c
    base = np.cumsum(base)
    keys = base[length] + rank
    spread = docs.sparkSession.sparkContext.broadcast((keys, rank, sequence, offset, each, base))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, rank, sequence, offset, each, base = spread.value
        n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(keys, base[n] + r, side="right") - 1
        nth, k = np.divmod(r - rank[at], each[at])
        cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([*cols, pa.array(sequence[at] + nth), pa.array(offset[at] + k * n)], names=names)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return by_batch(ranked(pieces), work, out)
