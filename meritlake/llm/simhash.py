"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.llm.base import by_batch, group_bounds, local_roots, texts_of, whole_groups, written
from meritlake.llm.graph import components

#: Differing bits of linked fingerprints, at most. They can touch three of eight bytes, so five bytes at least are shared.
MAX_BITS, MIN_SHARED = 3, 5
#: Byte triples such that any five of the eight byte positions hold one of them: all within each half.
TRIPLES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7)]
#: Fingerprints of one index list that are compared in one task; longer lists are split in blocks, and each pair of blocks is compared.
BLOCK = 2048
#: Links that a task keeps before it makes them into stars.
HELD_LINKS = 1 << 20


def fingerprint(text: str, size: int = 3) -> int:
    """64 bits: each is 1 if it is set in over half of the XXH64 (seed 42) of the text's word shingles.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of size words, repeats included, joined by
    spaces. Fewer words give one shingle, none give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(words[i : i + size]), 42) for i in range(n)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of every document; a null text counts as an empty one."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return by_batch(texts_of(docs), work, "doc_id long, fp long")


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs a, b share the guaranteed number of positional bytes and differ in max_bits at most."""
    x = a ^ b
    shared = np.zeros(x.shape, dtype=np.int8)
    for k in range(8):
        shared += (x >> np.uint64(8 * k)) & np.uint64(255) == 0
    return (shared >= MIN_SHARED) & (np.bitwise_count(x) <= max_bits)


def _linked(batches: Iterable[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links that hold each index list's components together, those of a task made into stars."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for table in whole_groups(batches, ["key", "i", "j"]):
        key, i, j, fp, own = (table.column(c).to_numpy() for c in ("key", "i", "j", "fp", "own"))
        bounds = group_bounds(key, i, j)
        sizes = np.diff(bounds)
        fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.uint64)
        out_a, out_b = [], []
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= 16, sizes)
        for k in range(1, min(16, len(fp))):  # the short lists, all at once
            at = np.flatnonzero((group[k:] == group[:-k]) & small[k:])
            at = at[_close(fp[at], fp[at + k], max_bits)]
            out_a.append(fp[at])
            out_b.append(fp[at + k])
        for g in np.flatnonzero(sizes > 16):
            part, side = fp[bounds[g] : bounds[g + 1]], own[bounds[g] : bounds[g + 1]]
            same = i[bounds[g]] == j[bounds[g]]
            left = np.flatnonzero(side == i[bounds[g]])
            right = left if same else np.flatnonzero(side != i[bounds[g]])
            ones, twos = [], []
            for s in range(0, len(left), 256):
                rows = left[s : s + 256]
                r, c = np.nonzero(_close(part[rows][:, None], part[right][None, :], max_bits))
                keep = rows[r] < right[c] if same else slice(None)
                ones.append(rows[r][keep])
                twos.append(right[c][keep])
            root = local_roots(len(part), np.concatenate(ones), np.concatenate(twos))
            at = np.flatnonzero(root != np.arange(len(part)))
            out_a.append(part[at])
            out_b.append(part[root[at]])
        held.append((np.concatenate(out_a or [fp[:0]]), np.concatenate(out_b or [fp[:0]])))
        if sum(len(x) for x, _ in held) > HELD_LINKS:
            yield contracted(held)
            held = []
    if held:
        yield contracted(held)


def contracted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Links as stars: each node of theirs to the least that they lead to."""
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
    root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct values of column fp that hold together what differs in max_bits or fewer.

    The index has a list for each byte triple and its value; two fingerprints that share five positional bytes meet in
    one list at least. Shared bytes are tallied per pair, pairs below the guaranteed number go, the rest are verified.
    A list gives a spanning forest of its links, not all of them.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the index guarantees up to {MAX_BITS} bits")
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    lists = [F.lit(n << 24).cast("long") + byte[x] * 65536 + byte[y] * 256 + byte[z] for n, (x, y, z) in enumerate(TRIPLES)]
    keyed = fps.select("fp").distinct().select("fp", F.explode(F.array(*lists)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block))
    own = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    cells = own.select("key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "own")
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lambda b: _linked(b, max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document: component_id is the smallest doc_id that links lead to.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other; a repeated row is a copy; a null
    doc_id keeps its row, and its component is the smallest id there is among its links, or null. An empty table
    gives an empty one.
    """
    fps = written(fingerprints(docs, size), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(fps, max_bits))
    classes = least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    classes = written(classes, "classes")
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = classes.join(ids, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")
