"""Exact repeats of long byte strings, by a prefix-free parse of the corpus.

A rolling hash picks triggers: the k-gram of least hash among those of a window. Each window has one trigger, and its
place in the window follows from the window's bytes alone, so equal windows have equal triggers. The windows of one
trigger, cut in two at a place that fixes a long common core, make a phrase; each window lies whole in one phrase, and
the parse of a text is its phrases. Phrases that occur alike make the dictionary. In corpus order a window stands beside
its equals: those of its phrase's other places in the parse, and those that the dictionary's suffix array puts beside it.
Windows of phrases with different cores differ, so the suffix array is built core by core, exact on bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlake.llm.base import by_batch, small_batches, whole_groups, written

#: Bytes of a trigger; bytes parsed at once; phrases of one core that one task orders, beyond which Spark counts window by window.
GRAM, SLICE, CORE_PHRASES = 32, 1 << 20, 4096
_NO_ID = -(2**63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width bytes from each place on (what reaches beyond the end has no meaning), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    out, done, at = None, 0, 1

    def join(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
        c = a * _ODD[1]
        c[: max(len(a) - gap, 0)] += b[gap:] * _ODD[2]
        c ^= c >> np.uint64(31)
        c *= _ODD[3]
        c ^= c >> np.uint64(29)
        return c

    while True:
        if width & at:
            out = h.copy() if out is None else join(out, h, done)
            done += at
        if done == width:
            return out
        h = join(h, h, at)
        at *= 2


def triggers(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of length bytes, where its trigger begins: the least hash among its grams, the leftmost of equals."""
    n = len(data) - length + 1
    wide = length - gram + 1
    bits = np.uint64(max(len(data), 2).bit_length())
    low = ((rolling(data, gram) >> bits) << bits) | np.arange(len(data), dtype=np.uint64)
    done = 1
    while done * 2 <= wide:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < wide:
        gap = wide - done
        low = np.minimum(low[:-gap], low[gap:])
    return (low[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def phrases(text: bytes, length: int, gram: int, step: int = SLICE) -> list[tuple[int, int, int, int, int]]:
    """(core hash, phrase hash, first window, last window, place of the trigger) of a text's phrases."""
    if len(text) < length:
        return []
    half, out, view = (length - gram) // 2, [], memoryview(text)
    digest = xxhash.xxh3_64_intdigest
    for s in range(0, len(text) - length + 1, step):
        data = np.frombuffer(text, dtype=np.uint8, count=min(step + length - 1, len(text) - s), offset=s)
        at = triggers(data, length, gram)
        offset = at - np.arange(len(at))
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff((offset >= half).astype(np.int8), prepend=-1) != 0))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
            p = int(at[a]) + s
            left = p - (a + s) >= half
            core = view[p - half : p + gram] if left else view[p : p + length - half]
            out.append((digest(core, left) - 2**63, digest(view[a + s : b + s + length - 1], p - a - s) - 2**63, a + s, b + s - 1, p))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def counted(found: list[tuple[int, int, int, int, int]], length: int) -> list[tuple]:
    """(core, phrase, first, last, times, own): a text's phrases, each once, so that text that repeats itself makes few rows.

    own has the spans that all places of a phrase cover, if there are several; first and last are those of one.
    """
    places: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for core, phrase, first, last, _ in found:
        places.setdefault((core, phrase), []).append((first, last))
    out = []
    for (core, phrase), at in places.items():
        own = [{"s": s, "e": e} for s, e in merged([(a, b + length) for a, b in at])] if len(at) > 1 else None
        out.append((core, phrase, *at[0], len(at), own))
    return out


def _parse(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The parse of all texts: (core, phrase, d, k, first, last, times, own)."""
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list] = [[] for _ in range(8)]
        for d, k, text in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "text")), strict=True):
            for core, phrase, first, last, times, own in counted(phrases(text.encode("utf-8", "surrogatepass"), length, gram), length):
                for col, x in zip(cols, (core, phrase, d, k, first, last, times, own), strict=True):
                    col.append(x)
        types = [pa.int64()] * 4 + [pa.int32()] * 3 + [spans]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["core", "phrase", "d", "k", "first", "last", "times", "own"])

    return by_batch(docs, work, "core long, phrase long, d long, k long, first int, last int, times int, own array<struct<s:int,e:int>>")


def _contexts(asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the phrases asked for, from their texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list] = [[] for _ in range(7)]
        for d, k, text, want in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "text", "want")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for w in want:
                for col, x in zip(cols, (w["core"], d, k, w["first"], w["last"], w["n"], raw[w["first"] : w["last"] + length]), strict=True):
                    col.append(x)
        types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["core", "d", "k", "first", "last", "n", "bytes"])

    return by_batch(asked, work, "core long, d long, k long, first int, last int, n long, bytes binary")


def suffix_ranks(data: np.ndarray, core: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix of data by its first length bytes, within its core; equal ranks are equal bytes.

    The dictionary's suffix array by prefix doubling: ranks of 2 w bytes come from pairs of ranks of w. Matches are of
    length bytes, so the order is not taken further. core: a number for each place; what reaches beyond a phrase's end
    has no meaning.
    """
    rank, done = data.astype(np.int64), 1
    out, had = None, 0

    def paired(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
        behind = np.zeros(len(a), dtype=np.int64)
        behind[: max(len(a) - gap, 0)] = b[gap:] + 1
        return np.unique(a * (int(b.max(initial=0)) + 2) + behind, return_inverse=True)[1]

    while True:
        if length & done:
            out, had = (rank, done) if out is None else (paired(out, rank, had), had + done)
        if had == length:
            return np.unique(core * (int(out.max(initial=0)) + 1) + out, return_inverse=True)[1]
        rank, done = paired(rank, rank, done), 2 * done


def repeated_runs(rank: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places, among all windows in order of rows, of runs within a row whose rank is found again."""
    at = np.flatnonzero(np.bincount(rank)[rank] > 1) if len(rank) else rank
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0))
    return at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]


def _ordered(batches, length: int):
    """Spans of windows that are found again within their core's phrases: (d, k, s, e)."""
    for table in whole_groups(batches, ["core"]):
        core, d, k, first, last = (table.column(c).to_numpy() for c in ("core", "d", "k", "first", "last"))
        column = table.column("bytes").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
        windows = (last - first + 1).astype(np.int64)
        sizes = windows + length - 1
        base = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(core)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        number = np.cumsum(np.append(0, core[1:] != core[:-1]))
        a, b = repeated_runs(suffix_ranks(data, np.repeat(number, sizes), length)[base[row] + nth], row)
        if len(a):
            r = row[a]
            s, e = first[r] + nth[a], first[r] + nth[b] + length
            yield pa.RecordBatch.from_arrays([pa.array(d[r]), pa.array(k[r]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["d", "k", "s", "e"])


def repeated_spans(keyed: DataFrame, length: int, gram: int = GRAM, most: int = CORE_PHRASES) -> DataFrame:
    """(d, k, s, e): spans of each text (d, k, text) that repeated windows of length bytes cover."""
    parsed = written(_parse(keyed, length, gram), "parse")
    # the parse's order: a window lies in one phrase, so suffixes of the parse meet by their first phrase alone
    phrase = parsed.groupBy("core", "phrase").agg(F.sum("times").alias("copies"), F.min(F.struct("d", "k", "first", "last")).alias("at"))
    phrase = written(phrase, "phrases")
    cores = phrase.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = phrase.where("copies > 1").select("core", "phrase")
    repeated = parsed.join(again, ["core", "phrase"])
    one = F.array(F.struct(F.col("first").alias("s"), (F.col("last") + length).cast("int").alias("e")))
    whole = repeated.select("d", "k", F.explode(F.coalesce("own", one)).alias("x")).select("d", "k", "x.s", "x.e")
    heads = phrase.join(cores, "core").select(F.col("at.d").alias("d"), F.col("at.k").alias("k"), "core", F.col("at.first").alias("first"), F.col("at.last").alias("last"), "n")
    want = heads.groupBy("d", "k").agg(F.collect_list(F.struct("core", "first", "last", "n")).alias("want"))
    found = _contexts(keyed.join(want, ["d", "k"]), length)
    found = written(found, "dictionary")
    few = found.where(F.col("n") <= most).repartition("core").sortWithinPartitions("core")
    spans = few.mapInArrow(lambda b: _ordered(b, length), "d long, k long, s int, e int")
    each = found.where(F.col("n") > most).select("d", "k", "first", "bytes", F.explode(F.sequence(F.lit(0), F.col("last") - F.col("first"))).alias("nth"))
    each = each.select("d", "k", (F.col("first") + F.col("nth")).alias("s"), F.unhex(F.md5(F.substring("bytes", F.col("nth") + 1, F.lit(length)))).alias("window"))
    again = each.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    many = each.join(again, "window").select("d", "k", "s", (F.col("s") + length).alias("e"))
    return whole.unionByName(spans).unionByName(many)


def without_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every document.

    Each byte goes that a string of length bytes covers which also begins elsewhere, in the same text or another; matches
    never cross texts. kept is what remains. Null and empty texts have no bytes; repeated rows are copies of each other;
    an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))
    spans = repeated_spans(keyed.select("d", "k", "text"), length, gram)
    per_text = spans.distinct().groupBy("d", "k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            gone = merged([(x["s"], x["e"]) for x in spans or ()])
            at, parts = 0, []
            for s, e in gone:
                parts.append(raw[at:s])
                at = e
            kept = b"".join([*parts, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
        types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return by_batch(keyed.join(per_text, ["d", "k"], "left").select("doc_id", "text", "spans"), work, out)
