"""Periodic runs of words, found once for each rule of a grammar of the text."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meritlake.llm.base import by_batch, texts_of

#: (rule, period) pairs that are tested at once.
AT_ONCE = 1 << 19
_PRIME = np.uint64((1 << 31) - 1)

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _recurring(doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each pair, how often each numbered pair occurs) of pairs of symbols, document by document."""
    m = np.int64(max(int(left.max()), int(right.max())) + 1)
    _, number, times = np.unique((doc * m + left) * m + right, return_inverse=True, return_counts=True)
    return number, times


def stretches(words: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of least words or more all of whose word pairs recur in their document.

    A run of three periods lies in one: each of its pairs is found again a period away.
    """
    if len(words) < least:
        return []
    same = doc[1:] == doc[:-1]
    again = np.zeros(len(words) + 1, dtype=bool)
    if same.any():
        number, times = _recurring(doc[:-1][same], words[:-1][same], words[1:][same])
        again[1:-1][same] = times[number] > 1
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b + 1 - a >= least]


class Grammar:
    """Pairs replaced by rules until none recurs, over all stretches of a batch; then neighbours joined until a stretch is one symbol.

    A round takes the pairs that are more frequent than those they overlap with (ties by a hash), so that many are replaced at
    once. left_size, size, first: of each rule, the length of its left part, its length, and where it stands first.
    uses: (rule, place) of every derivation; there are fewer than words.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, part: np.ndarray) -> None:
        self.next = int(words.max()) + 1
        self.left_size, self.size, self.first, self.uses = [], [], [], []
        self.base = self.next
        sym, at, size = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), dtype=np.int64)
        while len(sym) > 1:
            near = np.flatnonzero(part[1:] == part[:-1])
            if not len(near):
                return
            number, times = _recurring(doc[near], sym[near], sym[near + 1])
            if times.max() < 2:
                break
            rank = np.empty(len(times), dtype=np.int64)
            rank[np.lexsort((np.arange(len(times)) * 2654435761 % 4294967291, times))] = np.arange(1, len(times) + 1)
            weight = np.zeros(len(sym) + 1, dtype=np.int64)
            weight[near + 1] = np.where(times[number] > 1, rank[number], 0)
            of = np.full(len(sym), -1, dtype=np.int64)
            of[near] = number
            sym, at, size, doc, part = self._replaced(self._winners(weight), of, sym, at, size, doc, part)
        while True:
            begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            place = np.arange(len(sym)) - np.repeat(begins, np.diff(np.append(begins, len(sym))))
            chosen = np.flatnonzero((place[:-1] % 2 == 0) & (part[1:] == part[:-1]))
            if not len(chosen):
                return
            of = np.arange(len(sym))
            sym, at, size, doc, part = self._replaced(chosen, of, sym, at, size, doc, part)

    @staticmethod
    def _winners(weight: np.ndarray) -> np.ndarray:
        """Places of pairs that outweigh both neighbours; of equal ones in a row (one pair, overlapping) every other. weight[k + 1] is of the pair at k."""
        edges = np.flatnonzero(np.append(True, weight[1:] != weight[:-1]))
        ends = np.append(edges[1:], len(weight))
        w = weight[edges]
        top = (w > 0) & (w > np.append(0, w[:-1])) & (w > np.append(w[1:], 0))
        begins, many = edges[top] - 1, (ends[top] - edges[top] + 1) // 2
        return np.repeat(begins, many) + 2 * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))

    def _replaced(self, chosen: np.ndarray, of: np.ndarray, sym: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
        """The symbols after the pairs at chosen became rules."""
        _, first, rule = np.unique(of[chosen], return_index=True, return_inverse=True)
        self.left_size.append(size[chosen][first])
        self.size.append(self.left_size[-1] + size[chosen + 1][first])
        self.first.append(at[chosen][first])
        self.uses.append((self.next - self.base + rule, at[chosen]))
        sym, size = sym.copy(), size.copy()
        sym[chosen] = self.next + rule
        size[chosen] += size[chosen + 1]
        self.next += len(first)
        return [np.delete(x, chosen + 1) for x in (sym, at, size, doc, part)]

    def rules(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left_size, size, first) of all rules."""
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (self.left_size, self.size, self.first))


class Extensions:
    """How far two places agree, by hashes of prefixes; equal stretches always count as equal, so nothing is missed."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        x = int(rng.integers(1 << 20, int(_PRIME)))
        self.power = np.ones(1, dtype=np.uint64)
        while len(self.power) <= len(words):
            step = np.uint64(pow(x, len(self.power), int(_PRIME)))
            self.power = np.concatenate([self.power, self.power * step % _PRIME])
        letters = rng.integers(1, int(_PRIME), int(words.max()) + 1).astype(np.uint64)[words]
        self.sums = np.append(np.uint64(0), np.cumsum(letters * self.power[: len(words)] % _PRIME) % _PRIME)

    def same(self, a: np.ndarray, apart: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words at a are those at a + apart."""
        one = (self.sums[a + n] + _PRIME - self.sums[a]) % _PRIME * self.power[apart] % _PRIME
        return one == (self.sums[a + apart + n] + _PRIME - self.sums[a + apart]) % _PRIME

    def length(self, a: np.ndarray, apart: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest n, most at most, for which the n words from a on (or before a) are those at a distance of apart."""
        low, high = np.zeros(len(a), dtype=np.int64), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(a - mid if back else a, apart, mid)
            low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
        return low


def _crossing(ext: Extensions, first: np.ndarray, left_size: np.ndarray, size: np.ndarray, least: int, periods: int) -> np.ndarray:
    """Rows (rule, start, end, period), places from the rule's start on, of the runs that cross the rules' boundaries, each once."""
    reach = np.where(size >= least, size // periods, 0)
    ends, found, rule = np.cumsum(reach), [], 0
    while rule < len(reach):
        last = max(rule + 1, int(np.searchsorted(ends, (ends[rule - 1] if rule else 0) + AT_ONCE, side="right")))
        many = reach[rule:last]
        of = np.repeat(np.arange(rule, last), many)
        every = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + 1
        for k in range(0, len(of), AT_ONCE):
            r, q = of[k : k + AT_ONCE], every[k : k + AT_ONCE]
            a, b, e = first[r], first[r] + left_size[r], first[r] + size[r]
            need = np.maximum(least, periods * q) - q
            half = (need + 1) // 2
            for c in (b, b - q):  # a run across the boundary repeats at one of these
                fits = (c >= a) & (c + q <= e)
                ahead, back = fits & (c + q + half <= e), fits & (c - half >= a)
                ok = np.zeros(len(r), dtype=bool)
                ok[ahead] = ext.same(c[ahead], q[ahead], half[ahead])
                back &= ~ok
                ok[back] = ext.same(c[back] - half[back], q[back], half[back])
                if ok.any():
                    c1, q1, a1, e1, need1 = c[ok], q[ok], a[ok], e[ok], need[ok]
                    ahead_n, back_n = ext.length(c1, q1, e1 - c1 - q1, False), ext.length(c1, q1, c1 - a1, True)
                    long = ahead_n + back_n >= need1
                    found.append(np.stack([r[ok], c1 - back_n - a1, c1 + ahead_n + q1 - a1, q1], axis=1)[long])
        rule = last
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows


def maximal_runs(words: np.ndarray, doc: np.ndarray, least: int = 24, periods: int = 3) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs within documents, by start and period; smallest periods, places in words."""
    cut = stretches(words, doc, least)
    if not cut:
        return np.zeros((0, 3), dtype=np.int64)
    at = np.concatenate([np.arange(a, b) for a, b in cut])
    part = np.repeat(np.arange(len(cut)), [b - a for a, b in cut])
    x = np.unique(words[at], return_inverse=True)[1]
    grammar = Grammar(x, doc[at], part)
    left_size, size, first = grammar.rules()
    used, place = (np.concatenate(c) for c in zip(*grammar.uses, strict=True))
    order = np.argsort(used, kind="stable")
    place, begins = place[order], np.searchsorted(used[order], np.arange(len(size) + 1))
    for seed in count():
        rows = _crossing(Extensions(x, seed), first, left_size, size, least, periods)
        many = begins[rows[:, 0] + 1] - begins[rows[:, 0]]
        each = np.repeat(np.arange(len(rows)), many)
        derived = at[place[np.repeat(begins[rows[:, 0]] - np.cumsum(many) + many, many) + np.arange(many.sum())]]
        runs = np.stack([derived + rows[each, 1], derived + rows[each, 2], rows[each, 3]], axis=1)
        s, e, q = runs.T
        # what goes on beyond its rule is part of a longer run, which crosses another rule's boundary
        before, after = np.maximum(s - 1, 0), np.minimum(e, len(words) - 1)
        more = (s > 0) & (doc[before] == doc[s]) & (words[before] == words[before + q])
        more |= (e < len(words)) & (doc[after] == doc[s]) & (words[after] == words[after - q])
        runs = runs[~more]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        if len(runs):
            runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))]
        if all(np.array_equal(words[s : e - q], words[s + q : e]) for s, e, q in runs):  # else two stretches shared a hash: another one
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batch(batch: pa.RecordBatch, least: int, periods: int) -> pa.RecordBatch:
    said = [t.encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, said), dtype=np.int64, count=len(said))
    begins = np.cumsum(sizes) - sizes
    words = np.fromiter((number[w] for ws in said for w in ws), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(said)), sizes)
    runs = maximal_runs(words, doc, least, periods)
    kept = np.ones(len(words), dtype=bool)
    for s, e, q in runs:
        kept[s + q : e] = False
    of = doc[runs[:, 0]] if len(runs) else np.zeros(0, dtype=np.int64)
    left = [b" ".join(ws) if not (a := np.searchsorted(of, k, side="right")) or of[a - 1] != k else b" ".join([w for w, stays in zip(ws, kept[b : b + len(ws)].tolist(), strict=True) if stays]) for k, (ws, b) in enumerate(zip(said, begins, strict=True))]
    values = [runs[:, 0] - begins[of], runs[:, 1] - runs[:, 0], runs[:, 2]]
    each = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], names=["start", "length", "period"])
    bounds = np.searchsorted(of, np.arange(len(said) + 1))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), lists, pa.array([x.decode("utf-8", "surrogatepass") for x in left], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 24, periods: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    runs: the maximal runs of least words or more and of so many periods or more, each with its smallest period, by
    start and period; places are numbers of words. collapsed: the words joined by one space, without those that a run holds
    after its first period. Words are parted by ASCII white space and compared as they are. Documents do not depend on
    each other: null ids and repeated rows get a row each, other columns are ignored, null and empty texts have no words
    and no runs, and an empty table gives an empty one.
    """
    return by_batch(texts_of(docs), lambda batch: _batch(batch, least, periods), RUNS)
