"""Token counts of a text's sections: each text is encoded once, whole, and its tokens are allotted to sections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meritlake.llm.base import by_batch, texts_of
from meritlake.llm.tokens import pieces_for

SCHEMA = "doc_id long, section int, section_start long, section_end long, n_tokens long, n_crossing long"


def line_starts(text: str) -> np.ndarray:
    """Where the text's lines begin, in code points; a line holds its newline."""
    widths = np.fromiter(map(len, text.splitlines(keepends=True) if "\r" not in text and text.isascii() and not _ODD_BREAKS.intersection(text) else _lines(text)), dtype=np.int64)
    return np.append(0, np.cumsum(widths)[:-1]) if len(widths) else np.zeros(1, dtype=np.int64)


_ODD_BREAKS = frozenset("\x0b\x0c\x1c\x1d\x1e")


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def allot(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that reach beyond it, by an interval join of places and starts.

    The rule: a token belongs to the section that holds its first character.
    """
    n = len(starts)
    own = np.searchsorted(starts, places[:, 0], side="right") - 1
    last = np.searchsorted(starts, np.maximum(places[:, 1] - 1, places[:, 0]), side="right") - 1
    return np.bincount(own, minlength=n), np.bincount(own[last > own], minlength=n)


def section_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each line of each document: its place (code points, end exclusive), tokens, and tokens that cross its end.

    A document is encoded whole; the tokens of its lines add up to the document's. Null and empty texts have one
    empty section without tokens. A repeated row gives its rows again; an empty table gives none.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = pieces_for(vocabulary, spans=True)
        texts = batch.column("text").to_pylist()
        cut = [known.cut(t) for t in texts]
        known.learn(cut)
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, (text, pieces) in enumerate(zip(texts, cut, strict=True)):
            starts = line_starts(text)
            tokens, crossing = allot(known.places(pieces), starts)
            counts[k] = len(starts)
            for col, x in zip(cols, (np.arange(len(starts), dtype=np.int32), starts, np.append(starts[1:], len(text)), tokens, crossing), strict=True):
                col.append(x)
        ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(texts)), counts)))
        names = ["doc_id", "section", "section_start", "section_end", "n_tokens", "n_crossing"]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c)) for c in cols)], names=names)

    return by_batch(texts_of(docs), work, SCHEMA)
