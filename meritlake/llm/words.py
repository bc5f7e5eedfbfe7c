"""Hashes of the words of many texts at once, from the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are worked on at once; a longer text is worked on alone.
AT_ONCE = 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Hashes of hashes."""
    h = (h ^ seed) * _ODD[3]
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    return h ^ (h >> np.uint64(29))


#: A number for each byte, the same for a letter in upper and lower case.
_LETTER = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1), _ODD[0])
_LETTER[65:91] = _LETTER[97:123]
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _ODD[0])])
    return _powers[:n]


def parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, where each text of these begins and the last ends) of a column of texts without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64, count=len(texts) + 1, offset=texts.offset * (4 if pa.types.is_string(texts.type) else 8)).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + AT_ONCE, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _first_bytes(blank: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin."""
    begins = ~blank
    begins[1:] &= blank[:-1]
    edge = bounds[:-1][bounds[:-1] < len(blank)]
    begins[edge] = ~blank[edge]
    return np.flatnonzero(begins)


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of words of each text of a column without nulls."""
    out = np.zeros(len(texts), dtype=np.int64)
    for a, b, data, bounds in parts(texts):
        out[a:b] = np.diff(np.searchsorted(_first_bytes(_SPACE[data], bounds), bounds))
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, A-Z in lower case; where each text's words begin, and their number)."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    blank = _SPACE[data]
    first = _first_bytes(blank, bounds)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))[-len(data) :] if first[0] == 0 else np.arange(len(data)) - np.concatenate([np.zeros(first[0], dtype=np.int64), np.repeat(first, np.diff(np.append(first, len(data))))])
    values = _LETTER[data] * powers(int(place.max()) + 1)[place]
    values[blank] = 0
    return mixed(np.add.reduceat(values, first), _ODD[2]), np.searchsorted(first, bounds)


def shingle_hashes(words: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of size words within a text; where each text's begin, and their number)."""
    count = np.maximum(np.diff(begins) - size + 1, 0)
    out = words.copy()
    for k in range(1, size):
        out[: len(out) - k] = out[: len(out) - k] * _ODD[0] + words[k:]
        out ^= out >> np.uint64(31)
    ends = np.append(0, np.cumsum(count))
    at = np.repeat(begins[:-1] - ends[:-1], count) + np.arange(ends[-1])
    return out[at], ends


def shingles(text: str, size: int) -> np.ndarray:
    """The shingle hashes of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return shingle_hashes(*word_hashes(raw, np.array([0, len(raw)])), size)[0]
