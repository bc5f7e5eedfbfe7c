"""Tokens of whole texts, by pieces that the tokenizer treats alike wherever they stand."""

from __future__ import annotations

import re
from itertools import accumulate
from struct import Struct, pack

import numpy as np

#: Pieces that are kept; a full table is emptied, so memory is bounded.
KEPT_PIECES = 700_000
#: Marks that the pattern parts from the word before them.
_TAILS = frozenset('.,;:!?)"')
_BREAK = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Packers(dict):
    """Packs so many ids, four bytes each."""

    def __missing__(self, n: int):
        self[n] = found = Struct(f"<{n}I").pack
        return found


class Pieces:
    """Ids and places of a byte-level BPE's tokens.

    The vocabulary's pattern never lets a token cross the place before a single space that stands between two
    characters other than white space, so a text can be cut there, and a piece's tokens are the same in any
    text. Pieces are kept, as most of them recur.
    """

    def __init__(self, path: str, spans: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self._packed = _Packers()
        self.spans = spans
        self.newline = pack("<2i", 0, 1) if spans else pack("<I", *self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.tails = {t: self._run(t) for t in _TAILS}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _encode(self, pieces: list[str], space: bool) -> list[bytes]:
        """What is kept of pieces, with the space before them if there is one: ids, or places from the first character on."""
        out: list[bytes] = [b""] * len(pieces)
        rest, kept, run, tail_of = [], self.later if space else self.first, self._run, self.tails.get
        for k, piece in enumerate(pieces):
            before, line = (" ", b"") if space else ("", b"")
            if piece[:1] == "\n":  # a line break between words is a token of its own, and no space follows it
                before, line, piece = "", self.newline, piece[1:]
            word, tail = (piece[:-1], piece[-1]) if piece[-1:] in _TAILS else (piece, "")
            if not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
                rest.append(k)
                continue
            # the pattern makes one run of the word, and one of the mark behind it
            found = None if line or not tail else kept.get(word)
            if found is None:
                found = run(before + word, len(line) // 8)
            out[k] = line + found + (tail_of(tail) if not self.spans else run(tail, len(line) // 8 + len(before) + len(word))) if tail else line + found
        if rest:
            texts = [pieces[k] if pieces[k][:1] == "\n" or not space else " " + pieces[k] for k in rest]
            for k, e in zip(rest, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                out[k] = np.array(e.offsets, dtype="<i4").tobytes() if self.spans else np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _run(self, run: str, base: int = 0) -> bytes:
        if not self.spans and run.isascii():
            return self._packed[len(tokens := self.model.tokenize(run.replace(" ", self.letters[32])))](*[t.id for t in tokens])
        raw = run.encode()
        tokens = self.model.tokenize(raw.decode("latin-1").translate(self.letters) if len(raw) > len(run) else run.replace(" ", self.letters[32]))
        if not self.spans:
            return pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        ends = list(accumulate(len(t.value) for t in tokens))
        if len(raw) == len(run):
            flat = [x + base for pair in zip([0, *ends], ends, strict=False) for x in pair]
        else:
            of = [k for k, c in enumerate(run) for _ in range(len(c.encode()))]
            flat = [x + base for s, e in zip([0, *ends], ends, strict=False) for x in (of[s], of[e - 1] + 1)]
        return pack(f"<{len(flat)}i", *flat)

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text's pieces; each but the first stood behind one space, or begins with the line break it stood behind."""
        if not text:
            return []
        words = text.split()
        gaps = len(words) - 1
        if text.count(" ") + text.count("\n") == gaps and sum(map(len, words)) + gaps == len(text):  # one character between words, and none but these two
            return text.replace("\n", " \n").split(" ")
        return _BREAK.split(text)

    def learn(self, cut: list[list[str]]) -> None:
        """Encode what is not kept yet of many texts' pieces."""
        if len(self.later) > KEPT_PIECES:
            self.later.clear()
        if len(self.first) > KEPT_PIECES:
            self.first.clear()
        new = list({p for pieces in cut for p in pieces[1:]}.difference(self.later))
        self.later.update(zip(new, self._encode(new, True), strict=True))
        new = list({pieces[0] for pieces in cut if pieces}.difference(self.first))
        self.first.update(zip(new, self._encode(new, False), strict=True))

    def ids(self, pieces: list[str]) -> bytes:
        """All ids of a text in order, four bytes each, little-endian. learn() came first."""
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:])) if pieces else b""

    def places(self, pieces: list[str]) -> np.ndarray:
        """(start, end) of each token in the text, in code points. learn() came first."""
        if not pieces:
            return np.zeros((0, 2), dtype=np.int64)
        found = [self.first[pieces[0]], *map(self.later.__getitem__, pieces[1:])]
        widths = np.fromiter((len(p) + (p[:1] != "\n") for p in pieces), dtype=np.int64, count=len(pieces))
        widths[0] = len(pieces[0])
        base = np.cumsum(widths) - widths
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 8
        return np.frombuffer(b"".join(found), dtype="<i4").reshape(-1, 2) + np.repeat(base, counts)[:, None]


_OPEN: dict[tuple[str, bool], Pieces] = {}


def pieces_for(path: str, spans: bool = False) -> Pieces:
    """One Pieces for each Python worker and vocabulary."""
    if (path, spans) not in _OPEN:
        _OPEN[path, spans] = Pieces(path, spans)
    return _OPEN[path, spans]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of one of the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)
