"""Personal data: identifiers in texts as they stand, and in texts whose disguises are undone, at their places in the source."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from meritlake.llm.base import by_batch, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, as the run's end decides
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind: leftmost, not overlapping within a kind; matches that fail their check are dropped."""
    out: dict[str, list[Span]] = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    if not any(map(text.__contains__, "0123456789")):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Characters that are drawn like others, characters that are not drawn, and words for digits.
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "τ": "t", "ɑ": "a", "ı": "i", "ɡ": "g",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹫": "@",
    " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
_HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f"
_DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_LOOKS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}  # full-width forms
_LOOKS |= {chr(first + k): str(k) for first in (0x660, 0x6F0, 0x966, 0x2080) for k in range(10)}
_LOOKS |= {chr(0x1D7CE + k): str(k % 10) for k in range(50)}

_WORD = "(?:" + "|".join(_DIGIT_WORDS) + ")"
_LIKE = re.compile("[" + re.escape("".join(_LOOKS)) + _HIDDEN + "]")
_SPELLED = re.compile(rf"\b(?:plus[\x20-]+)?{_WORD}(?:(?:[\x20,-]+|[\x20]+(?:dot|point)[\x20]+){_WORD})+\b", re.I)
_ONE_WORD = re.compile(rf"plus|{_WORD}|dot|point", re.I)
_AT = re.compile(r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?", re.I)
_DOT = re.compile(r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?", re.I)
#: A bare "at" counts only where a spelled or bracketed dot follows, as plain sentences have it too.
_BARE = re.compile(r"(?<=[A-Za-z0-9])(\x20at\x20)[A-Za-z0-9-]+((?:(?:\x20dot\x20|\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?)[A-Za-z0-9-]+)+)", re.I)
_BARE_DOT = re.compile(r"\x20dot\x20", re.I)
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+((?:\x20dot\x20[A-Za-z0-9-]+)+)", re.I)

Edit = tuple[int, int, str]


def apply(text: str, starts: list[int], ends: list[int], edits: list[Edit]) -> tuple[str, list[int], list[int]]:
    """A transducer's step: replace places (in order, not overlapping) and carry each character's source place along."""
    out, s, e, at = [], [], [], 0
    for a, b, new in edits:
        if a < at:
            continue
        out += [text[at:a], new]
        s += starts[at:a]
        e += ends[at:a]
        if new:
            s += [starts[a]] * len(new)
            e += [ends[b - 1]] * len(new)
        at = b
    out.append(text[at:])
    return "".join(out), s + starts[at:], e + ends[at:]


def _digits_of(m: re.Match) -> list[Edit]:
    """A run of digit words as digits: the words and what is between them, one edit each."""
    base, edits, at = m.start(), [], None
    for w in _ONE_WORD.finditer(m[0]):
        word = w[0].lower()
        new = "+" if word == "plus" else "." if word in ("dot", "point") else _DIGIT_WORDS[word]
        if at is not None and at < w.start():
            edits.append((base + at, base + w.start(), ""))
        edits.append((base + w.start(), base + w.end(), new))
        at = w.end()
    return edits


def disguised(text: str) -> bool:
    """Whether any step of plain() would change the text."""
    return bool((not text.isascii() and _LIKE.search(text)) or (("@" in text or "at" in text.lower()) and (_AT.search(text) or _BARE.search(text))) or _DOT.search(text) or _SPELLED.search(text) or _AFTER_AT.search(text))


def plain(text: str) -> tuple[str, list[int], list[int]]:
    """The text without disguises, and the source place (start, end) of each of its characters."""
    now, starts, ends = text, list(range(len(text))), list(range(1, len(text) + 1))
    steps = (
        lambda t: [(m.start(), m.end(), _LOOKS.get(m[0], "")) for m in _LIKE.finditer(t)],
        lambda t: [e for m in _SPELLED.finditer(t) for e in _digits_of(m)],
        lambda t: sorted([(*m.span(), "@") for m in _AT.finditer(t)] + [(*m.span(), ".") for m in _DOT.finditer(t)] + [(*m.span(1), "@") for m in _BARE.finditer(t)]),
        lambda t: [(*d.span(), ".") for m in _AFTER_AT.finditer(t) for d in _BARE_DOT.finditer(t, *m.span(1))],
    )
    for step in steps:
        if edits := step(now):
            now, starts, ends = apply(now, starts, ends, edits)
    return now, starts, ends


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and those with what only the text without disguises shows, which may hold or overlap base spans of their kind."""
    base = spans(text)
    if not disguised(text):
        return base, base
    now, starts, ends = plain(text)
    found = {}
    for kind, own in base.items():
        new = []
        for a, b in spans(now)[kind] if now != text else ():
            s, e = starts[a], ends[b - 1]
            k = bisect_right(own, (s, len(text)))
            if not (k and own[k - 1][1] >= e):  # what lies in a base span says nothing more
                new.append((s, e))
        found[kind] = sorted({*own, *new})
    return base, found


def told(found: dict[str, list[Span]]) -> str:
    """kind:start:end of all spans, by kind, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def masked(text: str, found: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first and longest stands for all."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k in KINDS for a, b in found[k]), key=lambda x: (x[0], -x[1], x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame) -> DataFrame:
    """SCHEMA of every document: counts and digest of base spans, all spans, and how many the method added.

    Places are code points of the source text, end exclusive. Null and empty texts have none; repeated rows are
    treated each; an empty table gives an empty one.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base, found = all_spans(text)
            n = [len(base[k]) for k in KINDS]
            rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(found), sum(map(len, found.values())) - sum(n)))
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return by_batch(texts_of(docs), work, SCHEMA)


def mask_texts(docs: DataFrame) -> DataFrame:
    """docs with all spans of column text masked; other columns, null texts and the order of columns stay."""
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else masked(t, all_spans(t)[1]) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return by_batch(docs, work, docs.schema)
