"""Labels as columns: disciplines, academic levels and metropolitan areas."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake.functions.vocabulary import CREDENTIAL_WORDS, DISCIPLINE_WORDS, DISCIPLINES, METROS, PHASES


def lookup(pairs: dict[str, str]) -> Column:
    """A literal map."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def strings(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def filled(c: Column) -> Column:
    """An array that is null as an empty one."""
    return F.coalesce(c, F.array().cast("array<string>"))


def lowered(c: Column) -> Column:
    """All strings of an array in lower case."""
    return F.transform(filled(c), F.lower)


def discipline_of(label: Column) -> Column:
    """The discipline a label stands for: the label itself, else the first that it begins with, else the first within it, else any."""
    low = F.lower(F.trim(label))
    known = strings(list(DISCIPLINES))
    return F.when(F.coalesce(label, F.lit("")) == "", "any").otherwise(
        F.coalesce(
            F.try_element_at(lookup(DISCIPLINES), low),
            F.try_element_at(lookup(DISCIPLINES), F.get(F.filter(known, lambda k: low.startswith(k)), F.lit(0))),
            F.try_element_at(lookup(DISCIPLINES), F.get(F.filter(known, lambda k: low.contains(k)), F.lit(0))),
            F.lit("any"),
        )
    )


def level_of(phase: Column) -> Column:
    """The academic level of a phase of study; unknown ones stand for themselves, a null or empty one is null."""
    low = F.lower(F.trim(phase))
    return F.when(phase != "", F.coalesce(F.try_element_at(lookup(PHASES), low), low))


def metro_of(value: Column) -> Column:
    """The key of an area given by CBSA code, name or key; unknown ones are their own key, a null is empty."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    codes = lookup({f"cbsa:{m[2]}": m[0] for m in METROS})
    names = lookup({m[1].lower(): m[0] for m in METROS})
    return F.coalesce(F.try_element_at(codes, v), F.try_element_at(names, v), v)


def metro_name(slug: Column) -> Column:
    """The name of an area by its key; unknown ones are their own."""
    return F.coalesce(F.try_element_at(lookup({m[0]: m[1] for m in METROS}), slug), slug)


def metro_code(slug: Column) -> Column:
    """The CBSA code of an area by its key; unknown ones have an empty one."""
    return F.coalesce(F.try_element_at(lookup({m[0]: m[2] for m in METROS}), slug), F.lit(""))


@lru_cache(maxsize=64)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """One automaton over all terms; each leads to its length and its places in terms."""
    places: dict[str, list[int]] = {}
    for n, t in enumerate(terms):
        places.setdefault(t, []).append(n)
    out = ahocorasick.Automaton()
    for t, at in places.items():
        out.add_word(t, (len(t), tuple(at)))
    out.make_automaton()
    return out


#: What a word goes on with.
_EDGE = frozenset("abcdefghijklmnopqrstuvwxyz'-")


def _held(text: str, automaton: ahocorasick.Automaton, whole: bool) -> list[int]:
    found: set[int] = set()
    for end, (size, places) in automaton.iter(text):
        if not whole or text[end - size : end - size + 1] not in _EDGE and text[end + 1 : end + 2] not in _EDGE:
            found.update(places)
    return sorted(found)


def _search(text: Column, terms: list[str], whole: bool) -> Column:
    """All terms are looked for in one pass over a text by an automaton, in Arrow batches; nothing but the places found comes back."""
    wanted = tuple(terms)

    @F.arrow_udf("array<int>")
    def search(texts: pa.Array) -> pa.Array:
        automaton = _automaton(wanted)
        return pa.array([_held(t, automaton, whole) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return search(F.lower(F.coalesce(text, F.lit(""))))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Places in terms (none of them empty), rising, of those that a text holds in any case, even within other words."""
    return _search(text, terms, False)


def words_in(text: Column, terms: list[str]) -> Column:
    """Places in terms (none of them empty), rising, of those that a text holds in any case as whole words: no letter, apostrophe or hyphen before or behind."""
    return _search(text, terms, True)


def _mapped(text: Column, words: dict[str, list[str]]) -> Column:
    terms = list(dict.fromkeys(w for ws in words.values() for w in ws))
    labels = F.array(*[strings([k for k, ws in words.items() if t in ws]) for t in terms])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(terms_in(text, terms), lambda n: F.get(labels, n)))))


def disciplines_in(text: Column) -> Column:
    """Disciplines whose words a text holds, in order of name."""
    return _mapped(text, DISCIPLINE_WORDS)


def credentials_in(text: Column) -> Column:
    """Credentials whose words a text holds, even within other words, in order of name."""
    return _mapped(text, CREDENTIAL_WORDS)


def metro_terms() -> tuple[dict[str, str], dict[str, str]]:
    """Words for areas and counties with the area of each; a county of two areas belongs to the later one, at its first place."""
    words = {w: m[0] for m in METROS for w in m[4]}
    counties: dict[str, str] = {}
    for m in METROS:
        for c in m[3]:
            counties[c] = m[0]
    return words, counties


def first_metro(text: Column) -> Column:
    """The first area that a text names, words for areas before counties, or null."""
    return F.get(metros_in(text), F.lit(0))


def metros_in(text: Column) -> Column:
    """Areas that a text names, each once: first by words for areas, then by counties, as whole words."""
    words, counties = metro_terms()
    named = [*words.items(), *counties.items()]
    areas = strings([slug for _, slug in named])
    return F.array_distinct(F.transform(words_in(text, [t for t, _ in named]), lambda n: F.get(areas, n)))
