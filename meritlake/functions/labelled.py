"""Values that stand beside labels in HTML: an Arrow function over the standard library's parser, as tags nest."""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that may hold a label, those beside it that may hold its value, headings, and headings' stems of criteria.
LABELS, VALUES, HEADINGS = ("dt", "th", "strong", "b", "span", "p", "li", "h2", "h3", "h4"), ("dd", "td", "span", "p"), ("h2", "h3", "h4")
STEMS = ("eligib", "criteria", "requirement", "qualification")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_REOPENED = frozenset("p li dt dd td th tr".split())
_HIDDEN = frozenset("script style noscript nav footer header".split())
#: An ampersand that begins no whole character reference, as in text that was cut; it stands for itself.
_BARE = re.compile(r"&(?!#?\w+;)")
#: What is read from a page at once, whatever portal it is of.
FACTS = "title string, text string, links array<string>"


class Page(HTMLParser):
    """A page's elements in order, from one pass: name, parent, attributes, and which stretch of the page's texts each one holds."""

    def __init__(self, html: str | None) -> None:
        super().__init__()
        self.names, self.ups, self.attrs, self.begins, self.ends = [""], [-1], [{}], [0], [0]
        self.within: list[list[int]] = [[]]
        self.texts: list[str] = []
        self._open, self._said = [0], {}
        self.feed(_BARE.sub("&amp;", html or ""))
        self.close()
        for k in self._open:
            self.ends[k] = len(self.texts)

    def handle_starttag(self, tag, attrs):
        if tag == self.names[self._open[-1]] and tag in _REOPENED:
            self.ends[self._open.pop()] = len(self.texts)
        up, k = self._open[-1], len(self.names)
        self.names.append(tag)
        self.ups.append(up)
        self.attrs.append(dict(attrs) if attrs else {})
        self.begins.append(len(self.texts))
        self.ends.append(len(self.texts))
        self.within.append([])
        self.within[up].append(k)
        if tag not in _VOID:
            self._open.append(k)

    def handle_endtag(self, tag):
        for at in range(len(self._open) - 1, 0, -1):
            if self.names[self._open[at]] == tag:
                for k in self._open[at:]:
                    self.ends[k] = len(self.texts)
                del self._open[at:]
                return

    def handle_data(self, data):
        self.texts.append(data)

    def text(self, k: int) -> str:
        """All text within an element, white space as single spaces."""
        if k not in self._said:
            self._said[k] = " ".join("".join(self.texts[self.begins[k] : self.ends[k]]).split())
        return self._said[k]

    def _after(self, k: int) -> list[int]:
        """The elements behind one that have its parent."""
        beside = self.within[self.ups[k]]
        return beside[bisect_right(beside, k) :]

    def value(self, labels: list[str]) -> str:
        """The text beside the first element that begins with a label, or behind the colon in it; empty if there is none."""
        able = [k for k, n in enumerate(self.names) if n in LABELS]
        low = [(k, self.text(k).lower()) for k in able]
        for label in (x.lower() for x in labels):
            for k, text in low:
                if text.startswith(label):
                    beside = next((self.text(n) for n in self._after(k) if self.names[n] in VALUES), None)
                    found = beside if beside is not None else self.text(k) if ":" in text else None
                    if found is not None:
                        return found.split(":", 1)[1].strip() if ":" in found else found
        return ""

    def criteria(self) -> str:
        """The texts that follow headings of criteria, up to the next heading."""
        out = []
        for k, name in enumerate(self.names):
            if name in HEADINGS and any(s in self.text(k).lower() for s in STEMS):
                for n in self._after(k):
                    if self.names[n] in HEADINGS:
                        break
                    out.append(self.text(n))
        return " ".join(out)

    def first(self, *names: str) -> str:
        """The text of the first element with one of names."""
        return next((self.text(k) for k, n in enumerate(self.names) if n in names), "")

    def publisher(self) -> str:
        """The content of the first meta element whose name speaks of an organisation or a publisher."""
        metas = (a for n, a in zip(self.names, self.attrs, strict=True) if n == "meta")
        return next((" ".join(c.split()) for a in metas if re.search("org|publisher", a.get("name") or "", re.I) and (c := a.get("content"))), "")

    def sponsor(self) -> str:
        """The text of the first element whose class speaks of a provider, sponsor or organisation."""
        return next((self.text(k) for k, a in enumerate(self.attrs) if a and re.search("provider|sponsor|organization", a.get("class") or "", re.I)), "")

    def links(self) -> list[str]:
        """The addresses of links, in order; what only looks like one, in a script or a comment, is none."""
        return [h for n, a in zip(self.names, self.attrs, strict=True) if n == "a" and (h := a.get("href")) is not None]

    def visible(self) -> str:
        """What a reader sees: no scripts, styles, navigation, headers or footers, whatever they nest; white space as single spaces."""
        shown, at = [], 0
        for k, n in enumerate(self.names):
            if n in _HIDDEN and self.begins[k] >= at:
                shown += self.texts[at : self.begins[k]]
                at = self.ends[k]
        return " ".join(" ".join(shown + self.texts[at:]).split())


def value_of(html: str, labels: list[str]) -> str:
    """Page.value() of one page."""
    return Page(html).value(labels)


def labelled(html: Column, labels: list[str]) -> Column:
    """Page.value() of each page."""

    @F.pandas_udf("string")
    def find(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: value_of(h, labels))

    return find(html)


def criteria(html: Column) -> Column:
    """Page.criteria() of each page."""

    @F.pandas_udf("string")
    def find(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: Page(h).criteria())

    return find(html)


def facts(html: Column) -> Column:
    """FACTS of each page by its tree; a null page is an empty one."""

    @F.pandas_udf(FACTS)
    def read(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for h in pages:  # a tree at a time
            page = Page(h)
            rows.append((page.first("title"), page.visible(), page.links()))
        return pd.DataFrame(rows, columns=["title", "text", "links"])

    return read(html)
