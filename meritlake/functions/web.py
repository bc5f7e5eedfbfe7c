"""Addresses and pages as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake.functions.labels import strings
from meritlake.functions.vocabulary import BLOCKED_DOMAINS, EXTENSIONS, HUB_PATHS, LOGIN_DOMAINS, NEGATIVE_PATHS, NON_HUB_PATHS, PATH_WORDS, SOCIAL_DOMAINS


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where value is worked out once, however often made names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def normal_url(url: Column) -> Column:
    """A web address without white space around it and without its fragment, its scheme in lower case; anything else is null."""
    bare = F.trim(F.regexp_extract(F.trim(url), "^((?i:https?):[^#]*)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, "^(?i:https):", "https:"), "^(?i:http):", "http:"), F.lit(""))


def domain_of(url: Column) -> Column:
    """The host in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "")


def path_of(url: Column) -> Column:
    """The path in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))


def root_of(url: Column) -> Column:
    """Scheme and host alone; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1), F.lit(""))


def resolved(href: Column, page: Column) -> Column:
    """A link on a page as a full address; links within the page and to mail, telephone or scripts are null."""
    return _with(_with(F.trim(href), lambda h: _joined(h, page)), _collapsed)


def resolved_or_page(href: Column, page: Column) -> Column:
    """A link as a full address; a missing or blank one is the page itself."""
    return F.when(F.trim(F.coalesce(href, F.lit(""))) == "", page).otherwise(resolved(href, page))


def _collapsed(url: Column) -> Column:
    """An address without . and .. in its path."""
    head, path, tail = (F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, 10_000), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    ended = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.rlike(url, F.lit(r"^[A-Za-z]+://[^?#]*/\.\.?(/|[?#]|$)")), F.concat(head, F.lit("/"), F.array_join(ended, "/"), tail)).otherwise(url)


def _joined(h: Column, page: Column) -> Column:
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(://[^/]+.*/)[^/]*$", "$1")
    within = _with(folder, lambda f: F.when(F.rlike(f, F.lit("^[A-Za-z]+://[^/]+$")), F.concat(f, F.lit("/"))).otherwise(f))
    return (
        F.when((h == "") | F.rlike(h, F.lit("^(#|mailto:|tel:|javascript:)")), F.lit(None).cast("string"))
        .when(F.rlike(h, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(page, "^([A-Za-z]+:)", 1), h))
        .when(h.startswith("/"), F.concat(root_of(page), h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(page, r"[?#].*$", ""), h))
        .otherwise(F.concat(within, h))
    )


def _within(text: Column, words: list[str]) -> Column:
    return F.exists(strings(words), lambda w: text.contains(w))


def _file(path: Column) -> Column:
    return F.exists(strings(EXTENSIONS), lambda e: path.endswith(e))


def followed(path: Column, domain: Column, home: Column) -> Column:
    """Whether the crawl follows a link from a page at home: not a file, not blocked, no negative path; on the page's own domain, or with a word of interest."""
    portal = domain.endswith(".academicworks.com") & path.contains("/opportunities")
    ok = (domain != "") & ~_file(path) & ~domain.isin(*BLOCKED_DOMAINS) & ~_within(path, NEGATIVE_PATHS)
    return ok & ((domain == home) | portal | _within(path, PATH_WORDS))


def hub(path: Column, domain: Column, queued: bool = False) -> Column:
    """Whether a link looks like a directory worth crawling from; queued: by the queue's wider list of excluded domains."""
    out = [*BLOCKED_DOMAINS, *SOCIAL_DOMAINS, *(LOGIN_DOMAINS if queued else [])]
    return (domain != "") & ~_file(path) & ~domain.isin(*out) & ~_within(path, NON_HUB_PATHS) & _within(path, HUB_PATHS)


def links_in(html: Column) -> Column:
    """All href values, quoted or not, in order."""
    quoted = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(quoted, lambda h: F.regexp_replace(h, """^["']|["']$""", ""))


def title_in(html: Column) -> Column:
    """The title's text."""
    return unescaped(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def unescaped(c: Column) -> Column:
    """Common character references as characters."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def text_in(html: Column) -> Column:
    """What a reader sees: the title, but no scripts, styles, navigation, headers, footers or tags; white space as single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|nav|footer|header)\b[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(F.regexp_replace(bare, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")), r"\s+", " "))
