"""How values are shown: strengths, shares, countdowns, short names and what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake.functions.labels import filled

# Words of a major and its discipline, in order; others are medicine.
MAJOR_WORDS = [
    ("pharmacy", ["pharmacy"]), ("nursing", ["nurs"]),
    ("therapeutics_rehab", ["physical therapy", "occupational therapy", "kinesi", "exercise", "athletic", "speech", "respiratory"]),
    ("diagnostic_imaging", ["radiolog", "imaging", "sonograph"]),
    ("public_health_emergency", ["public health", "epidemi", "health admin", "health inform", "global health", "environmental health"]),
]


def discipline_of_major(major: Column) -> Column:
    """The discipline of a major by its words; medicine if nothing is known."""
    low, out = F.lower(F.trim(F.coalesce(major, F.lit("")))), F.lit("medicine")
    for name, words in reversed(MAJOR_WORDS):
        out = F.when(F.rlike(low, F.lit("|".join(words))), name).otherwise(out)
    return out


def _vectors() -> list[tuple[str, Column, Column]]:
    """Name, whether it counts as filled for strength, whether it is missing for guidance."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    studied, trained = F.size(filled(F.col("disciplines"))) > 0, F.size(filled(F.col("target_credentials"))) > 0
    who = F.coalesce("first_gen", F.lit(False)) | F.coalesce("minority", F.lit(False))
    return [
        ("Field of Study", studied, ~studied & F.col("primary_discipline").isNull()), ("Target Credential", trained, ~trained & F.col("target_credential").isNull()),
        ("Clinical Phase", text("clinical_phase"), ~text("clinical_phase")), ("GPA", F.col("gpa").isNotNull(), F.col("gpa").isNull()),
        ("State of Residence", text("state"), ~text("state")), ("Metro Area", text("metro"), ~text("metro")), ("SAI Score", F.col("sai").isNotNull(), F.col("sai").isNull()), ("Demographics", who, ~who),
    ]


def profile_strength() -> Column:
    """Percent of eight facts that a profile has, halves up."""
    return F.floor(sum((ok.cast("int") for _, ok, _ in _vectors()), F.lit(0)) / 8 * 100 + 0.5).cast("int")


def profile_gaps() -> Column:
    """Names of what a profile lacks; nothing at full strength."""
    gaps = [F.when(gap, name) for name, _, gap in _vectors()] + [F.when(F.size(filled(F.col("affiliations"))) == 0, "Affiliations")]
    return F.when(profile_strength() >= 100, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*gaps)))


def share_done(checklist: Column) -> Column:
    """Percent of a checklist's items that are completed; 0 without any."""
    return F.when(F.size(checklist) > 0, F.floor(F.size(F.filter(checklist, lambda x: x["completed"])) / F.size(checklist) * 100 + 0.5)).otherwise(0).cast("int")


def countdown(target: Column, now: Column) -> Column:
    """Time left in days and hours, or hours and minutes, or soon."""
    left = F.unix_timestamp(target) - F.unix_timestamp(now)
    d, h, m = F.floor(left / 86400), F.floor(left % 86400 / 3600), F.floor(left % 3600 / 60)
    return F.when(left <= 0, "soon").when(d > 0, F.format_string("in %dd %dh", d, h)).otherwise(F.format_string("in %dh %dm", h, m))


def shortened(text: Column, most: int = 25) -> Column:
    """A longer text cut to most - 2 characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 2)), F.lit("…"))).otherwise(text)


def dollars(cents: Column) -> Column:
    """Cents as dollars; none for null and 0."""
    return F.when(cents != 0, F.format_string("$%.2f", cents / 100))


def fallback_score(rank: Column) -> Column:
    """The score of a feed's place where none was worked out: 90 less 5 for each place, 50 at least."""
    return F.greatest(90 - (rank - 1) * 5, F.lit(50))


def month_grid(day: Column) -> Column:
    """All days of the weeks, Sunday first, that a day's month touches."""
    first, last = F.trunc(day, "month"), F.last_day(day)
    return F.sequence(F.date_sub(first, F.dayofweek(first) - 1), F.date_add(last, 7 - F.dayofweek(last)))


def days_left(deadline: Column, now: Column) -> Column:
    """Whole days to a deadline, a begun one counting."""
    return F.ceil((F.unix_timestamp(deadline.cast("timestamp")) - F.unix_timestamp(now)) / 86400)


def first_name(name: Column) -> Column:
    """What stands before the first space; there for no name. A leading space leaves nothing."""
    return F.when(F.coalesce(name, F.lit("")) == "", "there").otherwise(F.substring_index(name, " ", 1))


def humanized(label: Column) -> Column:
    """A label with spaces for underscores."""
    return F.replace(label, F.lit("_"), F.lit(" "))


def short_metro(value: Column, options: Column) -> Column:
    """The short name of an area given by name or key, among options array<struct<slug, name, short>>; others are shortened.

    A CBSA code is compared with keys, as in the reference, and so never found.
    """
    by = lambda field, v: F.get(F.filter(options, lambda m: m[field] == v), F.lit(0))["short"]
    return F.coalesce(by("name", value), by("slug", value), F.when(value.startswith("cbsa:"), by("slug", F.substring(value, 6, 1000))), shortened(value))


def metros_for_state(state: Column, options: Column) -> Column:
    """options array<struct<slug, .., states array<string>>>, those of a state first, each part in its order."""
    code = F.upper(F.trim(state))
    own = lambda m: (code != "") & F.array_contains(m["states"], code)
    return F.concat(F.filter(options, own), F.filter(options, lambda m: ~own(m)))


def first_messages(messages: Column, most: int = 3) -> Column:
    """The messages that have room."""
    return F.slice(messages, 1, most)


def truncated(text: Column, most: int = 12_000) -> Column:
    """The first characters that an extraction may read.

    Only the first bytes are looked at, as characters of a whole long text take long to count: if so many bytes are as many
    characters, with three more, which the last one may take, they are what is asked for; else it lies within four times as many.
    """
    first = lambda n: F.substring(text.cast("binary"), 1, n).cast("string")
    plain = F.length(first(most + 3)) == F.octet_length(first(most + 3))
    return F.when(F.octet_length(text) <= most, text).when(plain, first(most)).otherwise(F.left(first(4 * most), F.lit(most)))


def outline_markdown(outline: Column) -> Column:
    """An outline struct<theme, angle, parts array<struct<label, words, points, tips>>, checklist> as Markdown."""
    listed = lambda head, items, mark: F.when(F.size(items) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x, F.lit("\n"))), ""))).otherwise("")
    part = lambda p: F.concat(
        F.lit("### "), p["label"], F.lit(" (~"), p["words"].cast("string"), F.lit(" words)\n"), listed("**Talking Points:**", p["points"], "- "), listed("**Coaching Tips:**", p["tips"], "- "), F.lit("\n")
    )
    head = F.concat(F.lit("## AI Essay Outline\n\n**Suggested Theme:** "), outline["theme"], F.lit("\n\n**Mission Alignment:** "), outline["angle"], F.lit("\n\n"))
    return F.concat(head, F.array_join(F.transform(outline["parts"], part), ""), listed("### Pre-Submission Checklist", outline["checklist"], "- [ ] "))


def appended_notes(notes: Column, markdown: Column) -> Column:
    """Notes with an outline behind a rule; without notes the outline alone."""
    return F.when(F.coalesce(notes, F.lit("")) == "", markdown).otherwise(F.concat(notes, F.lit("\n\n---\n\n"), markdown))


def outline_request(body: Column, listed: Column) -> Column:
    """What a request says, else the first of the profile's list, else null."""
    return F.coalesce(F.nullif(body, F.lit("")), F.try_element_at(listed, F.lit(1)))
