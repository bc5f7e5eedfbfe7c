"""Values in range or not, values that count as missing, and who may do what."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def opt_str(c: Column) -> Column:
    """An empty text as null."""
    return F.nullif(c, F.lit(""))


def opt_float(c: Column) -> Column:
    """A number as double, 0 as null."""
    return F.nullif(c.cast("double"), F.lit(0.0))


def str_list(c: Column) -> Column:
    """An array of texts, null as an empty one."""
    return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))


def consent_time(accepted: Column, now: Column, before: Column) -> Column:
    """The time of consent: now if it is given, else what was there."""
    return F.when(F.coalesce(accepted, F.lit(False)), now).otherwise(before)


#: What reports, cancellations and billing plans may say.
REPORT_REASONS = ["broken_link", "inaccurate_deadline", "expired"]
CANCEL_REASONS = ["won_scholarship", "too_expensive", "not_enough_opportunities", "finished_cycle", "other"]
PLANS = ["monthly", "annual"]


def profile_faults(gpa: Column, state: Column) -> Column:
    """Names of a profile's fields that are out of range: gpa from 0 to 4, state of two characters at most; nulls are not."""
    bad = {"gpa": ~gpa.between(0.0, 4.0), "state": F.length(state) > 2}
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in bad.items()]))


def one_of(value: Column, choices: list[str]) -> Column:
    """Whether a value is there and one of choices."""
    return F.coalesce(value.isin(*choices), F.lit(False))


def create_outcome(role: Column) -> Column:
    """What a caller who creates an opportunity gets: only the service role may."""
    return F.when(F.coalesce(role, F.lit("")) == "service_role", "created").otherwise("forbidden")


def admin_outcome(key: Column, expected: str | None) -> Column:
    """What an admin request gets: disabled where no key is set, unauthorized for another key or none."""
    return F.lit("disabled") if not expected else F.when(F.coalesce(key, F.lit("")) == expected, "ok").otherwise("unauthorized")
