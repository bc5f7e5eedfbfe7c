"""Rules that an extraction must keep, whatever it reads: amounts, deadlines, scope, competition, platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake.functions.parsing import day
from meritlake.functions.vocabulary import VENDORS
from meritlake.functions.web import domain_of

#: Reaches of an award, from wide to narrow, and what competition each means.
SCOPES = ["national", "state", "metro", "county", "city"]
COMPETITION = {"national": "high", "state": "medium", "metro": "medium", "county": "low", "city": "low"}
FUNDING = ["scholarship", "tuition_reimbursement", "employer_sponsorship", "loan_repayment", "service_contingent"]
COVERAGE = ["direct_bill", "reimbursement", "forgivable_loan"]


def award_of(text: Column) -> Column:
    """Whole dollars: the largest number of a range; 0 for an amount that varies; null where nothing is said."""
    sums = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.when(F.size(sums) > 0, F.floor(F.array_max(sums)).cast("long")).when(F.lower(text).contains("varies"), 0)


def deadline_of(text: Column, as_of: str) -> Column:
    """A deadline; one without a year is the next such day from as_of on."""
    found, now = day(text, as_of), F.lit(as_of).cast("date")
    dated = F.rlike(F.coalesce(text, F.lit("")), F.lit(r"\d{4}|\d[-/.]\d{1,2}[-/.]\d{2}\b"))
    return F.when(~dated & (found < now), F.add_months(found, 12)).otherwise(found)


def scope_of(scope: Column, states: Column, metros: Column, counties: Column, cities: Column) -> Column:
    """The reach that is given, if it is a known one; else the narrowest place that restricts the award, national without any."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    own = F.when(some(cities), "city").when(some(counties), "county").when(some(metros), "metro").when(some(states), "state").otherwise("national")
    return F.when(F.lower(scope).isin(*SCOPES), F.lower(scope)).otherwise(own)


def competition_of(scope: Column) -> Column:
    """How many compete for an award of a reach."""
    out = F.lit(None).cast("string")
    for k, v in COMPETITION.items():
        out = F.when(scope == k, v).otherwise(out)
    return out


def vendor_of(url: Column) -> Column:
    """The platform whose host an address has, or null."""
    host, out = domain_of(url), F.lit(None).cast("string")
    for k, v in VENDORS.items():
        out = F.when((host == k) | host.endswith(f".{k}"), v).otherwise(out)
    return out


def known_or(value: Column, choices: list[str], default: str | None) -> Column:
    """A value in lower case if it is one of choices, else the default."""
    return F.when(F.lower(value).isin(*choices), F.lower(value)).otherwise(F.lit(default))
