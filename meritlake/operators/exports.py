"""Trackings as task lists, calendars and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
BRAND = "Meritlake"
#: Statuses that a timed calendar shows; dismissed trackings are not left out.
SHOWN = ("saved", "in_progress", "submitted")


def money(amount: Column) -> Column:
    """Whole dollars with thousands marks; a null is none."""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(amount, F.lit(0)), 0))


def quoted(field: Column) -> Column:
    """A CSV field, in quotes only if it needs them."""
    return F.when(F.rlike(field, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def capitalized(c: Column) -> Column:
    """The first letter large, all others small."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1)))


def escaped(c: Column) -> Column:
    """Text in a calendar."""
    for old, new in (("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\n", "\\n")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def percent_encoded(c: Column) -> Column:
    """A text within a link: all but letters, digits and _.-~/ encoded."""
    out = F.url_encode(c)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def notes(items_award: Column, provider: Column, url: Column) -> Column:
    return F.concat(F.lit("Provider: "), provider, F.lit(". Award: "), money(items_award), F.lit(". Apply at "), url)


def task_csv(items: DataFrame, brand: str = BRAND) -> DataFrame:
    """(user_id, n_items, csv): each user's (title, deadline, portal_url, provider, award, status) as a task list, by deadline, then opp_id."""
    head = "Task Name,Due Date,Description,Notes,Section/Column,Tags" + CRLF
    fields = [
        F.col("title"), F.coalesce(F.date_format("deadline", "MM/dd/yyyy"), F.lit("")), F.concat(F.lit("Apply at "), F.col("portal_url")),
        notes(F.col("award"), F.col("provider"), F.col("portal_url")), capitalized(F.col("status")), F.lit(f"{brand},Scholarship"),
    ]
    row = F.concat(F.concat_ws(",", *[quoted(F.coalesce(f, F.lit(""))) for f in fields]), F.lit(CRLF))
    rows = items.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("deadline", "opp_id", row.alias("row")))).alias("rows"))
    return rows.select("user_id", F.size("rows").cast("long").alias("n_items"), F.concat(F.lit(head), F.array_join("rows.row", "")).alias("csv"))


def _calendar(items: DataFrame, head: list[str], event: list[Column | str]) -> DataFrame:
    lines = F.concat_ws(CRLF, *[F.lit(x) if isinstance(x, str) else x for x in event])
    events = items.where("deadline is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("deadline", "opp_id", lines.alias("event")))).alias("events"))
    text = F.concat(F.lit(CRLF.join(["BEGIN:VCALENDAR", *head, ""])), F.array_join("events.event", CRLF), F.lit(CRLF + "END:VCALENDAR"))
    return events.select("user_id", F.size("events").cast("long").alias("n_events"), text.alias("ics"))


def day_calendar(items: DataFrame, stamp: str, brand: str = BRAND) -> DataFrame:
    """(user_id, n_events, ics): all-day events, each with an alarm seven days before; stamp is their time of writing."""
    day = lambda d: F.date_format(d, "yyyyMMdd")
    return _calendar(
        items,
        ["VERSION:2.0", f"PRODID:-//{brand}//Scholarship Deadline Calendar//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH"],
        [
            "BEGIN:VEVENT",
            F.concat(F.lit(f"UID:{brand.lower()}-"), day("deadline"), F.lit("-"), F.lower(F.lpad(F.hex(F.crc32(F.encode("title", "UTF-8"))), 8, "0")), F.lit(f"@{brand.lower()}.example")),
            f"DTSTAMP:{stamp}",
            F.concat(F.lit("DTSTART;VALUE=DATE:"), day("deadline")),
            F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add("deadline", 1))),
            F.concat(F.lit("SUMMARY:"), escaped(F.col("title"))),
            F.concat(F.lit("DESCRIPTION:"), escaped(notes(F.col("award"), F.col("provider"), F.col("portal_url")))),
            F.concat(F.lit("URL:"), F.col("portal_url")),
            "BEGIN:VALARM", "ACTION:DISPLAY", "DESCRIPTION:Scholarship deadline in 7 days", "TRIGGER:-P7D", "END:VALARM", "END:VEVENT",
        ],
    )


def _reminder() -> Column:
    """An alarm at the reminder's time with the line break behind it, or nothing."""
    at = F.date_format(F.col("reminder").try_cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    lines = ["BEGIN:VALARM", "ACTION:DISPLAY", F.concat(F.lit("DESCRIPTION:"), escaped(F.concat(F.lit("Reminder: "), F.col("title")))), F.concat(F.lit("TRIGGER;VALUE=DATE-TIME:"), at), "END:VALARM"]
    return F.when(at.isNotNull(), F.concat(*[x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit("\r\n"))])).otherwise("")


def timed_calendar(items: DataFrame, brand: str = BRAND) -> DataFrame:
    """(user_id, n_events, ics): events from 23:59 to 00:59 UTC of the shown statuses, with alarms seven days and one day before.

    Items with a reminder (a text that holds a time, in UTC where it names no zone) get another alarm at that time; one that is no time is passed over.
    """
    at = lambda d, t: F.concat(F.date_format(d, "yyyyMMdd"), F.lit(t))
    about = F.concat(F.lit("Provider: "), F.col("provider"), F.lit("\nAward: "), money(F.col("award")), F.lit("\nStatus: "), F.col("status"))
    return _calendar(
        items.where(F.col("status").isin(*SHOWN)),
        [f"PRODID:-//{brand}//Scholarship Deadlines//EN", "VERSION:2.0", f"NAME:{brand} Scholarship Deadlines", f"X-WR-CALNAME:{brand} Scholarships", "X-WR-TIMEZONE:UTC"],
        [
            "BEGIN:VEVENT",
            F.concat(F.lit("UID:"), F.col("user_id"), F.lit("-"), F.col("opp_id"), F.lit(f"@{brand.lower()}.example")),
            F.concat(F.lit("SUMMARY:"), escaped(F.concat(F.col("title"), F.lit(" — Deadline")))),
            F.concat(F.lit("DESCRIPTION:"), escaped(about)),
            F.concat(F.lit("DTSTART:"), at("deadline", "T235900Z")),
            F.concat(F.lit("DTEND:"), at(F.date_add("deadline", 1), "T005900Z")),
            "STATUS:CONFIRMED",
            "BEGIN:VALARM", "ACTION:DISPLAY", F.concat(F.lit("DESCRIPTION:"), escaped(F.concat(F.lit("7 days left: "), F.col("title"), F.lit(" deadline")))), "TRIGGER:-P7D", "END:VALARM",
            "BEGIN:VALARM", "ACTION:DISPLAY", F.concat(F.lit("DESCRIPTION:"), escaped(F.concat(F.lit("1 day left: "), F.col("title"), F.lit(" deadline")))), "TRIGGER:-P1D", "END:VALARM",
            *([F.concat(_reminder(), F.lit("END:VEVENT"))] if "reminder" in items.columns else ["END:VEVENT"]),
        ],
    )


def calendar_link(title: Column, deadline: Column, url: Column, provider: Column) -> Column:
    """A link that adds the deadline to a web calendar as an all-day event."""
    days = F.concat(F.date_format(deadline, "yyyyMMdd"), F.lit("/"), F.date_format(F.date_add(deadline, 1), "yyyyMMdd"))
    return F.concat(F.lit("https://calendar.google.com/render?action=TEMPLATE&text="), percent_encoded(title), F.lit("&dates="), days, F.lit("&details="), percent_encoded(url), F.lit("&add="), percent_encoded(provider))
