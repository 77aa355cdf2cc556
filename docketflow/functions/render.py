"""Times and texts of published events, as column expressions."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# The clerk's remarks at the end of an entry, and the hour that a deadline without one falls due.
TRAILERS = r"(?iU)(?:\s*\([^()]*\b(?:COURT STAFF|Date Filed|Entered|text-only entry|no document associated)\b[^()]*\))+\s*$"
DUE_TIME = "16:00"


def _word(c: Column) -> Column:
    """Trimmed; null for blanks and the words null and none."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(~F.lower(t).isin("", "null", "none"), t)


def zone_is_known(zone: Column) -> Column:
    """Whether a zone is one of the time zone database's, region names alone."""
    return F.coalesce(zone.isin(sorted(z for z in available_timezones() if "/" in z or z == "UTC")), F.lit(False))


def safe_zone(zone: Column) -> Column:
    """The zone, or UTC for one that does not exist."""
    return F.when(zone_is_known(zone), zone).otherwise(F.lit("UTC"))


def local_to_utc(date: Column, time: Column, zone: Column) -> Column:
    """The instant of a local date and time; midnight without a (valid) time, null without a valid date, UTC for an unknown zone."""
    zone = safe_zone(zone)
    day, hour = _word(date), _word(time)
    stamp = F.coalesce(F.try_to_timestamp(F.concat(day, F.lit("T"), hour)), F.try_to_timestamp(F.concat(day, F.lit("T00:00"))))
    return F.to_utc_timestamp(stamp, zone)


def deadline_to_utc(date: Column, time: Column, zone: Column) -> Column:
    return local_to_utc(date, F.coalesce(_word(time), F.lit(DUE_TIME)), zone)


def record_text(description: Column, short: Column) -> Column:
    """An entry's own text without the clerk's remarks at its end; null if nothing is left."""
    blank = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    raw = F.coalesce(F.nullif(description, F.lit("")), short)
    return blank(F.regexp_replace(blank(raw), TRAILERS, ""))


def date_tokens(day: Column) -> Column:
    """The five ways an entry writes a date."""
    return F.array(*[F.date_format(day, f) for f in ("M/d/y", "MM/dd/yyyy", "M/d/yy", "MM/dd/yy", "MMMM d, yyyy")])


def untimed(start: Column, now: Column) -> Column:
    """What a title says of an event without a clock time."""
    return F.when(start.isNull() | (start < now), "time unknown").otherwise("time TBD")


def event_title(kind: Column, case: Column, title: Column, start: Column, minutes: Column, now: Column) -> Column:
    """'[KIND] [time ...] case: title', the second part for events without a clock time."""
    flag = F.when(F.coalesce(minutes, F.lit(0)) <= 0, F.concat(F.lit("["), untimed(start, now), F.lit("]")))
    return F.concat_ws(" ", F.concat(F.lit("["), kind, F.lit("]")), flag, F.concat(case, F.lit(": "), title))


def description(notes: Column, tags: Column, judge: Column, dial_in: Column, docket_number: Column, citation: Column, url: Column, base: str, links: Column, numbers: Column, sources: Column) -> Column:
    """The sections of an event's text, those with content, with a blank line between.

    ``links`` are lines of documents; ``numbers`` and ``sources`` arrays of entry numbers and ids.
    """
    full = lambda c: F.nullif(c, F.lit(""))
    listed = lambda a: full(F.array_join(F.transform(a, lambda x: x.cast("string")), ", "))
    tag = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    case = full(F.concat_ws(" ", full(docket_number), F.concat(F.lit("("), full(citation), F.lit(")"))))
    place = F.when(full(url).startswith("http"), url).otherwise(F.concat(F.lit(base), full(url)))
    sections = [
        full(notes),
        F.concat(F.lit("Tags: "), listed(tag)),
        F.concat(F.when(F.contains(judge, F.lit(",")), "Panel: ").otherwise("Judge: "), full(judge)),
        F.concat(F.lit("Dial-in / link:\n"), full(dial_in)),
        F.concat(F.lit("Case: "), case),
        F.concat(F.lit("Docket: "), place),
        F.concat(F.lit("Documents:\n"), full(F.array_join(links, "\n"))),
        F.concat(F.lit("Docket entries: "), listed(numbers)),
        F.concat(F.lit("Entry IDs: "), listed(sources)),
    ]
    return F.array_join(F.array_compact(F.array(*sections)), "\n\n")


def agenda_fields(start: Column, zone: Column, minutes: Column, now: Column) -> Column:
    """month, day, time_label and is_past of an event, in its court's zone (one that exists)."""
    local = F.from_utc_timestamp(start, safe_zone(zone))
    label = F.when(F.coalesce(minutes, F.lit(0)) <= 0, untimed(start, now)).otherwise(F.date_format(local, "h:mm a"))
    return F.struct(F.upper(F.date_format(local, "MMM")).alias("month"), F.date_format(local, "d").alias("day"), label.alias("time_label"), (start < now).alias("is_past"))
