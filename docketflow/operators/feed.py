"""Published events: one shape for hearings and deadlines, agendas, feeds, push plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions.render import safe_zone, zone_is_known
from docketflow.functions.text import event_id


def events(hearings: DataFrame, deadlines: DataFrame) -> DataFrame:
    """(case_id, event_key, title, start_date, status, minutes, all_day): visible hearings and dated deadlines."""
    visible = hearings.where("start_date IS NOT NULL AND NOT (significance <=> 'minor')")
    minutes = F.greatest(F.coalesce("duration_minutes", F.lit(0)), F.lit(0))
    a = visible.select("case_id", F.col("hearing_key").alias("event_key"), "title", "start_date", "status", minutes.alias("minutes"), (minutes <= 0).alias("all_day"))
    status = F.when(F.col("status") == "pending", "scheduled").when(F.col("status") == "passed", "held").when(F.col("status").isin("met", "cancelled"), "cancelled").otherwise("scheduled")
    b = deadlines.where("due_date IS NOT NULL").select(
        "case_id", F.concat(F.lit("deadline:"), "deadline_key").alias("event_key"), "title", F.col("due_date").alias("start_date"), status.alias("status"), F.lit(15).alias("minutes"), F.lit(False).alias("all_day")
    )
    return a.unionByName(b)


def agenda(rows: DataFrame, today: str, past: int = 2, days: int = 14, ahead: int = 6) -> DataFrame:
    """At most ``past`` most recent events of the last ``days`` and the next ``ahead``; later ones are overflow."""
    now = F.lit(today).cast("date")
    rows = rows.where(F.col("status") != "cancelled").withColumn("upcoming", F.col("start_date") >= now)
    rows = rows.where(F.col("upcoming") | (F.col("start_date") >= F.date_sub(now, days)))
    order = Window.partitionBy("case_id", "upcoming").orderBy(F.abs(F.datediff("start_date", now)), "event_key")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("upcoming") | (F.col("place") <= past))
    slot = F.when(~F.col("upcoming"), "past").when(F.col("place") <= ahead, "next").otherwise("overflow")
    return rows.select("case_id", "event_key", "start_date", slot.alias("slot"), "place")


def next_events(rows: DataFrame, today: str) -> DataFrame:
    return rows.where(F.col("status") == "scheduled").groupBy("case_id").agg(F.min(F.when(F.col("start_date") >= F.lit(today).cast("date"), F.col("start_date"))).alias("next_date"), F.count("*").alias("events"))


def push_plan(wanted: DataFrame, published: DataFrame) -> DataFrame:
    """insert / patch / cancel / keep for each event id, from both sides."""
    w = wanted.select(event_id(F.col("case_id"), F.col("event_key")).alias("id"), F.struct("title", "start_date").alias("want"), (F.col("status") != "cancelled").alias("live"))
    p = published.select("id", F.struct("title", "start_date").alias("have"))
    both = w.join(p, "id", "full_outer")
    op = (
        F.when(F.col("have").isNull(), F.when(F.col("live"), "insert").otherwise("none"))
        .when(~F.coalesce("live", F.lit(False)), "cancel").when(F.col("want") == F.col("have"), "keep").otherwise("patch")
    )
    return both.select("id", op.alias("op")).where("op <> 'none'")


def recovered_plan(wanted: DataFrame, published: DataFrame) -> DataFrame:
    """(id, push_id, op) for rows ``wanted(case_id, event_key, title, start_date, status, push_id)`` against ``published(push_id, correlation, title, start_date)``.

    A row is matched by the id it knows, if that is still there, else by its
    correlation key; each published row is taken once (known ids first, then the smallest
    event key), and of several with one correlation key the smallest push_id.
    Live rows are patched (or kept, when nothing differs) where one is matched and inserted otherwise, cancelled rows take
    theirs back.  What no row takes is a duplicate if a wanted row has its correlation key, else an orphan; both are left alone and told.
    """
    w = wanted.select("*", event_id(F.col("case_id"), F.col("event_key")).alias("id"))
    ids = published.select("push_id").distinct()
    known = w.where("push_id IS NOT NULL").join(ids.hint("merge"), "push_id", "left_semi").groupBy("push_id").agg(F.min("id").alias("id"))
    free = published.where("correlation IS NOT NULL").join(known.hint("merge"), "push_id", "left_anti").groupBy(F.col("correlation").alias("id")).agg(F.min("push_id").alias("push_id"))
    later = w.select("id").distinct().join(known.select("id").hint("merge"), "id", "left_anti").join(free.hint("merge"), "id")
    matched = known.select("id", "push_id").unionByName(later.select("id", "push_id"))
    have = published.select("push_id", F.struct("title", "start_date").alias("have"))
    # What is published joins the matches, which all have a push_id: rows without one would meet in one task.
    both = w.drop("push_id").join(matched.join(have.hint("merge"), "push_id", "left").hint("merge"), "id", "left")
    live, there = F.col("status") != "cancelled", F.col("push_id").isNotNull()
    op = F.when(live & ~there, "insert").when(live & (F.struct("title", "start_date") == F.col("have")), "keep").when(live, "patch").when(there, "cancel")
    left = published.join(matched.select("push_id").hint("merge"), "push_id", "left_anti").select("correlation", "push_id")
    ours = w.select(F.col("id").alias("correlation"), F.lit(True).alias("ours")).distinct()
    told = left.where("correlation IS NOT NULL").join(ours.hint("merge"), "correlation", "left").unionByName(left.where("correlation IS NULL").withColumn("ours", F.lit(None).cast("boolean")))
    told = told.select(F.col("correlation").alias("id"), "push_id", F.when(F.col("ours"), "duplicate").otherwise("orphan").alias("op"))
    return both.select("id", "push_id", op.alias("op")).where("op IS NOT NULL").unionByName(told)


def folded(line: Column, octets: int = 75) -> Column:
    """A line in pieces of at most ``octets`` bytes of UTF-8, whole characters, each later piece after a space."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def put(done: Column, c: Column) -> Column:
        more = done["used"] + F.octet_length(c) > octets
        out = F.concat(done["out"], F.when(more, "\r\n ").otherwise(""), c)
        return F.struct(out.alias("out"), (F.when(more, 1).otherwise(done["used"]) + F.octet_length(c)).alias("used"))

    long = F.aggregate(F.split(line, ""), first, put, lambda done: done["out"])
    return F.when(F.octet_length(line) > octets, long).otherwise(line)


def subscribe_links(path: Column, base: Column) -> Column:
    """webcal, https and relative links of a feed file; the first two are null without a base url, all without a file."""
    name = F.nullif(F.regexp_extract(path, "([^/]+)/*$", 1), F.lit(""))
    root = F.nullif(F.regexp_replace(base, "/+$", ""), F.lit(""))
    host = F.regexp_replace(root, "^https?://", "")
    return F.struct(F.concat(F.lit("webcal://"), host, F.lit("/"), name).alias("webcal"), F.concat(root, F.lit("/"), name).alias("https"), name.alias("relative"))


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _line(name: str, value: Column) -> Column:
    """A folded line; none for a missing value."""
    return F.when(F.coalesce(value, F.lit("")) != "", folded(F.concat(F.lit(name), value)))


def vevents(rows: DataFrame, stamp: str = "19700101T000000Z") -> DataFrame:
    """(case_id, event_key, start_date, block): one escaped and folded text block an event.

    ``rows(case_id, event_key, title, start_date, minutes, ...)`` with optional
    ``start_hour``, ``timezone``, ``location``, ``description``, ``notify_emails`` and
    ``reminders`` (structs method, minutes).  Events of some minutes have a clock
    time in their zone (in UTC if that does not exist), others last the day and
    leave it free; reminders of no minutes are left out; a cancelled event has no block.
    """
    optional = {"start_hour": "int", "timezone": "string", "location": "string", "description": "string", "notify_emails": "array<string>", "reminders": "array<struct<method:string,minutes:int>>"}
    for c, kind in optional.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    zone, timed = F.coalesce("timezone", F.lit("America/New_York")), F.coalesce(F.col("minutes"), F.lit(0)) > 0
    local = F.col("start_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.coalesce("start_hour", F.lit(0)))
    start = F.to_utc_timestamp(local, safe_zone(zone))
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes").cast("int"))
    text = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    here = lambda t: F.when(zone_is_known(zone), F.concat(F.lit(";TZID="), zone, F.lit(":"), text(F.from_utc_timestamp(t, safe_zone(zone))))).otherwise(F.concat(F.lit(":"), text(t), F.lit("Z")))
    day = lambda d: F.concat(F.lit(";VALUE=DATE:"), F.date_format(d, "yyyyMMdd"))
    title = _escaped(F.col("title"))
    emails = F.coalesce("notify_emails", F.array().cast("array<string>"))

    def alarm(r: Column) -> Column:
        mail = F.lower(F.coalesce(r["method"], F.lit("popup"))) == "email"
        head = F.array(F.lit("BEGIN:VALARM"), F.concat(F.lit("TRIGGER:-PT"), r["minutes"].cast("string"), F.lit("M")), F.when(mail, "ACTION:EMAIL").otherwise("ACTION:DISPLAY"), _line("DESCRIPTION:", title))
        more = F.when(mail, F.concat(F.array(_line("SUMMARY:Reminder: ", title)), F.transform(emails, lambda m: _line("ATTENDEE:mailto:", m)))).otherwise(F.array().cast("array<string>"))
        return F.concat(head, more, F.array(F.lit("END:VALARM")))

    alarms = F.flatten(F.transform(F.filter(F.coalesce("reminders", F.array().cast(optional["reminders"])), lambda r: F.coalesce(r["minutes"], F.lit(0)) > 0), alarm))
    lines = F.concat(
        F.array(
            F.lit("BEGIN:VEVENT"), _line("UID:", F.concat(event_id(F.col("case_id"), F.col("event_key")), F.lit("@docketflow"))), F.lit(f"DTSTAMP:{stamp}"),
            _line("SUMMARY:", title), _line("LOCATION:", _escaped(F.col("location"))), _line("DESCRIPTION:", _escaped(F.col("description"))),
            F.concat(F.lit("DTSTART"), F.when(timed, here(start)).otherwise(day("start_date"))), F.concat(F.lit("DTEND"), F.when(timed, here(end)).otherwise(day(F.date_add("start_date", 1)))),
            F.lit("STATUS:CONFIRMED"), F.when(~timed, "TRANSP:TRANSPARENT"),
        ),
        F.transform(emails, lambda m: _line("ATTENDEE;RSVP=TRUE:mailto:", m)),
        alarms,
        F.array(F.lit("END:VEVENT")),
    )
    return rows.where("status <> 'cancelled'").select("case_id", "event_key", "start_date", F.array_join(F.array_compact(lines), "\r\n").alias("block"))


def write_feed(rows: DataFrame, path: str, calendar: str = "case_id") -> None:
    """One folder of text for each calendar, its blocks in order."""
    ordered = F.array_sort(F.collect_list(F.struct("start_date", "event_key", "block")))
    text = vevents(rows).groupBy(calendar).agg(F.array_join(F.transform(ordered, lambda s: s["block"]), "\r\n").alias("value"))
    text.write.mode("overwrite").partitionBy(calendar).text(path)
