"""Queries over the times and texts of published events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import render
from docketflow.operators import context
from docketflow.plans.register import Register
from docketflow.sources.adapter import _day, _slashes

query = Register()
QUERIES, ORACLE = query.queries, query.oracle

_DAY = "(CASE WHEN docket_id % 11 = 0 THEN NULL ELSE start_date END)"
_ZONED = f"(SELECT h.case_id, h.docket_id, h.title, h.start_date, h.start_hour, h.duration_minutes, coalesce(timezone, 'America/New_York') AS tz, {_DAY.replace('docket_id', 'h.docket_id')} AS d, citation, docket_number FROM hearings_v h JOIN dockets_v x ON x.docket_id = h.docket_id LEFT JOIN courts_v c ON c.court_id = x.court_id) z"


def _zoned(h, d, c):
    return h.join(context.with_court(d.select("docket_id", "court_id", "docket_number"), c), "docket_id")


def _local(h):
    """A date as text (a bad one every eleventh time) and an hour, 'null' or nonsense."""
    day = F.when(F.col("docket_id") % 11 == 0, "2023-03-34").otherwise(F.col("start_date").cast("string"))
    hour = F.when(F.col("docket_id") % 3 == 0, F.concat(F.lpad(F.col("start_hour").cast("string"), 2, "0"), F.lit(":30"))).when(F.col("docket_id") % 3 == 1, "null").otherwise("noonish")
    return day, hour


_AT = "CASE WHEN docket_id % 3 = 0 THEN to_hours(start_hour) + to_minutes(30) WHEN docket_id % 3 = 1 THEN to_hours({0}) ELSE to_hours(0) END"


@query("hearings_v dockets_v courts_v", f"SELECT docket_id, epoch_us((cast(d AS timestamp) + {_AT.format(0)}) AT TIME ZONE tz) AS starts_us, epoch_us((cast(d AS timestamp) + {_AT.format(16)}) AT TIME ZONE tz) AS due_us FROM {_ZONED}")
def court_times(h, d, c):
    """Instants of local dates and times, good and bad, as a hearing and as a deadline."""
    day, hour = _local(h)
    zone = F.col("timezone")
    rows = _zoned(h, d, c)
    return rows.select("docket_id", F.unix_micros(render.local_to_utc(day, hour, zone)).alias("starts_us"), F.unix_micros(render.deadline_to_utc(day, hour, zone)).alias("due_us"))


@query("hearings_v dockets_v courts_v", "SELECT docket_id, strftime(l, '%b').upper() AS month, cast(day(l) AS string) AS day, CASE WHEN coalesce(duration_minutes, 0) <= 0 THEN CASE WHEN u < TIMESTAMP '1996-06-15' THEN 'time unknown' ELSE 'time TBD' END ELSE ltrim(strftime(l, '%I:%M %p'), '0') END AS time_label, u < TIMESTAMP '1996-06-15' AS is_past, "
    "'[HEARING] ' || CASE WHEN coalesce(duration_minutes, 0) > 0 THEN '' WHEN u < TIMESTAMP '1996-06-15' THEN '[time unknown] ' ELSE '[time TBD] ' END || case_id || ': ' || title AS title "
    f"FROM (SELECT *, cast(start_date AS timestamp) + to_hours(start_hour) AS u, ((cast(start_date AS timestamp) + to_hours(start_hour)) AT TIME ZONE 'UTC') AT TIME ZONE tz AS l FROM {_ZONED}) s")
def agenda_rows(h, d, c):
    start = F.timestamp_add("HOUR", F.col("start_hour"), F.col("start_date").cast("timestamp"))
    now = F.lit("1996-06-15").cast("timestamp")
    rows = _zoned(h, d, c).withColumn("start", start)
    fields = render.agenda_fields(F.col("start"), F.col("timezone"), F.col("duration_minutes"), now)
    title = render.event_title(F.lit("HEARING"), F.col("case_id"), F.col("title"), F.col("start"), F.col("duration_minutes"), now)
    return rows.select("docket_id", fields.alias("f"), title.alias("title")).select("docket_id", "f.*", "title")


@query("hearings_v dockets_v courts_v", "SELECT docket_id, notes || CASE WHEN docket_id % 2 = 0 THEN chr(10) || chr(10) || 'Tags: a, b' ELSE '' END || chr(10) || chr(10) || CASE WHEN docket_id % 3 = 0 THEN 'Panel: A, B' ELSE 'Judge: A' END || chr(10) || chr(10) || 'Case: ' || docket_number || coalesce(' (' || citation || ')', '') || chr(10) || chr(10) || 'Docket: https://court.example/d/' || cast(docket_id AS string) || "
    "chr(10) || chr(10) || 'Entry IDs: ' || cast(docket_id AS string) || ', 7' AS text FROM (SELECT z.*, notes FROM " + _ZONED + " JOIN (SELECT docket_id, notes FROM hearings_v) n USING (docket_id)) s")
def event_descriptions(h, d, c):
    odd = F.col("docket_id") % 2 == 1
    text = render.description(
        F.col("notes"), F.when(~odd, F.array(F.lit(" a"), F.lit(" "), F.lit("b"))), F.when(F.col("docket_id") % 3 == 0, "A, B").otherwise("A"), F.lit(""), F.col("docket_number"), F.col("citation"),
        F.concat(F.lit("/d/"), F.col("docket_id").cast("string")), "https://court.example", F.array().cast("array<string>"), F.array().cast("array<bigint>"), F.array(F.col("docket_id"), F.lit(7)),
    )
    return _zoned(h, d, c).select("docket_id", text.alias("text"))


@query("entries_v", "SELECT entry_id, nullif(trim(regexp_replace(trim(coalesce(nullif(description, ''), short_description)), ' *[(][^()]*Entered[^()]*[)] *$', '')), '') AS record FROM entries_v")
def record_texts(e):
    """Entries with stacked remarks of the clerk at their end, without them."""
    more = F.when(F.col("entry_id") % 2 == 0, F.concat("description", F.lit(" (afm, COURT STAFF) (Date Filed: 3/24/2024)  "))).otherwise(F.col("description"))
    return e.select("entry_id", render.record_text(F.when(F.col("description") == "", "").otherwise(more), F.col("short_description")).alias("record"))


_M, _D, _Y = (f"{f}(start_date)" for f in ("month", "day", "year"))
_PAD = "lpad(cast({0} AS string), 2, '0')"


@query("hearings_v", f"SELECT docket_id, {_slashes('start_date')} || '|' || {_PAD.format(_M)} || '/' || {_PAD.format(_D)} || '/' || cast({_Y} AS string) || '|' || cast({_M} AS string) || '/' || cast({_D} AS string) || '/' || right(cast({_Y} AS string), 2) || '|' || {_PAD.format(_M)} || '/' || {_PAD.format(_D)} || '/' || right(cast({_Y} AS string), 2) || '|' || {_day('start_date')} AS tokens FROM hearings_v")
def date_tokens(h):
    return h.select("docket_id", F.array_join(render.date_tokens(F.col("start_date")), "|").alias("tokens"))
