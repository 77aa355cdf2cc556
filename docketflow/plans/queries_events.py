"""Queries over actions, hearings and deadlines: folds, sweeps, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.functions import render
from docketflow.functions import text as T
from docketflow.operators import context, feed, folds, sweeps
from docketflow.operators.state import replayed
from docketflow.plans.register import Register
from docketflow.sources.adapter import view, with_views

query = Register()
QUERIES, ORACLE = query.queries, query.oracle
TODAY = "1998-06-15"
AGENDA_DAY = "2024-02-01"


def as_steps(a: DataFrame) -> DataFrame:
    """Actions as the hearing fold takes them."""
    text = render.record_text(F.col("entry_text"), F.lit(None).cast("string"))
    marks = [F.struct("entry_date", "event_id").alias("seq"), F.col("event_id").alias("entry_id"), T.key_title(F.col("hearing_key")).alias("fallback_title"), text.alias("record_text"), T.records_proceeding(F.col("entry_text")).alias("is_record")]
    return a.select("*", *marks)


def as_deadline_steps(a: DataFrame) -> DataFrame:
    """The same actions on deadline keys."""
    key = F.regexp_replace("hearing_key", "^h-", "d-")
    rows = a.select("*", F.struct("entry_date", "event_id").alias("seq"), F.col("event_id").alias("entry_id"), key.alias("deadline_key"), T.key_title(key).alias("fallback_title"))
    return rows.withColumn("type", folds.repaired_type(F.col("type"), F.col("deadline_key")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events folded to hearings, and the agenda of every case in the middle of them."""
    state = folds.fold_hearings(as_steps(view(spark, sf_dir, "actions_v")), ["title", "local_date", "status", "significance"])
    rows = state.where("local_date IS NOT NULL AND NOT (significance <=> 'minor')")
    rows = rows.select("case_id", F.col("hearing_key").alias("event_key"), "title", F.col("local_date").alias("start_date"), "status")
    return feed.agenda(rows, AGENDA_DAY)


def _recursive(kinds: dict[str, str], key: str, drop: str, fields: dict[str, str]) -> str:
    """A recursive query over the numbered actions of each key; ``f`` is the state, ``a`` the action."""
    none = ", ".join(f"cast(NULL AS {t}) AS {c}" for c, t in kinds.items())
    step = ", ".join(f"CASE WHEN {drop} THEN f.{c} ELSE {fields[c]} END" for c in kinds)
    return (
        f"(WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY case_id, hearing_key ORDER BY entry_date, event_id) AS i FROM actions_v), "
        f"f AS (SELECT case_id, hearing_key, cast(0 AS bigint) AS i, cast(0 AS bigint) AS n, cast([] AS bigint[]) AS sources, {none} FROM (SELECT DISTINCT case_id, hearing_key FROM a) k "
        f"UNION ALL SELECT a.case_id, a.hearing_key, a.i, CASE WHEN {drop} THEN f.n ELSE f.n + 1 END, CASE WHEN {drop} THEN f.sources ELSE list_append(f.sources, a.event_id) END, {step} "
        f"FROM f JOIN a ON a.case_id = f.case_id AND a.hearing_key = f.hearing_key AND a.i = f.i + 1) "
        f"SELECT f.* EXCLUDE (i, hearing_key), {key} AS key FROM f JOIN (SELECT case_id, hearing_key, max(i) AS i FROM a GROUP BY ALL) z USING (case_id, hearing_key, i) WHERE n > 0)"
    )


_RECORD = "regexp_matches({0}, '" + T.RECORD.replace("(?i)", "").replace("'", "''") + "', 'i')"
_FOREIGN = "(f.n > 0 AND coalesce(f.docket_id <> a.docket_id AND f.court_id <> a.court_id, false))"
_HOME = {c: f"CASE WHEN f.n = 0 THEN a.{c} ELSE f.{c} END" for c in ("timezone", "docket_id", "court_id")}
_KEY_TITLE = "upper(left({0}, 1)) || replace(substr({0}, 2), '-', ' ')"  # of keys like h-3-2
_KEEPS = "(f.n > 0 AND a.type IN ('CANCEL_HEARING', 'MARK_HELD'))"
_DEFAULT = "CASE WHEN a.local_hour IS NULL THEN 0 ELSE coalesce(CASE a.hearing_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in folds.DURATIONS.items()) + " END, 60) END"
HEARING_ROWS = _recursive(
    {
        "status": "varchar", "local_date": "date", "local_hour": "int", "significance": "varchar", "duration_minutes": "int", "location": "varchar", "judge": "varchar", "dial_in": "varchar",
        "title": "varchar", "notes": "varchar", "timezone": "varchar", "docket_id": "bigint", "court_id": "varchar",
    },
    "hearing_key",
    "((a.type = 'ADD_HEARING' AND a.local_date IS NULL) OR (a.type IN ('CANCEL_HEARING', 'MARK_HELD') AND f.n = 0 AND a.local_date IS NULL) OR "
    f"(a.type = 'MARK_HELD' AND f.n > 0 AND coalesce(abs(date_diff('day', a.local_date, f.local_date)) > 2, false)) OR {_FOREIGN})",
    {
        "status": "CASE a.type WHEN 'CANCEL_HEARING' THEN 'cancelled' WHEN 'MARK_HELD' THEN 'held' ELSE 'scheduled' END",
        "local_date": f"CASE WHEN {_KEEPS} THEN f.local_date ELSE coalesce(a.local_date, f.local_date) END",
        "local_hour": f"CASE WHEN {_KEEPS} OR a.local_date IS NULL THEN f.local_hour ELSE a.local_hour END",
        "significance": f"CASE WHEN {_KEEPS} THEN f.significance WHEN a.type IN ('CANCEL_HEARING', 'MARK_HELD') THEN coalesce(a.significance, 'major') ELSE coalesce(a.significance, f.significance) END",
        "duration_minutes": f"CASE WHEN {_KEEPS} THEN f.duration_minutes ELSE coalesce(nullif(a.duration_minutes, 0), CASE WHEN a.type <> 'RESCHEDULE_HEARING' THEN nullif(f.duration_minutes, 0) END, {_DEFAULT}) END",
        **{c: f"CASE WHEN {_KEEPS} THEN f.{c} ELSE coalesce(a.{c}, f.{c}) END" for c in ("location", "judge", "dial_in")},
        "title": f"CASE WHEN {_KEEPS} THEN f.title ELSE coalesce(nullif(a.title, ''), CASE WHEN f.n > 0 THEN f.title ELSE {_KEY_TITLE.format('a.hearing_key')} END) END",
        "notes": f"CASE WHEN {_KEEPS} AND a.type = 'MARK_HELD' THEN CASE WHEN {_RECORD.format('a.entry_text')} AND NOT coalesce({_RECORD.format('f.notes')}, false) THEN coalesce(nullif(a.notes, ''), a.entry_text) ELSE f.notes END ELSE coalesce(nullif(a.notes, ''), f.notes) END",
        **_HOME,
    },
)
_ENDS = "(f.n > 0 AND a.type IN ('CANCEL_HEARING', 'MARK_HELD'))"
_CLEARED = "(a.type = 'ADD_HEARING' AND a.conditional AND a.local_date IS NULL)"
DEADLINE_ROWS = _recursive(
    {
        "status": "varchar", "due_date": "date", "due_hour": "int", "significance": "varchar", "deadline_type": "varchar",
        "title": "varchar", "notes": "varchar", "timezone": "varchar", "docket_id": "bigint", "court_id": "varchar",
    },
    "'d-' || substr(hearing_key, 3)",
    f"((a.type = 'ADD_HEARING' AND a.local_date IS NULL AND NOT a.conditional) OR (a.type = 'MARK_HELD' AND f.n = 0) OR (a.type = 'CANCEL_HEARING' AND f.n = 0 AND a.local_date IS NULL) OR {_FOREIGN})",
    {
        "status": "CASE a.type WHEN 'CANCEL_HEARING' THEN 'cancelled' WHEN 'MARK_HELD' THEN 'met' ELSE 'pending' END",
        "due_date": f"CASE WHEN {_ENDS} THEN f.due_date WHEN {_CLEARED} THEN NULL ELSE coalesce(a.local_date, f.due_date) END",
        "due_hour": f"CASE WHEN {_ENDS} THEN f.due_hour WHEN {_CLEARED} THEN NULL WHEN a.local_date IS NOT NULL THEN a.local_hour ELSE f.due_hour END",
        "significance": f"CASE WHEN {_ENDS} THEN f.significance WHEN a.type = 'CANCEL_HEARING' THEN coalesce(a.significance, 'major') ELSE coalesce(a.significance, f.significance) END",
        "deadline_type": f"CASE WHEN {_ENDS} THEN f.deadline_type ELSE coalesce(a.deadline_type, f.deadline_type) END",
        "title": f"CASE WHEN {_ENDS} THEN f.title ELSE coalesce(nullif(a.title, ''), CASE WHEN f.n > 0 THEN f.title ELSE {_KEY_TITLE.format("'d-' || substr(a.hearing_key, 3)")} END) END",
        "notes": "CASE WHEN a.type = 'MARK_HELD' THEN f.notes ELSE coalesce(nullif(a.notes, ''), f.notes) END",
        **_HOME,
    },
)
_HEARING_COLUMNS = "status, local_hour, significance, duration_minutes, location, judge, dial_in, title, notes, timezone, docket_id"
_INSTANT = "epoch_us((cast({0} AS timestamp) + to_hours(coalesce({1}, {2}))) AT TIME ZONE timezone)"


def _instant(date: str, hour: str, missing: int):
    stamp = F.to_timestamp(F.concat(F.col(date).cast("string"), F.lit(" "), F.lpad(F.coalesce(hour, F.lit(missing)).cast("string"), 2, "0"), F.lit(":00:00")))
    return F.unix_micros(F.to_utc_timestamp(stamp, F.col("timezone")))


@query("actions_v", f"SELECT case_id, key AS hearing_key, cast(local_date AS string) AS local_date, {_HEARING_COLUMNS}, {_INSTANT.format('local_date', 'local_hour', 0)} AS starts_us, array_to_string(sources, ',') AS sources FROM {HEARING_ROWS} s")
def hearing_fold(a):
    """Whole hearing rows: state, texts, length, zone, instant and lineage."""
    rows = folds.fold_hearings(as_steps(a))
    sources = F.array_join(F.col("source_entry_ids").cast("array<string>"), ",").alias("sources")
    return rows.select("case_id", "hearing_key", F.col("local_date").cast("string").alias("local_date"), *_HEARING_COLUMNS.split(", "), _instant("local_date", "local_hour", 0).alias("starts_us"), sources)


@query("actions_v", f"SELECT case_id, key AS deadline_key, cast(due_date AS string) AS due_date, status, significance, deadline_type, title, notes, timezone, docket_id, {_INSTANT.format('due_date', 'due_hour', 16)} AS due_us, array_to_string(sources, ',') AS sources FROM {DEADLINE_ROWS} s")
def deadline_fold(a):
    """Whole deadline rows; without an hour they fall due at 16:00 of their zone."""
    rows = folds.fold_deadlines(as_deadline_steps(a))
    sources = F.array_join(F.col("source_entry_ids").cast("array<string>"), ",").alias("sources")
    return rows.select("case_id", "deadline_key", F.col("due_date").cast("string").alias("due_date"), "status", "significance", "deadline_type", "title", "notes", "timezone", "docket_id", _instant("due_date", "due_hour", 16).alias("due_us"), sources)


@query("actions_v", f"SELECT case_id, key AS hearing_key, status FROM {HEARING_ROWS} s")
def hearing_fold_last_status(a):
    return folds.fold_hearings(as_steps(a), ["status"])


@query("actions_v", f"SELECT case_id, key AS hearing_key, cast(len(sources) AS bigint) AS sources, docket_id FROM {HEARING_ROWS} s")
def hearing_fold_lineage(a):
    """The sticky docket and the growing lineage of the fold."""
    return folds.fold_hearings(as_steps(a), ["source_entry_ids", "docket_id"]).select("case_id", "hearing_key", F.size("source_entry_ids").cast("long").alias("sources"), "docket_id")


@query("actions_v dockets_v", f"SELECT case_id, key AS hearing_key, status FROM {HEARING_ROWS} s WHERE case_id IN (SELECT case_id FROM dockets_v) UNION ALL SELECT DISTINCT case_id, hearing_key, 'stored' FROM actions_v WHERE case_id NOT IN (SELECT case_id FROM dockets_v)")
def replay(a, d):
    """Rows of the configured cases rebuilt from their whole history; other rows stay as they were."""
    stored = a.select("case_id", "hearing_key").distinct().withColumn("status", F.lit("stored"))
    return replayed(stored, as_steps(a), d.select("case_id").distinct())




def agenda_from_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).withColumn("start_date", F.col("start_date").cast("string"))


QUERIES["agenda_from_actions"] = agenda_from_actions
ORACLE["agenda_from_actions"] = with_views(
    "actions_v",
    f"SELECT case_id, event_key, cast(start_date AS string) AS start_date, CASE WHEN NOT upcoming THEN 'past' WHEN place <= 6 THEN 'next' ELSE 'overflow' END AS slot, place FROM (SELECT *, row_number() OVER (PARTITION BY case_id, upcoming ORDER BY abs(start_date - DATE '{AGENDA_DAY}'), event_key) AS place FROM "
    f"(SELECT case_id, key AS event_key, title, local_date AS start_date, status, local_date >= DATE '{AGENDA_DAY}' AS upcoming FROM {HEARING_ROWS} s WHERE local_date IS NOT NULL AND significance IS DISTINCT FROM 'minor' AND status <> 'cancelled' AND local_date >= DATE '{AGENDA_DAY}' - 14) f) g WHERE upcoming OR place <= 2",
)

@query("hearings_v dockets_v", "SELECT case_id, hearing_key, docket_number, cast(start_date AS string) AS start_date, size FROM (SELECT h.status || cast(h.docket_id % 9 AS string) AS case_id, h.hearing_key, d.court_id AS docket_number, h.start_date, count(*) OVER (PARTITION BY h.docket_id % 9, d.court_id, h.start_date, h.start_hour) AS size FROM hearings_v h LEFT JOIN dockets_v d USING (docket_id) WHERE h.status = 'held') x WHERE size > 1")
def same_slot_clusters(h, d):
    """Clusters over wider cases and dockets (nine cases, a docket a court), so that slots do meet."""
    wide = h.withColumn("case_id", F.concat("status", (F.col("docket_id") % 9).cast("string")))
    return sweeps.same_slot(wide, d.withColumn("docket_number", F.col("court_id")), "held").select("case_id", "hearing_key", "docket_number", F.col("start_date").cast("string").alias("start_date"), "size")


# Eight cases, a logical docket a court and a day a month, so that slots do meet; every seventh docket has no metadata.
_WIDE = "SELECT h.hearing_key, h.docket_id, cast(date_trunc('month', h.start_date) AS date) AS start_date, h.start_hour, 'c' || cast(h.docket_id % 8 AS string) AS case_id, CASE WHEN h.docket_id % 7 = 0 THEN '#docket-id=' || cast(h.docket_id AS string) ELSE d.court_id END AS slot FROM hearings_v h JOIN dockets_v d USING (docket_id) WHERE h.status = 'held'"


def _wide(h, d):
    rows = h.withColumn("case_id", F.concat(F.lit("c"), (F.col("docket_id") % 8).cast("string"))).withColumn("start_date", F.trunc("start_date", "month"))
    return rows, d.where("docket_id % 7 <> 0").withColumn("docket_number", F.col("court_id"))


@query("hearings_v dockets_v", f"SELECT case_id, slot AS docket_number, cast(start_date AS string) AS start_date, count(DISTINCT start_hour) AS starts, string_agg(hearing_key, ',' ORDER BY hearing_key) AS keys FROM ({_WIDE}) w GROUP BY case_id, slot, start_date HAVING count(DISTINCT start_hour) > 1")
def near_slot_clusters(h, d):
    return sweeps.near_slot(*_wide(h, d), "held").select("case_id", "docket_number", F.col("start_date").cast("string").alias("start_date"), "starts", F.array_join("keys", ",").alias("keys"))


@query("hearings_v dockets_v", f"SELECT case_id, hearing_key, cast(start_date AS string) AS start_date, size FROM (SELECT *, count(*) OVER (PARTITION BY case_id, slot, start_date, start_hour) AS size FROM ({_WIDE.replace("'held'", "'scheduled'")}) w WHERE start_date >= DATE '{TODAY}') x WHERE size > 1")
def future_slot_clusters(h, d):
    """Scheduled rows at one slot, from today on."""
    return sweeps.same_slot(*_wide(h, d), "scheduled", TODAY).select("case_id", "hearing_key", F.col("start_date").cast("string").alias("start_date"), "size")


_KIND = "CASE docket_id % 5 WHEN 0 THEN 'sentencing' WHEN 1 THEN 'arraignment' WHEN 2 THEN 'change-of-plea' WHEN 3 THEN 'plea' ELSE 'status-conference' END"
_PERSON = f"{_KIND} || '-n' || cast(docket_id % 9 AS string)"
_ONCE = f"SELECT *, {_KIND} AS kind, 'n' || cast(docket_id % 9 AS string) AS person, {_PERSON} || '-' || cast(docket_id AS string) AS key FROM ({_WIDE}) w"


@query("hearings_v dockets_v", f"SELECT case_id, slot AS docket_number, kind || '|' || person AS base, count(*) AS size, string_agg(key, ',' ORDER BY key) AS keys FROM ({_ONCE}) h WHERE kind <> 'status-conference' AND (case_id, slot, start_date) NOT IN (SELECT (case_id, slot, start_date) FROM ({_ONCE}) t GROUP BY case_id, slot, start_date HAVING count(DISTINCT start_hour) > 1) GROUP BY case_id, slot, kind, person HAVING count(*) > 1")
def once_only_clusters(h, d):
    """Second tier of near-slot clusters, over keys of five kinds and nine persons, each ended by its docket."""
    rows, dockets = _wide(h.withColumn("hearing_key", F.expr(f"{_PERSON} || '-' || cast(docket_id AS string)")), d)
    found = sweeps.once_only_clusters(rows, dockets, sweeps.near_slot(rows, dockets, "held"))
    return found.select("case_id", "docket_number", "base", "size", F.array_join("keys", ",").alias("keys"))


# Rows in groups of eight dockets, a group a case; three keys of a group differ in their number alone.
_GROUP_ROWS = [
    "'c' || cast(cast(floor(docket_id / 8) AS bigint) AS string) AS case_id", "docket_id", "docket_id % 8 AS pos", "status", "start_date AS last_updated",
    "'sentencing-n' || cast(cast(floor(docket_id % 8 / 3) AS bigint) AS string) || CASE docket_id % 8 % 3 WHEN 1 THEN '-2' WHEN 2 THEN '-3' ELSE '' END AS key",
    "CASE docket_id % 4 WHEN 0 THEN 'MINUTE ENTRY held before the judge ' || cast(docket_id % 7 AS string) WHEN 1 THEN 'TRANSCRIPT of proceedings held on some day of that month' WHEN 2 THEN 'Notice of zoom access, and more text than any of the others have' END AS notes",
    "CASE WHEN docket_id % 3 = 0 THEN 'Sentencing N' ELSE 'Hearing ' || cast(docket_id % 50 AS string) END AS title", "docket_id % 3 = 0 AS derived", "CASE WHEN docket_id % 11 = 0 THEN '[verify-pass] seen' END AS audit_notes",
]
_GROUPED = f"SELECT {', '.join(_GROUP_ROWS)}, range(docket_id, docket_id + docket_id % 3 + 1) AS src FROM hearings_v"
_RECORDS = _RECORD.format("notes")
_MERGED = (
    "array_to_string(list_sort(list_distinct(flatten(list(src)))), ',') AS sources, "
    f"CASE WHEN bool_or(own AND coalesce({_RECORDS}, false)) THEN max(CASE WHEN own THEN notes END) ELSE coalesce(arg_min(notes, (CASE WHEN starts_with(notes, 'TRANSCRIPT') THEN 1 ELSE 0 END, -length(notes), key)) FILTER (NOT own AND {_RECORDS}), max(CASE WHEN own THEN notes END)) END AS notes, "
    "CASE WHEN bool_or(own AND derived) THEN coalesce(arg_min(title, (-length(title), key)) FILTER (NOT own AND NOT derived), max(CASE WHEN own THEN title END)) ELSE max(CASE WHEN own THEN title END) END AS title, "
)


def _groups(h):
    return h.selectExpr(*_GROUP_ROWS, "sequence(docket_id, docket_id + docket_id % 3) AS source_entry_ids")


def _sources_text():
    return F.array_join(F.array_sort("source_entry_ids").cast("array<string>"), ",").alias("sources")


@query(
    "hearings_v",
    f"SELECT case_id, max(CASE WHEN own THEN key END) AS survivor, {_MERGED} CASE WHEN count(*) > 1 THEN concat_ws(chr(10) || chr(10), max(CASE WHEN own THEN audit_notes END), '[dedupe-held] Absorbed sibling key(s) ' || string_agg(key, ', ' ORDER BY r) FILTER (NOT own) || ' at same UTC slot ' || case_id) ELSE max(audit_notes) END AS audit_notes FROM "
    f"(SELECT *, r = 1 AS own FROM (SELECT m.*, row_number() OVER (PARTITION BY m.case_id ORDER BY CASE WHEN key = canon THEN 0 ELSE 1 END, -len(src), last_updated, key) AS r FROM ({_GROUPED} WHERE status = 'held') m LEFT JOIN "
    f"(SELECT b.case_id, arg_min(b.key, (length(b.key), b.key)) AS canon FROM ({_GROUPED} WHERE status = 'held') b JOIN ({_GROUPED} WHERE status = 'held') o ON o.case_id = b.case_id AND o.key <> b.key AND regexp_replace(o.key, '-[0-9]+$', '') = b.key GROUP BY b.case_id) c USING (case_id)) x) y GROUP BY case_id",
)
def held_survivor(h):
    """Held rows of one slot (here a group of dockets) merged: survivor, lineage, notes, title and audit line."""
    out = sweeps.merged_clusters(_groups(h).where("status = 'held'"), ["case_id"], "key", "dedupe-held", F.concat(F.lit(" at same UTC slot "), F.col("case_id")))
    return out.select("case_id", "survivor", _sources_text(), "notes", "title", "audit_notes")


_TARGETS = "SELECT *, CASE pos WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 5 THEN 4 ELSE pos END AS root FROM"


@query(
    "hearings_v",
    f"SELECT case_id, home AS key, max(CASE WHEN own THEN docket_id END) AS docket_id, {_MERGED} CASE WHEN count(*) > 1 THEN concat_ws(chr(10) || chr(10), max(CASE WHEN own THEN audit_notes END), '[dedupe] Absorbed sibling key(s) ' || string_agg(key, ', ' ORDER BY docket_id) FILTER (NOT own) || ': Duplicate of ' || home) ELSE max(audit_notes) END AS audit_notes FROM "
    f"(SELECT t.*, coalesce(x.key, t.key) AS home, t.key = coalesce(x.key, t.key) AS own FROM ({_TARGETS} ({_GROUPED}) a) t LEFT JOIN ({_GROUPED}) x ON x.case_id = t.case_id AND x.pos = t.root) y GROUP BY case_id, home",
)
def merged_hearings(h):
    """All rows after the verdicts of a near-slot sweep: a chain of two, two keys that name each other, a key that is not there."""
    rows = _groups(h)
    n = lambda i: f"'sentencing-n{i // 3}{('', '-2', '-3')[i % 3]}'"
    links = ", ".join(f"struct({n(a)} AS key, {n(b)} AS target)" for a, b in ((1, 0), (2, 1), (4, 5), (5, 4))) + f", struct({n(7)} AS key, 'gone' AS target)"
    plan = rows.select("case_id").distinct().select("case_id", F.expr(f"inline(array({links}))"))
    return sweeps.merged_rows(rows, plan, "key", "dedupe").select("case_id", "key", "docket_id", _sources_text(), "notes", "title", "audit_notes")


@query("actions_v", "SELECT a.case_id, arg_min(b, (length(b), b)) AS canonical FROM (SELECT DISTINCT case_id, hearing_key FROM actions_v) a JOIN (SELECT DISTINCT case_id, regexp_replace(hearing_key, '-2$', '') AS b FROM actions_v WHERE hearing_key LIKE 'h-%-2') c ON a.case_id = c.case_id AND a.hearing_key = c.b GROUP BY a.case_id")
def drift_keys(a):
    clusters = a.groupBy("case_id").agg(F.collect_set("hearing_key").alias("keys"))
    return sweeps.canonical_keys(clusters).where("canonical IS NOT NULL").select("case_id", "canonical")


@query("deadlines_v", f"SELECT case_id, deadline_key, CASE WHEN status = 'pending' AND due_date < DATE '{TODAY}' THEN 'passed' ELSE status END AS status FROM deadlines_v")
def past_due(d):
    return sweeps.past_due(d, TODAY).select("case_id", "deadline_key", "status")


@query("dockets_v summaries_v", "SELECT DISTINCT d.docket_number, d.court_id FROM dockets_v d LEFT JOIN summaries_v s ON s.docket_number = d.docket_number AND s.court_id = d.court_id WHERE coalesce(s.stale, true)")
def needs_summary(d, s):
    return sweeps.needs_summary(d, s)


def _moved(h):
    old = h.where("docket_id % 7 <> 0").withColumn("status", F.when(F.col("docket_id") % 5 == 0, "held").otherwise(F.col("status")))
    return old.withColumn("start_date", F.when(F.col("docket_id") % 11 == 0, F.date_add("start_date", 1)).otherwise(F.col("start_date")))


_CHANGE = "CASE WHEN docket_id % 7 = 0 THEN 'new' WHEN docket_id % 5 = 0 AND status <> 'held' THEN 'status' WHEN docket_id % 11 = 0 THEN 'start' END"


@query("hearings_v", f"SELECT case_id, hearing_key, {_CHANGE} AS change FROM hearings_v WHERE {_CHANGE} IS NOT NULL")
def posture_changes(h):
    return sweeps.posture_changes(_moved(h), h, ["case_id", "hearing_key"]).select("case_id", "hearing_key", "change")


@query("hearings_v dockets_v summaries_v", f"SELECT s.docket_number, s.court_id FROM summaries_v s WHERE EXISTS (SELECT 1 FROM hearings_v h JOIN dockets_v d USING (docket_id) WHERE d.docket_number = s.docket_number AND d.court_id = s.court_id AND {_CHANGE} IS NOT NULL)")
def stale_summaries(h, d, s):
    changes = sweeps.posture_changes(_moved(h), h, ["case_id", "hearing_key"])
    return sweeps.stale_after(changes, d, s).select("docket_number", "court_id")


@query("hearings_v", "SELECT case_id, hearing_key, CASE docket_id % 6 WHEN 0 THEN 'cancelled' WHEN 1 THEN CASE WHEN docket_id % 2 = 1 AND docket_id % 12 = 1 THEN 'cancelled' ELSE status END WHEN 2 THEN 'held' WHEN 3 THEN 'scheduled' ELSE status END AS status, cast(CASE WHEN docket_id % 6 = 4 THEN start_date + 10 ELSE start_date END AS string) AS start_date FROM hearings_v")
def applied_verdicts(h):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("CANCEL_HEARING", "DELETE_HALLUCINATION", "MARK_HELD", "REINSTATE", "RESCHEDULE_HEARING", "CONFIRM")]), (F.col("docket_id") % 6 + 1).cast("int"))
    shown = F.when(F.col("docket_id") % 12 == 1, F.array("docket_id")).otherwise(F.array(F.lit(-1).cast("long")))
    verdicts = h.select("case_id", "hearing_key", kind.alias("verdict"), F.date_add("start_date", 10).alias("new_date"), shown.alias("shown_ids"))
    out = sweeps.applied_verdicts(h.withColumn("source_entry_ids", F.array("docket_id")), verdicts)
    return out.select("case_id", "hearing_key", "status", F.col("start_date").cast("string").alias("start_date"))


@query("dockets_v", "SELECT docket_number, court_id, arg_max(docket_id, (date_modified, docket_id)) AS docket_id FROM dockets_v GROUP BY docket_number, court_id")
def rekeyed_summaries(d):
    by_docket = d.select("docket_id", F.col("date_modified").alias("generated_at"))
    return sweeps.rekeyed(by_docket, d)


@query("hearings_v", "SELECT case_id, hearing_key, CASE WHEN docket_id % 4 = 0 THEN NULL ELSE notes END AS notes, CASE WHEN docket_id % 2 = 0 THEN 'old' || chr(10) || chr(10) || '[dedupe] x' ELSE 'old' END AS audit_notes FROM hearings_v")
def audit_split(h):
    mark = F.when(F.col("docket_id") % 4 == 0, F.lit("[dedupe] x")).when(F.col("docket_id") % 2 == 0, F.concat_ws("\n\n", "notes", F.lit("[dedupe] x"))).otherwise(F.col("notes"))
    rows = h.withColumn("notes", mark).withColumn("audit_notes", F.lit("old"))
    return sweeps.split_audit(rows, "notes", "audit_notes").select("case_id", "hearing_key", "notes", "audit_notes")


_EVENTS = (
    "SELECT case_id, hearing_key AS event_key, title, start_date, status, greatest(coalesce(duration_minutes, 0), 0) AS minutes, coalesce(duration_minutes, 0) <= 0 AS all_day FROM hearings_v WHERE start_date IS NOT NULL AND (significance IS NULL OR significance <> 'minor') "
    "UNION ALL SELECT case_id, 'deadline:' || deadline_key, title, due_date, CASE status WHEN 'pending' THEN 'scheduled' WHEN 'passed' THEN 'held' ELSE 'cancelled' END, 15, false FROM deadlines_v WHERE due_date IS NOT NULL"
)


@query("hearings_v deadlines_v", f"SELECT case_id, event_key, title, cast(start_date AS string) AS start_date, status, minutes, all_day FROM ({_EVENTS}) e")
def event_feed(h, d):
    return feed.events(h, d).withColumn("start_date", F.col("start_date").cast("string"))


@query("hearings_v deadlines_v", f"SELECT case_id, event_key, cast(start_date AS string) AS start_date, CASE WHEN NOT upcoming THEN 'past' WHEN place <= 6 THEN 'next' ELSE 'overflow' END AS slot, place FROM (SELECT *, row_number() OVER (PARTITION BY case_id, upcoming ORDER BY abs(start_date - DATE '{TODAY}'), event_key) AS place FROM (SELECT *, start_date >= DATE '{TODAY}' AS upcoming FROM ({_EVENTS}) e WHERE status <> 'cancelled' AND start_date >= DATE '{TODAY}' - 14) f) g WHERE upcoming OR place <= 2")
def agenda(h, d):
    return feed.agenda(feed.events(h, d), TODAY).withColumn("start_date", F.col("start_date").cast("string"))


@query("hearings_v deadlines_v", f"SELECT case_id, cast(min(CASE WHEN start_date >= DATE '{TODAY}' THEN start_date END) AS string) AS next_date, count(*) AS events FROM ({_EVENTS}) e WHERE status = 'scheduled' GROUP BY case_id")
def next_event(h, d):
    return feed.next_events(feed.events(h, d), TODAY).withColumn("next_date", F.col("next_date").cast("string"))


@query("hearings_v deadlines_v", f"SELECT 'cc' || sha1(case_id || '::' || event_key) AS id, CASE WHEN k % 4 = 0 THEN CASE WHEN status <> 'cancelled' THEN 'insert' END WHEN status = 'cancelled' THEN 'cancel' WHEN k % 4 = 1 THEN 'patch' ELSE 'keep' END AS op FROM (SELECT *, cast(regexp_extract(event_key, '[0-9]+') AS bigint) AS k FROM ({_EVENTS}) e) f WHERE NOT (k % 4 = 0 AND status = 'cancelled')")
def push_plan(h, d):
    rows = feed.events(h, d)
    k = F.regexp_extract("event_key", "[0-9]+", 0).cast("long") % 4
    published = rows.where(k != 0).select(T.event_id(F.col("case_id"), F.col("event_key")).alias("id"), F.when(k == 1, "old title").otherwise(F.col("title")).alias("title"), "start_date")
    return feed.push_plan(rows, published)


_NL = "chr(13) || chr(10)"
_LOCAL = "cast(start_date AS timestamp) + to_hours(cast(length(title) AS int))"
_AT = "strftime({0}, '%Y%m%dT%H%M%S')"
_BLOCK = (
    f"concat_ws({_NL}, 'BEGIN:VEVENT', 'UID:cc' || sha1(case_id || '::' || event_key) || '@docketflow', 'DTSTAMP:19700101T000000Z', 'SUMMARY:' || title || '\\, etc.', "
    f"CASE WHEN minutes > 0 THEN concat_ws({_NL}, 'DTSTART' || CASE WHEN zone = 'UTC' THEN ':' ELSE ';TZID=' || zone || ':' END || {_AT.format(_LOCAL)} || CASE WHEN zone = 'UTC' THEN 'Z' ELSE '' END, "
    f"'DTEND' || CASE WHEN zone = 'UTC' THEN ':' ELSE ';TZID=' || zone || ':' END || {_AT.format('(' + _LOCAL + ') + to_minutes(cast(minutes AS int))')} || CASE WHEN zone = 'UTC' THEN 'Z' ELSE '' END, 'STATUS:CONFIRMED') "
    f"ELSE concat_ws({_NL}, 'DTSTART;VALUE=DATE:' || strftime(start_date, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime(start_date + 1, '%Y%m%d'), 'STATUS:CONFIRMED', 'TRANSP:TRANSPARENT') END, "
    f"'ATTENDEE;RSVP=TRUE:mailto:a@b.c', 'BEGIN:VALARM', 'TRIGGER:-PT30M', 'ACTION:DISPLAY', 'DESCRIPTION:' || title || '\\, etc.', 'END:VALARM', "
    f"CASE WHEN status = 'held' THEN concat_ws({_NL}, 'BEGIN:VALARM', 'TRIGGER:-PT60M', 'ACTION:EMAIL', 'DESCRIPTION:' || title || '\\, etc.', 'SUMMARY:Reminder: ' || title || '\\, etc.', 'ATTENDEE:mailto:a@b.c', 'END:VALARM') END, 'END:VEVENT')"
)


@query("hearings_v deadlines_v", f"SELECT case_id, event_key, {_BLOCK} AS block FROM (SELECT *, CASE status WHEN 'held' THEN 'UTC' ELSE 'America/Chicago' END AS zone FROM ({_EVENTS}) e WHERE status <> 'cancelled') f")
def feed_blocks(h, d):
    """Blocks with zones (one that does not exist), an attendee, a popup and, for held events, a mail; the hour is the title's length."""
    rows = feed.events(h, d).withColumn("start_hour", F.length("title")).withColumn("title", F.concat("title", F.lit(", etc.")))
    rows = rows.withColumn("timezone", F.when(F.col("status") == "held", "Mars/Olympus").otherwise("America/Chicago")).withColumn("notify_emails", F.array(F.lit("a@b.c")))
    popup, mail, none = (F.struct(F.lit(m).alias("method"), F.lit(n).cast("int").alias("minutes")) for m, n in (("popup", 30), ("email", 60), ("popup", 0)))
    rows = rows.withColumn("reminders", F.when(F.col("status") == "held", F.array(popup, none, mail)).otherwise(F.array(popup)))
    return feed.vevents(rows).select("case_id", "event_key", "block")


@query("hearings_v dockets_v", "SELECT h.case_id, h.hearing_key FROM hearings_v h LEFT JOIN dockets_v d ON d.docket_id = h.docket_id WHERE d.court_id IS NULL OR d.court_id IN ('unk', 'mad')")
def events_in_court(h, d):
    return context.visible_in_court(h.select("case_id", "hearing_key", "docket_id"), d, "mad").select("case_id", "hearing_key")
