"""Queries of jobs over several tables: replay, prune, refold, verdicts, push recovery, summary prompts, indexed search."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketflow.functions import text as T
from docketflow.operators import feed, folds, infer, jobs, searching
from docketflow.operators.tables import new_folder
from docketflow.plans import queries_events as ev
from docketflow.plans.register import Register
from docketflow.sources.adapter import view

query = Register()
QUERIES, ORACLE = query.queries, query.oracle

_SHOWN = "array_to_string(list_sort(list_distinct({0})), ',')"
_NOTE = "concat_ws(chr(10) || chr(10), nullif({0}, ''), '[verify-pass] ' || {1})"


def _sources():
    return F.array_join(F.array_sort(F.array_distinct("source_entry_ids")).cast("array<string>"), ",").alias("sources")


@query(
    "hearings_v",
    "SELECT case_id, hearing_key, CASE WHEN k IN (1, 8) OR (k = 2 AND docket_id % 3 = 0) THEN 'cancelled' WHEN k = 3 THEN 'held' WHEN k = 4 THEN 'scheduled' ELSE status END AS status, cast(CASE WHEN k = 5 THEN DATE '2024-03-01' ELSE start_date END AS string) AS local_date, "
    "CASE WHEN k = 5 THEN NULL ELSE start_hour END AS local_hour, CASE WHEN k = 5 THEN coalesce(zone, 'UTC') ELSE zone END AS timezone, "
    "CASE WHEN k = 1 THEN " + _NOTE.format("old", "'vacated'") + " WHEN k = 8 THEN " + _NOTE.format("old", "'Cancelled per recent docket entries'") + " WHEN k = 2 AND docket_id % 3 = 0 THEN " + _NOTE.format("old", "'No docket entry supports this hearing'")
    + " WHEN k = 4 THEN " + _NOTE.format("old", "'Cancellation not supported by docket; reinstated to scheduled'") + " WHEN k = 5 THEN " + _NOTE.format("old", "'Rescheduled per recent docket entries'") + " ELSE old END AS audit_notes "
    "FROM (SELECT *, docket_id % 10 AS k, CASE WHEN docket_id % 2 = 0 THEN 'America/Chicago' END AS zone, CASE WHEN docket_id % 7 = 0 THEN '[dedupe] x' END AS old FROM hearings_v) h",
)
def verified_hearings(h):
    """Whole rows after verdicts of every kind, by docket: some without a date, with unseen sources or a lower-case type."""
    rows = h.select(
        "case_id", "hearing_key", "status", F.col("start_date").alias("local_date"), F.col("start_hour").alias("local_hour"), "docket_id", F.expr("CASE WHEN docket_id % 2 = 0 THEN 'America/Chicago' END").alias("timezone"),
        F.expr("CASE WHEN docket_id % 7 = 0 THEN '[dedupe] x' END").alias("audit_notes"), F.array("docket_id", F.col("docket_id") + 1).alias("source_entry_ids"),
    )
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("CONFIRM", "CANCEL_HEARING", "DELETE_HALLUCINATION", "MARK_HELD", "REINSTATE", "RESCHEDULE_HEARING", "RESCHEDULE_HEARING", "NEW_KIND", "cancel_hearing")]), (F.col("docket_id") % 10 + 1).cast("int"))
    verdicts = rows.where("docket_id % 10 < 9").select(
        "case_id", "hearing_key", kinds.alias("verdict"), F.expr("CASE docket_id % 10 WHEN 1 THEN 'vacated' WHEN 5 THEN '' END").alias("reason"), F.expr("CASE WHEN docket_id % 10 = 5 THEN DATE '2024-03-01' END").alias("new_date"),
        F.lit(None).cast("int").alias("new_hour"), F.expr("CASE WHEN docket_id % 3 = 0 THEN array(docket_id + 1, docket_id) ELSE array(docket_id) END").alias("shown_ids"),
    )
    return jobs.verified(rows, verdicts).select("case_id", "hearing_key", "status", F.col("local_date").cast("string").alias("local_date"), "local_hour", "timezone", "audit_notes")


_DUE_US = ev._INSTANT.format("due_date", "due_hour", 16)
_LIVE = ", live_v AS (SELECT * FROM actions_v WHERE docket_id IN (SELECT docket_id FROM dockets_v WHERE docket_id % 9 <> 0))"
_RECORDED = ev._RECORD.format("notes")


def _merge(rows: str, by: str, own: str, order: str, source: str, why: str) -> str:
    """A step that merges the rows of one ``by``: the one that is ``own`` stays."""
    mine = lambda c: f"max(CASE WHEN own THEN {c} END)"
    return (
        f"(SELECT case_id, {mine('key')} AS key, {mine('status')} AS status, {mine('local_date')} AS local_date, {mine('local_hour')} AS local_hour, {mine('docket_id')} AS docket_id, list_distinct(flatten(list(src))) AS src, "
        f"CASE WHEN bool_or(own AND coalesce({_RECORDED}, false)) THEN {mine('notes')} ELSE coalesce(arg_min(notes, (CASE WHEN starts_with(notes, 'TRANSCRIPT') THEN 1 ELSE 0 END, -length(notes), key)) FILTER (NOT own AND {_RECORDED}), {mine('notes')}) END AS notes, "
        f"CASE WHEN bool_or(own AND title = {ev._KEY_TITLE.format('key')}) THEN coalesce(arg_min(title, (-length(title), key)) FILTER (NOT own AND title <> {ev._KEY_TITLE.format('key')}), {mine('title')}) ELSE {mine('title')} END AS title, "
        f"CASE WHEN count(*) > 1 THEN concat_ws(chr(10) || chr(10), {mine('audit')}, '[{source}] Absorbed sibling key(s) ' || string_agg(key, ', ' ORDER BY {order}) FILTER (NOT own) || {why}) ELSE {mine('audit')} END AS audit "
        f"FROM (SELECT *, {own} AS own FROM {rows}) o GROUP BY case_id, {by})"
    )


def _told(rows: str, key: str, to: str, when: str) -> str:
    """``rows`` with the key each goes to: ``key`` to ``to`` in the cases where that row is there."""
    return f"(SELECT r.*, CASE WHEN r.key = '{key}' AND {when} AND t.key IS NOT NULL THEN t.key ELSE r.key END AS home FROM {rows} r LEFT JOIN (SELECT case_id, key FROM {rows} x WHERE key = '{to}') t USING (case_id))"


_CASE = "cast(substr(r.case_id, 6) AS int)"
_SEEN = "(cast(substr(case_id, 6) AS int) % 2 = 0 OR len(list_filter(sources, lambda x: x % 2 <> 0)) = 0)"
_VERIFIED = (
    f"(SELECT case_id, key, docket_id, sources AS src, title, notes, CASE WHEN key = 'h-1' OR (key = 'h-4' AND {_SEEN}) THEN 'cancelled' WHEN key = 'h-2' THEN 'held' WHEN key = 'h-6' THEN 'scheduled' ELSE status END AS status, "
    "CASE WHEN key = 'h-3' THEN DATE '2024-03-01' ELSE local_date END AS local_date, CASE WHEN key = 'h-3' THEN 9 ELSE local_hour END AS local_hour, "
    f"CASE WHEN key = 'h-1' THEN '[verify-pass] Cancelled per recent docket entries' WHEN key = 'h-4' AND {_SEEN} THEN '[verify-pass] No docket entry supports this hearing' WHEN key = 'h-3' THEN '[verify-pass] moved' WHEN key = 'h-6' THEN '[verify-pass] Cancellation not supported by docket; reinstated to scheduled' END AS audit "
    f"FROM {ev.HEARING_ROWS.replace('actions_v', 'live_v')} f)"
)
_ONE = _merge(_told("verified_v", "h-0-2", "h-0", f"{_CASE} % 3 = 0"), "home", "key = home", "docket_id, key", "dedupe", "': Duplicate of ' || home")
_SLOTS = (
    "(SELECT *, row_number() OVER (PARTITION BY case_id, slot ORDER BY CASE WHEN key = canon THEN 0 ELSE 1 END, -len(src), key) AS r FROM (SELECT *, list_min(list_filter(list(key) OVER (PARTITION BY case_id, slot), "
    "lambda k: len(list_filter(list(key) OVER (PARTITION BY case_id, slot), lambda o: o <> k AND regexp_replace(o, '-[0-9]+$', '') = k)) > 0)) AS canon FROM "
    "(SELECT m.*, CASE WHEN status = 'held' AND local_date IS NOT NULL THEN concat_ws('|', d.docket_number, d.court_id, cast(local_date AS string), cast(local_hour AS string)) ELSE 'own ' || key END AS slot FROM one_v m LEFT JOIN dockets_v d USING (docket_id)) s) c)"
)
_TWO = _merge(_SLOTS, "slot", "r = 1", "r", "dedupe-held", "' at same UTC slot ' || concat_ws(' ', cast(max(local_date) AS string), cast(max(local_hour) AS string))")
_THREE = _merge(_told("two_v", "h-5", "h-6", f"{_CASE} % 5 = 1"), "home", "key = home", "docket_id, key", "dedupe-nearslot", "': Duplicate of ' || home")
_NOW = "(SELECT max(epoch_us(cast(entry_date AS timestamp))) FROM actions_v)"


@query(
    "actions_v dockets_v",
    f"{_LIVE}, verified_v AS {_VERIFIED}, one_v AS {_ONE}, two_v AS {_TWO}, three_v AS {_THREE} "
    f"SELECT 'hearings' AS table_name, case_id, key, status, cast(local_date AS string) AS at, local_hour, title, notes, docket_id, {_SHOWN.format('src')} AS sources, audit AS audit_notes FROM three_v "
    f"UNION ALL SELECT 'deadlines', case_id, key, CASE WHEN status = 'pending' AND us > {_NOW} AND key = 'd-1' THEN 'met' WHEN status = 'pending' AND us > {_NOW} AND key = 'd-2' THEN 'cancelled' WHEN status = 'pending' AND us < {_NOW} THEN 'passed' ELSE status END, "
    f"cast(due_date AS string), due_hour, title, notes, docket_id, {_SHOWN.format('sources')}, NULL FROM (SELECT *, {_DUE_US} AS us FROM {ev.DEADLINE_ROWS.replace('actions_v', 'live_v')} f) d",
)
def replayed_store(a, d):
    """All rows of the cases of known dockets rebuilt: folds, verdicts, three merges, filings, what is past due."""
    dockets = d.where("docket_id % 9 <> 0")
    keys = a.groupBy("case_id", "hearing_key").agg(F.collect_list("event_id").alias("ids"))
    number = F.regexp_extract("case_id", "[0-9]+", 0).cast("int")
    kinds = {"h-1": "CANCEL_HEARING", "h-2": "MARK_HELD", "h-3": "RESCHEDULE_HEARING", "h-4": "DELETE_HALLUCINATION", "h-5": "RESCHEDULE_HEARING", "h-6": "REINSTATE"}
    verdict = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("hearing_key"))
    moved = F.col("hearing_key") == "h-3"
    verdicts = keys.where(F.col("hearing_key").isin(*kinds)).select(
        "case_id", "hearing_key", verdict.alias("verdict"), F.when(moved, "moved").alias("reason"), F.when(moved, F.lit("2024-03-01").cast("date")).alias("new_date"), F.when(moved, 9).alias("new_hour"),
        F.when(number % 2 == 0, F.col("ids")).otherwise(F.filter("ids", lambda i: i % 2 == 0)).alias("shown_ids"),
    )
    cases = keys.select("case_id").distinct()
    merges = cases.where(number % 3 == 0).select("case_id", F.lit("h-0-2").alias("key"), F.lit("h-0").alias("target"))
    near = cases.where(number % 5 == 1).select("case_id", F.lit("h-5").alias("key"), F.lit("h-6").alias("target"))
    filed = cases.select("case_id", F.lit("d-1").alias("deadline_key"), F.lit("MARK_FILED").alias("verdict")).unionByName(cases.select("case_id", F.lit("d-2").alias("deadline_key"), F.lit("CANCEL_DEADLINE").alias("verdict")))
    now = a.agg(F.max(F.unix_micros(F.col("entry_date").cast("timestamp")))).first()[0] or 0
    due = ev._instant("due_date", "due_hour", 16)
    out = jobs.replayed_store(ev.as_steps(a), ev.as_deadline_steps(a), dockets, verdicts, merges, near, filed, due, now, (folds.HEARINGS, folds.DEADLINES))
    shape = lambda rows, name, key, at, hour: rows.select(F.lit(name).alias("table_name"), "case_id", F.col(key).alias("key"), "status", F.col(at).cast("string").alias("at"), F.col(hour).alias("local_hour"), "title", "notes", "docket_id", _sources(), "audit_notes")
    return shape(out["hearings"], "hearings", "hearing_key", "local_date", "local_hour").unionByName(shape(out["deadlines"], "deadlines", "deadline_key", "due_date", "due_hour"))


_AGAIN = ", again_v AS (SELECT * FROM actions_v WHERE event_id % 7 <> 3 UNION ALL SELECT * REPLACE (local_date + 1 AS local_date) FROM actions_v WHERE event_id % 14 = 3)"


@query("actions_v", f"{_AGAIN} SELECT case_id, key AS hearing_key, status, cast(local_date AS string) AS local_date, title, notes, docket_id, {_SHOWN.format('sources')} AS sources FROM {ev.HEARING_ROWS.replace('actions_v', 'again_v')} s")
def refolded_hearings(a):
    """A seventh of the entries is read again: half of them say nothing now, the others name a day later."""
    history = ev.as_steps(a)
    again = history.where("event_id % 7 = 3")
    rows = jobs.refolded(folds.HEARINGS, folds.fold_hearings(history), history, again, again.where("event_id % 14 = 3").withColumn("local_date", F.date_add("local_date", 1)))
    return rows.select("case_id", "hearing_key", "status", F.col("local_date").cast("string").alias("local_date"), "title", "notes", "docket_id", _sources())


_GONE = "docket_id % 8 < 5"


@query(
    "dockets_v entries_v hearings_v deadlines_v summaries_v",
    f"SELECT 'dockets' AS table_name, cast(docket_id AS string) AS row_key FROM dockets_v WHERE NOT {_GONE} UNION ALL SELECT 'entries', cast(entry_id AS string) FROM entries_v WHERE NOT {_GONE} UNION ALL SELECT 'hearings', hearing_key FROM hearings_v WHERE NOT {_GONE} "
    f"UNION ALL SELECT 'deadlines', deadline_key FROM deadlines_v WHERE NOT {_GONE} UNION ALL SELECT 'summaries', docket_number || '/' || court_id FROM summaries_v s WHERE EXISTS (SELECT 1 FROM dockets_v d WHERE d.docket_number = s.docket_number AND d.court_id = s.court_id AND NOT {_GONE})",
)
def pruned_tables(d, e, h, l, s):  # noqa: E741
    """Every table after five of eight dockets went, published together and read back."""
    spark: SparkSession = d.sparkSession
    folder = new_folder(spark, "store")
    tables = jobs.cascaded({"entries": e, "hearings": h, "deadlines": l}, d, s, d.where(_GONE))
    jobs.publish(folder, tables)
    keys = {"dockets": F.col("docket_id").cast("string"), "entries": F.col("entry_id").cast("string"), "hearings": F.col("hearing_key"), "deadlines": F.col("deadline_key"), "summaries": F.concat_ws("/", "docket_number", "court_id")}
    parts = [jobs.published(spark, folder, name).select(F.lit(name).alias("table_name"), key.alias("row_key")) for name, key in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ID = "'cc' || sha1(case_id || '::' || hearing_key)"


@query(
    "hearings_v",
    f"SELECT {_ID} AS id, CASE WHEN k IN (1, 2, 3) THEN 'p' || cast(docket_id AS string) END AS push_id, CASE WHEN k IN (1, 2, 3) THEN CASE WHEN status = 'cancelled' THEN 'cancel' WHEN docket_id % 3 = 0 THEN 'patch' ELSE 'keep' END ELSE 'insert' END AS op "
    "FROM (SELECT *, docket_id % 5 AS k FROM hearings_v) h WHERE k IN (1, 2, 3) OR status <> 'cancelled' "
    f"UNION ALL SELECT {_ID}, 'q' || cast(docket_id AS string), 'duplicate' FROM hearings_v WHERE docket_id % 10 = 3 UNION ALL SELECT 'none' || cast(docket_id AS string), 'p' || cast(docket_id AS string), 'orphan' FROM hearings_v WHERE docket_id % 5 = 4",
)
def recovered_plan(h):
    """By docket: rows that know their id, or one that is gone, or none; copies of one event, and events of no row."""
    case = F.expr("concat('cc', sha1(concat(case_id, '::', hearing_key)))")
    wanted = h.select("case_id", F.col("hearing_key").alias("event_key"), "title", "start_date", "status", F.expr("CASE docket_id % 5 WHEN 1 THEN 'p' || cast(docket_id AS string) WHEN 2 THEN 'x' || cast(docket_id AS string) END").alias("push_id"))
    seen = h.where("docket_id % 5 > 0").select(
        F.expr("'p' || cast(docket_id AS string)").alias("push_id"), F.when(F.col("docket_id") % 5 == 4, F.expr("'none' || cast(docket_id AS string)")).when(F.col("docket_id") % 5 != 1, case).alias("correlation"),
        F.when(F.col("docket_id") % 3 == 0, "old").otherwise(F.col("title")).alias("title"), "start_date",
    )
    copies = h.where("docket_id % 10 = 3").select(F.expr("'q' || cast(docket_id AS string)").alias("push_id"), case.alias("correlation"), "title", "start_date")
    return feed.recovered_plan(wanted, seen.unionByName(copies))


_DOCUMENTS = "SELECT cast(floor(doc_id / 10) AS bigint) AS docket_id, CASE doc_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'disposition' ELSE 'extra' END AS section, doc_id % 3 AS s, doc_id AS place, 'doc ' || cast(doc_id AS string) AS name, plain_text AS text, CASE doc_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 200 ELSE 120 END AS most, CASE doc_id % 3 WHEN 0 THEN 700 WHEN 1 THEN 500 ELSE 150 END AS total FROM docs_v"
_CUT = f"SELECT *, cast(greatest(0, least(n, total - coalesce(sum(n) OVER (PARTITION BY docket_id, section ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS int) AS size, row_number() OVER (PARTITION BY docket_id ORDER BY s, place) AS ref FROM (SELECT *, least(length(text), most) AS n FROM ({_DOCUMENTS}) d) m"
_NEWLINE = "chr(10)"


@query(
    "docs_v hearings_v dockets_v",
    f"SELECT d.docket_id, concat_ws({_NEWLINE}, 'TODAY 2024-02-01' || {_NEWLINE} || 'DOCKET ' || docket_number || ' in ' || court_id, CASE WHEN d.docket_id % 4 = 0 THEN 'ADVISORY: sealed' END, 'EVENTS', coalesce(e.lines, '(none)'), 'DOCUMENTS', coalesce(x.blocks, '(none)'), 'Write two to four sentences.') AS prompt FROM dockets_v d "
    f"LEFT JOIN (SELECT docket_id, string_agg('- ' || title || ' ' || status, {_NEWLINE} ORDER BY '- ' || title || ' ' || status) AS lines FROM hearings_v WHERE docket_id % 2 = 0 GROUP BY docket_id) e USING (docket_id) "
    f"LEFT JOIN (SELECT docket_id, string_agg('--- [D' || cast(ref AS string) || '] ' || section || ': ' || name || {_NEWLINE} || left(text, size) || CASE WHEN length(text) > size THEN ' [.. ' || cast(length(text) - size AS string) || ' characters left out]' ELSE '' END, {_NEWLINE} ORDER BY ref) AS blocks FROM ({_CUT}) c GROUP BY docket_id) x USING (docket_id)",
)
def summary_prompts(x, h, d):
    """Prompts of every docket within small budgets: ten documents in three sections, events of every other docket, an advisory of every fourth."""
    documents = x.select(
        F.floor(F.col("doc_id") / 10).cast("long").alias("docket_id"), F.element_at(F.array(F.lit("primary"), F.lit("disposition"), F.lit("extra")), (F.col("doc_id") % 3 + 1).cast("int")).alias("section"),
        F.col("doc_id").alias("place"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.col("plain_text").alias("text"),
    )
    events = h.where("docket_id % 2 = 0").select("docket_id", F.concat(F.lit("- "), "title", F.lit(" "), "status").alias("line"))
    advisories = d.where("docket_id % 4 = 0").select("docket_id", F.lit("ADVISORY: sealed").alias("line"))
    sections = {"primary": (300, 700), "disposition": (200, 500), "extra": (120, 150)}
    return infer.summary_prompts(d.select("docket_id", "docket_number", F.col("court_id").alias("court")), documents, events, advisories, "2024-02-01", sections)


@query("docs_v", "SELECT doc_id FROM docs_v WHERE contains(lower(source || ' ' || plain_text), 'tion') AND contains(lower(source || ' ' || plain_text), 'the an') AND contains(lower(source || ' ' || plain_text), 'ou')")
def indexed_search(x):
    """Terms, one of them over two words and one of two letters, by an index of trigrams over source and text."""
    spark: SparkSession = x.sparkSession
    folder = new_folder(spark, "grams")
    rows = x.select("doc_id", searching.haystack(F.array("source", "plain_text")).alias("hay"))
    searching.write_index(rows, "doc_id", "hay", folder)
    return searching.found(rows, spark.read.parquet(folder), "doc_id", "hay", ["tion", "The an", "ou"]).select("doc_id")


@query(
    "dockets_v courts_v hearings_v",
    "SELECT case_id FROM dockets_v d LEFT JOIN courts_v c USING (court_id) LEFT JOIN hearings_v h ON h.docket_id = d.docket_id GROUP BY d.case_id HAVING bool_or(contains(lower(c.citation), 'mass')) AND bool_or(contains(lower(h.title), 'ring 3'))".replace("SELECT case_id FROM", "SELECT d.case_id FROM"),
)
def case_search(d, c, h):
    """Cases by court and event title: the haystack of a case has its numbers, courts and all titles."""
    joined = d.join(F.broadcast(c.select("court_id", "citation")), "court_id", "left")  # one row a court
    titles = h.join(d.select("docket_id", "case_id").withColumnRenamed("case_id", "home"), "docket_id").groupBy("home").agg(F.collect_set("title").alias("titles"))
    cases = joined.groupBy("case_id").agg(F.collect_set("docket_number").alias("numbers"), F.collect_set("citation").alias("courts"))
    cases = cases.join(titles.withColumnRenamed("home", "case_id").hint("merge"), "case_id", "left")
    hay = searching.haystack(F.array("case_id"), F.coalesce("numbers", F.array()), F.coalesce("courts", F.array()), F.coalesce("titles", F.array().cast("array<string>")))
    rows = cases.select("case_id", hay.alias("hay"))
    folder = new_folder(d.sparkSession, "grams")
    searching.write_index(rows, "case_id", "hay", folder)
    return searching.found(rows, d.sparkSession.read.parquet(folder), "case_id", "hay", ["Mass", "ring 3"]).select("case_id")


_N = "chr(10)"
_CANON = "(SELECT docket_id, min(docket_id) OVER (PARTITION BY docket_number, court_id) AS canonical FROM dockets_v)"


@query(
    "entries_v dockets_v hearings_v docs_v",
    f"SELECT e.entry_id, concat_ws({_N}, 'KNOWN ROWS', coalesce(k.rows_, '(none)'), 'ENTRY ' || coalesce(cast(entry_number AS string), 'none') || ' of docket ' || cast(c.canonical AS string) || ' filed ' || cast(date_filed AS string), description, 'ATTACHED TEXTS' || {_N} || x.texts, 'RELATED ENTRIES' || {_N} || r.heads) AS prompt "
    f"FROM entries_v e JOIN {_CANON} c USING (docket_id) LEFT JOIN (SELECT canonical, string_agg('- hearing ' || hearing_key || ' ' || status || ' ' || title || ' at ' || cast(start_date AS string) || ' docket ' || cast(canonical AS string), {_N} ORDER BY hearing_key) AS rows_ FROM hearings_v JOIN {_CANON} h USING (docket_id) GROUP BY canonical) k ON k.canonical = c.canonical "
    f"LEFT JOIN (SELECT entry_id, string_agg(left(plain_text, 200), {_N} || '---' || {_N} ORDER BY doc_id) AS texts FROM docs_v WHERE trim(plain_text) <> '' GROUP BY entry_id) x ON x.entry_id = e.entry_id "
    f"LEFT JOIN (SELECT entry_id, string_agg('- [' || cast(n AS string) || '] ' || left(trim(t), 20), {_N} ORDER BY n) AS heads FROM (SELECT a.entry_id, b.entry_number AS n, b.description AS t FROM entries_v a JOIN entries_v b ON b.docket_id = a.docket_id AND b.entry_number = a.entry_number - 1 AND trim(b.description) <> '') y GROUP BY entry_id) r ON r.entry_id = e.entry_id",
)
def extraction_prompts(e, d, h, x):
    """What an extraction of every entry is asked: known rows of all copies of its docket, its documents (cut at 200) and the entry before (cut at 20)."""
    known = h.select("docket_id", F.lit("hearing").alias("kind"), F.col("hearing_key").alias("key"), "status", "title", F.col("start_date").alias("at"))
    before = e.select("docket_id", (F.col("entry_number") + 1).alias("entry_number"), F.col("entry_number").alias("ref_number"), F.col("description").alias("ref_text"))
    related = e.select("entry_id", "docket_id", "entry_number").join(before, ["docket_id", "entry_number"]).select("entry_id", "ref_number", "ref_text")
    entries = e.select("entry_id", "docket_id", "entry_number", "date_filed", F.col("description").alias("text"))
    return infer.extraction_prompts(entries, d, known, x.select("entry_id", F.col("doc_id").alias("place"), F.col("plain_text").alias("text")), related, 200, 20)


@query(
    "hearings_v dockets_v entries_v",
    f"SELECT case_id, slot, concat_ws({_N}, 'CANDIDATES ' || cast(n AS string), rows_, 'RECENT ENTRIES', coalesce(lines, '(none)')) AS prompt FROM "
    f"(SELECT case_id, slot, count(*) AS n, string_agg('---' || {_N} || 'hearing_key: ' || hearing_key || {_N} || 'start: ' || cast(start_date AS string), {_N} ORDER BY hearing_key) AS rows_ FROM ({ev._WIDE}) w GROUP BY case_id, slot HAVING count(*) > 1) k "
    f"LEFT JOIN (SELECT case_id, slot, string_agg('- [' || coalesce(cast(entry_number AS string), 'none') || '] filed ' || cast(date_filed AS string) || ': ' || left(trim(coalesce(nullif(description, ''), short_description, '')), 50), {_N} ORDER BY date_filed, entry_id) AS lines FROM "
    f"(SELECT DISTINCT w.case_id, w.slot, e.* FROM ({ev._WIDE}) w JOIN entries_v e USING (docket_id) WHERE e.entry_id % 10 < 3) y GROUP BY case_id, slot) x USING (case_id, slot)",
)
def dedupe_prompts(h, d, e):
    """What is asked of held rows of one case and court, with two entries of each docket."""
    slot = F.when(F.col("docket_id") % 7 == 0, F.concat(F.lit("#docket-id="), F.col("docket_id").cast("string"))).otherwise(F.col("court_id"))
    rows = h.where("status = 'held'").join(d.select("docket_id", "court_id"), "docket_id").select("docket_id", "hearing_key", F.trunc("start_date", "month").alias("start"), F.concat(F.lit("c"), (F.col("docket_id") % 8).cast("string")).alias("case_id"), slot.alias("slot"))
    many = rows.groupBy("case_id", "slot").count().where("count > 1").select("case_id", "slot")
    rows = rows.join(many.hint("merge"), ["case_id", "slot"], "left_semi")
    shown = rows.join(e.where("entry_id % 10 < 3").select("docket_id", "entry_id"), "docket_id").select("case_id", "slot", "entry_id")
    return infer.dedupe_prompts(rows, ["case_id", "slot"], ["hearing_key", "start"], shown, e, 50)
