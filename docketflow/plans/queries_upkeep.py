"""Queries over verification, worklists and upkeep of stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import text as T
from docketflow.operators import context, infer, ingest, sweeps
from docketflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle

_TARGETS = "(SELECT case_id, hearing_key, docket_id, start_date FROM hearings_v WHERE status = 'scheduled' OR (status = 'cancelled' AND start_date < DATE '1998-06-15')) h"
# What a verification shows: (case_id, hearing_key, entry_id).
_SHOWN = (
    f"(SELECT case_id, hearing_key, entry_id FROM {_TARGETS} JOIN (SELECT docket_id, entry_id FROM (SELECT docket_id, entry_id, row_number() OVER (PARTITION BY docket_id ORDER BY date_filed DESC, entry_id DESC) AS r FROM entries_v WHERE description <> '') x WHERE r <= 15) n USING (docket_id) "
    f"UNION SELECT case_id, hearing_key, entry_id FROM (SELECT case_id, hearing_key, entry_id, row_number() OVER (PARTITION BY case_id, hearing_key ORDER BY date_filed DESC, entry_id DESC) AS r FROM {_TARGETS} JOIN entries_v e USING (docket_id) WHERE description <> '' AND date_filed BETWEEN start_date - 2 AND start_date + 45) x WHERE r <= 20 "
    f"UNION SELECT case_id, hearing_key, entry_id FROM {_TARGETS} JOIN entries_v e USING (docket_id) WHERE entry_id = docket_id * 10 + 1)"
)


def _targets(h):
    chosen = h.where("status = 'scheduled' OR (status = 'cancelled' AND start_date < DATE '1998-06-15')")
    return chosen.withColumn("source_entry_ids", F.array(F.col("docket_id") * 10 + 1))


@query("hearings_v entries_v", f"SELECT case_id, hearing_key, entry_id FROM {_SHOWN} s")
def verification_context(h, e):
    """Two newest bodies, entries around the date and the first entry of each row to verify."""
    return context.verification_context(_targets(h), e)


_FIELDS = ["hearing_key", "title", "start_date", "status", "significance", "duration_minutes", "docket_id", "notes"]
_HEAD = " || chr(10) || ".join(f"'{f}: ' || coalesce(cast({f} AS string), 'none')" for f in _FIELDS)
_LINE = "'- [' || coalesce(cast(entry_number AS string), 'none') || '] ' || cast(entry_id AS string) || ' filed ' || coalesce(cast(date_filed AS string), 'none') || ': ' || left(trim(coalesce(nullif(description, ''), short_description, '')), 1500)"


@query("hearings_v entries_v", f"SELECT case_id, hearing_key, 'TO VERIFY' || chr(10) || {_HEAD} || chr(10) || 'RECENT ENTRIES' || chr(10) || coalesce(lines, '(none)') AS prompt FROM (SELECT * FROM hearings_v WHERE status = 'scheduled' OR (status = 'cancelled' AND start_date < DATE '1998-06-15')) h LEFT JOIN (SELECT case_id, hearing_key, string_agg({_LINE}, chr(10) ORDER BY date_filed NULLS FIRST, entry_number NULLS FIRST, entry_id) AS lines FROM {_SHOWN} s JOIN (SELECT entry_id, entry_number, date_filed, description, short_description FROM entries_v) e USING (entry_id) GROUP BY case_id, hearing_key) l USING (case_id, hearing_key)")
def verification_prompts(h, e):
    """What a verification of each row to verify shows, over the entries of ``verification_context``."""
    targets = _targets(h)
    return infer.verification_prompts(targets, context.verification_context(targets, e), e, _FIELDS, ["case_id", "hearing_key"])


@query("hearings_v entries_v", f"SELECT case_id, hearing_key, bool_and(entry_id IS NULL OR entry_id IN (SELECT entry_id FROM entries_v WHERE entry_number IS NOT NULL)) AS allowed FROM (SELECT case_id, hearing_key, CASE WHEN docket_id % 8 <> 0 THEN unnest([docket_id * 10 + 1, docket_id * 10 + 2]) END AS entry_id FROM hearings_v) s GROUP BY case_id, hearing_key")
def removal_guard(h, e):
    """Rows with two sources (or none), of which the numbered entries were shown."""
    ids = F.array(F.col("docket_id") * 10 + 1, F.col("docket_id") * 10 + 2)
    rows = h.select("case_id", "hearing_key", "docket_id", F.when(F.col("docket_id") % 8 != 0, ids).alias("source_entry_ids"))
    shown = rows.select("case_id", "hearing_key", F.explode("source_entry_ids").alias("entry_id")).join(e.where("entry_number IS NOT NULL").select("entry_id"), "entry_id", "left_semi")
    return context.removal_allowed(rows, shown, ["case_id", "hearing_key"])


@query("dockets_v", "SELECT docket_id, CASE WHEN docket_id % 3 = 0 THEN 'exists' ELSE 'created' END AS status FROM dockets_v")
def subscriptions(d):
    existing = d.where("docket_id % 3 < 2").select("docket_id", (F.col("docket_id") % 3 + 1).alias("alert_type"))
    return context.subscriptions(d, existing)


@query("dockets_v entries_v courts_v", "SELECT 'docket' AS kind, cast(docket_id AS string) AS id FROM (SELECT DISTINCT docket_id FROM entries_v) e WHERE docket_id NOT IN (SELECT docket_id FROM dockets_v WHERE docket_id % 7 <> 0) UNION ALL SELECT DISTINCT 'court', court_id FROM dockets_v WHERE docket_id % 7 <> 0 AND court_id NOT IN (SELECT court_id FROM courts_v WHERE citation IS NOT NULL)")
def missing_metadata(d, e, c):
    return context.missing_metadata(e, d.where("docket_id % 7 <> 0"), c)


@query("docs_v dockets_v", "SELECT DISTINCT docket_number, court_id, doc_id FROM docs_v JOIN dockets_v ON docket_id = doc_id WHERE length(plain_text) >= 100 AND length(regexp_replace(plain_text, '[^A-Za-z]', '', 'g')) >= 0.4 * length(regexp_replace(plain_text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))")
def pinned_documents(x, d):
    return context.pinned_documents(x.withColumn("docket_id", F.col("doc_id")), d, T.usable(F.col("plain_text")))


_OPEN = "status = 'pending' AND due_date > DATE '1996-01-01'"


@query("deadlines_v", f"SELECT case_id, deadline_key, CASE WHEN {_OPEN} AND docket_id % 5 = 0 THEN 'cancelled' WHEN {_OPEN} AND docket_id % 5 = 1 THEN 'met' ELSE status END AS status, cast(CASE WHEN {_OPEN} AND docket_id % 5 = 2 THEN due_date + 30 ELSE due_date END AS string) AS due_date FROM deadlines_v")
def deadline_verdicts(d):
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("CANCEL_DEADLINE", "MARK_FILED", "RESCHEDULE_DEADLINE", "CONFIRM", "UNCLEAR")]), (F.col("docket_id") % 5 + 1).cast("int"))
    verdicts = d.select("case_id", "deadline_key", verdict.alias("verdict"), F.date_add("due_date", 30).alias("local_date"))
    return sweeps.deadline_verdicts(d, verdicts, "1996-01-01").withColumn("due_date", F.col("due_date").cast("string"))


_GROUPS = (
    "(SELECT cast(floor(docket_id / 4) AS bigint) AS g, CASE docket_id % 4 WHEN 0 THEN 'k0' WHEN 1 THEN 'k0-2' WHEN 2 THEN 'k2' ELSE 'k3' END AS key FROM hearings_v) k"
)


@query(
    "hearings_v",
    "SELECT 'g' || cast(g AS string) AS cluster, key, target FROM (SELECT k.g, key, CASE WHEN k.g % 3 = 0 AND a THEN CASE WHEN b THEN 'k0' ELSE 'k0-2' END WHEN k.g % 3 = 1 AND c THEN CASE WHEN a AND b THEN 'k0' ELSE 'k2' END END AS target "
    f"FROM {_GROUPS} JOIN (SELECT g, bool_or(key = 'k0-2') AS a, bool_or(key = 'k0') AS b, bool_or(key = 'k2') AS c FROM {_GROUPS} GROUP BY g) h ON h.g = k.g) x WHERE key <> target",
)
def merge_verdicts(h):
    """Groups of four keys: a third merge into a key with a suffix, a third into one without, a third into a key of no row."""
    key = F.element_at(F.array(*[F.lit(k) for k in ("k0", "k0-2", "k2", "k3")]), (F.col("docket_id") % 4 + 1).cast("int"))
    rows = h.select(F.floor(F.col("docket_id") / 4).alias("g"), key.alias("key")).withColumn("cluster", F.concat(F.lit("g"), F.col("g").cast("string")))
    target = F.when(F.col("g") % 3 == 0, "k0-2").when(F.col("g") % 3 == 1, "k2").otherwise("zz")
    verdicts = rows.select("cluster", target.alias("target_key"), F.lit("MERGE_INTO").alias("verdict")).distinct()
    return sweeps.merge_verdicts(rows.select("cluster", "key"), verdicts)


@query("dockets_v", "SELECT DISTINCT case_id FROM dockets_v WHERE docket_id % 16 = 0 OR docket_id % 48 = 7")
def active_cases(d):
    return sweeps.active_cases(d, d.where("docket_id % 16 = 0"), d.where("docket_id % 48 = 7"))


@query("entries_v", f"SELECT docket_id, entry_id, sha1(concat('now ', coalesce(description,''),'|',coalesce(short_description,''),'|',cast(date_filed AS string))) AS fingerprint FROM entries_v WHERE description = '' AND entry_id % 2 = 0")
def refilled_placeholders(e):
    """Blank entries read again: half of them have a body now."""
    blank = e.where("description = ''")
    mark = lambda c: ingest.fingerprint(c, F.col("short_description"), F.col("date_filed"))
    now = F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("now "), "description")).otherwise(F.col("description"))
    feed = e.select("docket_id", "entry_id", mark(now).alias("fingerprint"))
    return sweeps.refilled(blank.select("docket_id", "entry_id", mark(F.col("description")).alias("fingerprint")), feed, ["docket_id", "entry_id"])
