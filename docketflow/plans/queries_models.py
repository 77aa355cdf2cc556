"""Queries over model calls, logs, refusals and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import text as T
from docketflow.operators import context, heals, infer, state
from docketflow.plans.queries_ingest import _RE, _hit
from docketflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle


@query("entries_v", f"SELECT e.entry_id, e.description || chr(10) || coalesce(string_agg('[' || cast(r.ref_entry_id AS string) || '] ' || left(r.t, 1500), chr(10) ORDER BY r.ref_entry_id), '') AS prompt FROM entries_v e LEFT JOIN (SELECT n.entry_id, b.entry_id AS ref_entry_id, b.description AS t FROM (SELECT DISTINCT docket_id, entry_id, cast(unnest(regexp_extract_all(description, '{_RE['REFERENCES']}', 1)) AS bigint) AS ref FROM entries_v) n JOIN entries_v b ON b.docket_id = n.docket_id AND b.entry_number = n.ref AND b.description <> '') r USING (entry_id) WHERE e.description LIKE 'ORDER%' GROUP BY e.entry_id, e.description")
def prompt_assembly(e):
    """Prompts of orders with the heads of the entries they refer to."""
    refs = context.cross_references(e, T.references(F.col("description"))).select("entry_id", "ref_entry_id")
    related = refs.join(e.select(F.col("entry_id").alias("ref_entry_id"), F.col("description").alias("ref_text")).hint("merge"), "ref_entry_id")
    return infer.prompts(e.where("description LIKE 'ORDER%'").select("entry_id", F.col("description").alias("text")), related)


@query("calls_v", "SELECT conv_id * 1000 + turn AS id, CASE WHEN tokens_in % 2 = 0 THEN 'known' ELSE 'len ' || cast(tokens_in AS string) END AS response, tokens_in % 2 = 0 AS cached FROM calls_v")
def response_cache(c):
    """Requests by content: even sizes are in the cache, the others go to a scorer once each."""
    prompt = F.concat(F.lit("len "), F.col("tokens_in").cast("string"))
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), infer.request_key(prompt.alias("p")).alias("key"), prompt.alias("prompt"), "tokens_in")
    cache = rows.where("tokens_in % 2 = 0").select("key", F.lit("known").alias("response")).distinct()
    return infer.infer(rows.drop("tokens_in"), cache, lambda p: p).select("id", "response", "cached")


@query("calls_v", "SELECT conv_id * 1000 + turn AS id, i AS action_idx, CASE WHEN turn % 3 = 2 THEN 'IGNORE' WHEN i = 0 THEN 'ADD_HEARING' ELSE 'MARK_HELD' END AS type, CASE WHEN turn % 3 <> 2 THEN 'h-' || cast(conv_id AS string) END AS hearing_key FROM calls_v CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) k WHERE i = 0 OR turn % 3 = 1")
def action_parse(c):
    """Answers in fences, with two actions, or broken: broken ones are one IGNORE."""
    one = F.concat(F.lit('{"type":"ADD_HEARING","hearing_key":"h-'), F.col("conv_id").cast("string"), F.lit('"}'))
    two = F.concat(F.lit('{"type":"MARK_HELD","hearing_key":"h-'), F.col("conv_id").cast("string"), F.lit('"}'))
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('```json\n{"actions":['), one, F.lit("]}\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('sure: {"actions":['), one, F.lit(","), two, F.lit("]}"))).otherwise("no idea {")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), answer.alias("response"))
    return infer.parsed_actions(rows).select("id", "action_idx", "type", "hearing_key")


@query("calls_v", "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 2 = 0 THEN 'CONFIRM' ELSE 'UNCLEAR' END AS verdict, CASE WHEN turn % 2 = 0 THEN 'r' ELSE 'no verdict' END AS reason FROM calls_v")
def verdict_parse(c):
    answer = F.when(F.col("turn") % 2 == 0, '{"actions":[{"type":"CONFIRM","reason":"r"}]}').otherwise('{"actions":[]}')
    return infer.parsed_verdicts(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), answer.alias("response")))


@query("calls_v", "SELECT purpose, model, docket, count(*) AS calls, cast(sum(tokens_in) AS bigint) AS input, cast(sum(tokens_out) AS bigint) AS output FROM calls_v GROUP BY purpose, model, docket")
def usage_log(c):
    """Log lines written from the calls and scanned back."""
    line = F.concat_ws(" ", F.lit("12:00 llm-tokens call"), *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(v).cast("string"), F.lit("-"))) for k, v in (("purpose", "purpose"), ("model", "model"), ("docket", "docket"), ("input", "tokens_in"), ("output", "tokens_out"), ("cached", "cached"))])
    found = infer.usage_log(c.select(line.alias("value")))
    return found.groupBy("purpose", "model", "docket").agg(F.count("*").alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"))


@query("docs_v", "SELECT entry_id, CASE WHEN bool_and(is_sealed) THEN 'sealed' WHEN bool_and(is_sealed OR NOT is_available) THEN 'not available' ELSE 'unreadable' END AS refusal FROM docs_v GROUP BY entry_id HAVING bool_and(is_sealed OR NOT is_available OR plain_text = '')")
def refusal_routing(d):
    """Entries none of whose documents has text, and why."""
    closed = F.col("is_sealed") | ~F.col("is_available")
    rows = d.groupBy("entry_id").agg(F.bool_and("is_sealed").alias("s"), F.bool_and(closed).alias("c"), F.bool_and(closed | (F.col("plain_text") == "")).alias("none")).where("none")
    return rows.select("entry_id", F.when(F.col("s"), "sealed").when(F.col("c"), "not available").otherwise("unreadable").alias("refusal"))


@query("entries_v", f"SELECT docket_id, bool_or(contains(description, 'restitution')) AND NOT bool_or(regexp_matches(description, 'restitution in the amount of [$]')) AS unreadable, count_if({_hit('description', 'PRIMARY')} AND length(description) < 1500) AS short_primary FROM entries_v GROUP BY docket_id")
def restitution_and_short_text(e):
    """Per docket: a restitution order without a figure, and primary texts suspiciously short."""
    c = F.col("description")
    has, figure = c.contains("restitution"), c.rlike(r"restitution in the amount of [$]")
    return e.groupBy("docket_id").agg((F.bool_or(has) & ~F.bool_or(figure)).alias("unreadable"), F.count_if(T.is_primary(c) & (F.length(c) < 1500)).alias("short_primary"))


# Keys in groups of four dockets: the one without a significance has the base, the others a suffix; and half of these an audit of it.
_GROUP = "cast(cast(floor(docket_id / 4) AS bigint) AS string)"
_SUFFIX = "CASE WHEN docket_id % 4 = 1 THEN '' ELSE '-' || cast(docket_id % 4 AS string) END"
_AUDIT = "CASE WHEN docket_id % 4 > 1 THEN '[dedupe] Absorbed sibling key(s) other, ' || {0} || ': drift' END"


def _drift(rows: str, key: str, name: str) -> str:
    keyed = f"(SELECT r.*, 'c' || cast(cast(floor(docket_id / 4) AS bigint) % 50 AS string) AS case_id, {key} AS base, {key} || {_SUFFIX} AS key, d.docket_number, d.court_id FROM (SELECT docket_id, status, {rows}) r LEFT JOIN (SELECT docket_id, docket_number, court_id FROM dockets_v) d USING (docket_id))"
    return (
        f"SELECT e.case_id, e.key AS {name}, CASE WHEN b.key IS NULL THEN 'rename' ELSE 'delete' END AS action, e.base AS new_key FROM {keyed} e LEFT JOIN {keyed} b ON b.case_id = e.case_id AND b.key = e.base "
        "WHERE e.key <> e.base AND CASE WHEN b.key IS NULL THEN e.docket_id % 4 > 1 ELSE e.start = b.start AND e.docket_number = b.docket_number AND e.court_id = b.court_id END"
    )


def _keyed(rows, key: str, name: str):
    case = F.expr("'c' || cast(cast(floor(docket_id / 4) AS bigint) % 50 AS string)")
    return rows.select("docket_id", "start", case.alias("case_id"), F.expr(f"{key} || {_SUFFIX}").alias(name), F.expr(_AUDIT.format(key)).alias("audit_notes"))


_HEARING_BASE, _DEADLINE_BASE = f"status || 'x' || {_GROUP}", f"cast(start AS string) || 'y' || {_GROUP}"


@query("hearings_v dockets_v", _drift("year(start_date) AS start FROM hearings_v", _HEARING_BASE, "hearing_key"))
def drifted_keys(h, d):
    """Suffixed keys whose base was absorbed or stands at the same start (a year here) of the same logical docket."""
    return state.drifted_keys(_keyed(h.withColumn("start", F.year("start_date")), _HEARING_BASE, "hearing_key"), d, "hearing_key", "start")


@query("deadlines_v dockets_v", _drift("year(due_date) AS start FROM deadlines_v", _DEADLINE_BASE, "deadline_key"))
def drifted_deadline_keys(l, d):  # noqa: E741
    return state.drifted_keys(_keyed(l.withColumn("start", F.year("due_date")), _DEADLINE_BASE, "deadline_key"), d, "deadline_key", "start")


_WHOLE = [
    "docket_id AS n", "'[e' || cast(docket_id AS string) || ']' AS push_id", "CASE docket_id % 8 WHEN 1 THEN 'a notice' WHEN 2 THEN 'minute entry ' || cast(docket_id AS string) WHEN 3 THEN 'minutes of ' || cast(docket_id AS string) END AS notes",
    "CASE WHEN docket_id % 3 = 0 THEN 'Own title ' || cast(docket_id AS string) ELSE 'spelt' END AS title", "docket_id % 3 > 0 AS derived",
]
_ROWS = f"(SELECT r.*, {', '.join('r.' + x if x.startswith('docket_id AS') else x for x in _WHOLE)}, 'c' || cast(cast(floor(docket_id / 4) AS bigint) % 50 AS string) AS case_id, {_HEARING_BASE} AS base, {_HEARING_BASE} || {_SUFFIX} AS key, {_AUDIT.format(_HEARING_BASE)} AS audit, d.docket_number, d.court_id FROM (SELECT docket_id, status, year(start_date) AS start FROM hearings_v) r LEFT JOIN (SELECT docket_id, docket_number, court_id FROM dockets_v) d USING (docket_id))"
_ACTED = f"(SELECT e.*, CASE WHEN e.key = e.base THEN NULL WHEN b.key IS NULL AND e.docket_id % 4 > 1 THEN 'rename' WHEN b.key IS NOT NULL AND e.start = b.start AND e.docket_number = b.docket_number AND e.court_id = b.court_id THEN 'delete' END AS action FROM {_ROWS} e LEFT JOIN {_ROWS} b ON b.case_id = e.case_id AND b.key = e.base)"
_IS_RECORD = "(notes LIKE 'minute%')"


@query(
    "hearings_v dockets_v",
    f"SELECT case_id, home AS hearing_key, max(CASE WHEN own THEN docket_id END) AS docket_id, array_to_string(list_sort(list_distinct(flatten(list([docket_id, docket_id + 1])))), ',') AS sources, "
    f"CASE WHEN bool_or(own AND coalesce({_IS_RECORD}, false)) THEN max(CASE WHEN own THEN notes END) ELSE coalesce(arg_min(notes, key) FILTER (NOT own AND {_IS_RECORD}), max(CASE WHEN own THEN notes END)) END AS notes, "
    "CASE WHEN bool_or(own AND derived AND action = 'rename') THEN 'new ' || home WHEN bool_or(own AND derived) THEN coalesce(arg_min(title, key) FILTER (NOT own AND NOT derived), max(CASE WHEN own THEN title END)) ELSE max(CASE WHEN own THEN title END) END AS title, "
    "nullif(concat_ws(chr(10) || chr(10), max(CASE WHEN own THEN audit END), string_agg('[heal-drift] Absorbed drift sibling key ' || key || ' at same UTC slot ' || cast(start AS string), chr(10) || chr(10) ORDER BY key) FILTER (NOT own)), '') AS audit_notes, "
    "max(CASE WHEN own AND action IS DISTINCT FROM 'rename' THEN push_id END) AS push_id FROM "
    f"(SELECT *, CASE WHEN action = 'delete' OR (action = 'rename' AND place = 1) THEN base ELSE key END AS home, action IS DISTINCT FROM 'delete' AS own FROM (SELECT * REPLACE (CASE WHEN action = 'rename' AND place > 1 THEN NULL ELSE action END AS action) FROM (SELECT *, row_number() OVER (PARTITION BY case_id, base, action ORDER BY key) AS place FROM {_ACTED} a) p) q) z GROUP BY case_id, home",
)
def healed_keys(h, d):
    """Whole rows after the repair of drifted keys: renamed with a new title, or folded with sources, record, title and audit line."""
    whole = h.withColumn("start", F.year("start_date")).selectExpr("docket_id", "status", "start", *_WHOLE)
    keyed = whole.select("*", F.expr("'c' || cast(cast(floor(docket_id / 4) AS bigint) % 50 AS string)").alias("case_id"), F.expr(f"{_HEARING_BASE} || {_SUFFIX}").alias("hearing_key"), F.expr(_AUDIT.format(_HEARING_BASE)).alias("audit_notes"), F.array("docket_id", F.col("docket_id") + 1).alias("source_entry_ids"))
    out = state.healed_keys(keyed, d, "hearing_key", "start", lambda key, case: F.concat(F.lit("new "), key))
    return out.select("case_id", "hearing_key", "docket_id", F.array_join(F.array_sort("source_entry_ids").cast("array<string>"), ",").alias("sources"), "notes", "title", "audit_notes", "push_id")


_DATED = "description || ' on ' || cast(month(date_filed) AS string) || '/' || cast(day(date_filed) AS string) || '/' || cast(year(date_filed) AS string)"


@query(
    "hearings_v entries_v",
    f"SELECT case_id, hearing_key, arg_min(t, (-length(t), entry_id)) AS new_notes FROM (SELECT case_id, hearing_key, docket_id, min(date_filed) AS d FROM hearings_v JOIN entries_v USING (docket_id) WHERE status = 'held' AND significance IS DISTINCT FROM 'minor' GROUP BY ALL) h "
    f"JOIN (SELECT docket_id, entry_id, {_DATED} AS t FROM entries_v WHERE starts_with(description, 'MINUTE ENTRY')) e USING (docket_id) WHERE entry_id <= docket_id * 10 + 4 AND (contains(t, strftime(d, '%-m/%-d/%Y')) OR contains(t, strftime(d, '%m/%d/%Y'))) GROUP BY case_id, hearing_key",
)
def better_notes(h, e):
    """Held rows have no notes here and are dated by their docket's first entry; minor ones are sentencings, which no record names."""
    first = e.groupBy("docket_id").agg(F.min("date_filed").alias("start_date"))
    rows = h.drop("start_date").join(first, "docket_id").withColumn("notes", F.when(F.col("status") != "held", F.col("notes")))
    rows = rows.withColumn("title", F.when(F.col("significance") == "minor", "Sentencing").otherwise(F.col("title")))
    rows = rows.withColumn("source_entry_ids", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.col("docket_id") * 10 + i))
    return state.better_notes(rows, e.withColumn("description", F.expr(_DATED)))


@query("hearings_v", "SELECT case_id, hearing_key, 'major' AS new FROM hearings_v WHERE significance IS NULL AND docket_id % 2 = 1")
def significance_backfill(h):
    return heals.significance(h, h.where("docket_id % 2 = 1").withColumn("significance", F.lit("major")))
