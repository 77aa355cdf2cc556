"""Queries over listings of entries, documents and cases, and over what makes stored state stale."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import text as T
from docketflow.operators import ingest, listing, runs, state
from docketflow.plans.queries_ingest import _disposition, _hit
from docketflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle

CUTOFF = "1995-06-01"
_ORDER = "coalesce(date_filed, DATE '0001-01-01'), coalesce(entry_number, 1073741824), entry_id"
_OPEN_TEXT = "nullif(trim(coalesce(plain_text, '')), '')"


def _ids(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query("entries_v", f"SELECT entry_id, cast(date_filed AS string) AS date_filed, cast(row_number() OVER (PARTITION BY docket_id ORDER BY date_filed, entry_id) AS int) AS place FROM entries_v WHERE date_filed >= DATE '{CUTOFF}'")
def feed_scan(e):
    """Entries since the cutoff, each with its place in its docket by the fold's key."""
    from pyspark.sql import Window

    rows = listing.modified_since(e, "date_filed", CUTOFF)
    return rows.select("entry_id", F.col("date_filed").cast("string").alias("date_filed"), F.row_number().over(Window.partitionBy("docket_id").orderBy("seq")).alias("place"))


@query("dockets_v", "SELECT case_id, 'Name of ' || case_id AS name, 'cal-' || min(court_id) OVER (PARTITION BY case_id) AS calendar, cast(row_number() OVER (PARTITION BY case_id ORDER BY pos, docket_id) - 1 AS int) AS pos, docket_id FROM dockets_v")
def case_config(d):
    """Cases written as JSON objects and read back as one row a docket."""
    dockets = F.transform(F.array_sort(F.collect_list(F.struct("pos", "docket_id"))), lambda x: x["docket_id"])
    rows = d.groupBy("case_id").agg(dockets.alias("dockets"), F.min("court_id").alias("court"))
    one = F.struct(F.col("case_id").alias("id"), F.concat(F.lit("Name of "), "case_id").alias("name"), F.concat(F.lit("cal-"), "court").alias("calendar"), "dockets")
    return listing.case_config(rows.select(F.to_json(one).alias("value")))


@query("dockets_v", "SELECT case_id, coalesce(string_agg(DISTINCT CASE WHEN court_id = 'mad' THEN 'a@' || court_id END, ','), CASE WHEN min(court_id) <> 'azd' THEN 'c@' || min(court_id) ELSE '' END) AS notify_emails FROM dockets_v GROUP BY case_id")
def case_settings(d):
    """Addresses of the case, else of its calendar; one calendar has none."""
    own = F.array_distinct(F.array_compact(F.collect_list(F.when(F.col("court_id") == "mad", F.concat(F.lit("a@"), "court_id")))))
    cases = d.groupBy("case_id").agg(F.min("court_id").alias("calendar"), own.alias("notify_emails"))
    calendars = d.select(F.col("court_id").alias("calendar")).where("court_id <> 'azd'").distinct().withColumn("notify_emails", F.array(F.concat(F.lit("c@"), "calendar")))
    return listing.settings(cases, calendars, "notify_emails").select("case_id", _ids("notify_emails"))


@query("entries_v docs_v", "SELECT entry_id, coalesce(nullif(trim(short_description), ''), nullif(trim(description), ''), source, '') AS head FROM entries_v LEFT JOIN (SELECT entry_id, arg_min(source, (attachment, doc_id)) AS source FROM docs_v WHERE source IS NOT NULL GROUP BY entry_id) d USING (entry_id)")
def head_texts(e, d):
    return listing.head_texts(e, d, F.col("source"))


@query("docs_v", f"SELECT doc_id FROM docs_v WHERE attachment = 0 AND is_available AND NOT is_sealed AND {_OPEN_TEXT} IS NULL")
def stale_documents(d):
    return listing.stale_documents(d).select("doc_id")


@query("docs_v", f"SELECT doc_id, sha256(CASE WHEN attachment = 0 AND is_available AND NOT is_sealed AND {_OPEN_TEXT} IS NULL THEN 'fresh ' || cast(doc_id AS string) ELSE plain_text END) AS text_sha256 FROM docs_v")
def repaired_documents(d):
    fresh = d.select("doc_id", F.concat(F.lit("fresh "), F.col("doc_id").cast("string")).alias("plain_text"))
    return listing.repaired_documents(d, fresh).select("doc_id", F.sha2("plain_text", 256).alias("text_sha256"))


_CONTENT = f"(nullif(trim(description), '') IS NOT NULL OR nullif(trim(short_description), '') IS NOT NULL OR entry_id IN (SELECT entry_id FROM docs_v WHERE {_OPEN_TEXT} IS NOT NULL OR (NOT is_sealed AND docs_v.is_available)))"


@query("entries_v docs_v", f"SELECT entry_id, {_CONTENT} AS has_content FROM entries_v")
def content_filter(e, d):
    return listing.with_content(e, d).select("entry_id", "has_content")


@query("entries_v", f"SELECT docket_id, string_agg(cast(entry_id AS string), ',' ORDER BY {_ORDER}) AS entry_ids FROM entries_v GROUP BY docket_id")
def entry_order(e):
    return listing.ordered_entries(e, ["docket_id"]).select("docket_id", _ids("entry_ids"))


_FULLEST = (
    "(SELECT *, row_number() OVER (PARTITION BY docket_number, court_id, key ORDER BY length DESC, docket_id, entry_id) AS r FROM (SELECT e.*, d.docket_number, d.court_id, length(coalesce(description, '')) + coalesce(t.more, 0) AS length, "
    "CASE WHEN n.records = 1 THEN 'uid ' || cast(e.entry_id AS string) WHEN entry_number IS NOT NULL THEN 'num ' || cast(entry_number AS string) WHEN trim(coalesce(description, '')) <> '' THEN 'desc ' || cast(date_filed AS string) || ' ' || left(trim(description), 200) ELSE 'uid ' || cast(e.entry_id AS string) END AS key "
    "FROM entries_v e JOIN dockets_v d USING (docket_id) JOIN (SELECT docket_number, court_id, count(*) AS records FROM dockets_v GROUP BY ALL) n ON n.docket_number = d.docket_number AND n.court_id = d.court_id LEFT JOIN (SELECT entry_id, sum(length(plain_text)) AS more FROM docs_v GROUP BY entry_id) t ON t.entry_id = e.entry_id) k) f"
)


@query("entries_v docs_v dockets_v", f"SELECT docket_number, court_id, entry_id, cast(length AS bigint) AS text_length FROM {_FULLEST} WHERE r = 1")
def fullest_copies(e, x, d):
    return listing.fullest_copies(e, x, d).select("docket_number", "court_id", "entry_id", F.col("text_length").cast("long").alias("text_length"))


@query("entries_v docs_v dockets_v", f"SELECT docket_number, court_id, coalesce(string_agg(CASE WHEN c THEN cast(entry_id AS string) END, ',' ORDER BY {_ORDER}), '') AS entry_ids, count_if(NOT c) AS hidden FROM (SELECT *, {_CONTENT} AS c FROM {_FULLEST} WHERE r = 1) g GROUP BY docket_number, court_id")
def case_listing(e, x, d):
    return listing.case_listing(e, x, d).select("docket_number", "court_id", _ids("entry_ids"), "hidden")


@query("entries_v dockets_v", f"SELECT docket_number, court_id, first(entry_id ORDER BY {_ORDER}) AS first_entry, string_agg(cast(entry_id AS string), ',' ORDER BY {_ORDER}) AS entry_ids FROM entries_v JOIN dockets_v USING (docket_id) WHERE {_hit('description', 'PRIMARY')} GROUP BY docket_number, court_id")
def primary_documents(e, d):
    return listing.primary_documents(e, d, T.is_primary(F.col("description"))).select("docket_number", "court_id", "first_entry", _ids("entry_ids"))


@query("entries_v docs_v", f"SELECT entry_id, sha256(t) AS text_sha256 FROM (SELECT entry_id, coalesce(d.t, CASE WHEN {_disposition('description')} THEN coalesce(nullif(trim(short_description), ''), nullif(trim(description), '')) END) AS t FROM entries_v LEFT JOIN (SELECT entry_id, arg_min(regexp_replace(plain_text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), (attachment, doc_id)) AS t FROM docs_v WHERE regexp_replace(plain_text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') <> '' GROUP BY entry_id) d USING (entry_id)) x WHERE t IS NOT NULL")
def document_set(e, d):
    return listing.document_set(e, d, T.is_disposition(F.col("description"))).select("entry_id", F.sha2("text", 256).alias("text_sha256"))


@query("docs_v", "SELECT doc_id, 'D' || cast(row_number() OVER (PARTITION BY entry_id ORDER BY attachment, doc_id) AS string) AS ref, CASE WHEN lang <> 'fr' AND is_available THEN 'u' || cast(doc_id AS string) END AS url FROM docs_v")
def document_references(d):
    """Tokens of each entry's documents; those in one language are verdict forms here, and those not available have no url."""
    rows = d.select("entry_id", "doc_id", "attachment", F.when(F.col("lang") == "fr", "Jury Verdict Form").when(F.col("lang").isNotNull(), "Verdict").otherwise("the verdict  form").alias("description"), F.when(F.col("is_available"), F.concat(F.lit("u"), F.col("doc_id").cast("string"))).otherwise("").alias("url"))
    return listing.references(rows, ["entry_id"], [F.asc("attachment"), F.asc("doc_id")]).select("doc_id", "ref", "url")


@query("hearings_v docs_v", "SELECT case_id, hearing_key, string_agg(cast(d.doc_id AS string), ',' ORDER BY s.pos, d.attachment, d.doc_id) AS doc_ids FROM (SELECT case_id, hearing_key, 1 AS pos, docket_id AS entry_id FROM hearings_v UNION ALL SELECT case_id, hearing_key, 0, docket_id + 1 FROM hearings_v) s JOIN docs_v d ON d.entry_id = s.entry_id GROUP BY case_id, hearing_key")
def lineage_documents(h, d):
    rows = h.withColumn("source_entry_ids", F.array(F.col("docket_id") + 1, F.col("docket_id")))
    return listing.lineage_documents(rows, d, ["case_id", "hearing_key"]).select("case_id", "hearing_key", _ids("doc_ids"))


@query("dockets_v summaries_v", "SELECT case_id, docket_number, court_id, cast(row_number() OVER (PARTITION BY case_id ORDER BY p, i, docket_number, court_id) AS int) AS place, docket_ids, s.stale IS NOT NULL AS has_summary FROM (SELECT case_id, docket_number, court_id, min(pos) AS p, arg_min(docket_id, (pos, docket_id)) AS i, string_agg(cast(docket_id AS string), ',' ORDER BY pos, docket_id) AS docket_ids FROM dockets_v GROUP BY ALL) g LEFT JOIN summaries_v s USING (docket_number, court_id)")
def case_directory(d, s):
    return listing.directory(d, s).select("case_id", "docket_number", "court_id", "place", _ids("docket_ids"), "has_summary")


@query("hearings_v", "SELECT case_id, string_agg(hearing_key, ',' ORDER BY CASE WHEN status = 'cancelled' THEN DATE '0001-01-01' ELSE start_date END, hearing_key) AS keys FROM hearings_v GROUP BY case_id")
def case_by_start(h):
    """A case's rows by start; cancelled ones have none here."""
    return listing.by_start(h.withColumn("start_date", F.when(F.col("status") != "cancelled", F.col("start_date")))).select("case_id", _ids("keys"))


@query("hearings_v", "SELECT case_id, hearing_key, status FROM hearings_v WHERE status <> 'cancelled'")
def active_hearings(h):
    return h.where("status <> 'cancelled'").select("case_id", "hearing_key", "status")


_LANDED = f"({_hit('description', 'PRIMARY')} OR {_disposition('description')})"


@query("entries_v dockets_v summaries_v", f"SELECT docket_number, court_id, cast(since AS string) AS stale_since FROM summaries_v JOIN (SELECT docket_number, court_id, max(date_filed) AS since FROM entries_v JOIN dockets_v USING (docket_id) WHERE {_LANDED} GROUP BY docket_number, court_id) l USING (docket_number, court_id) WHERE since > generated_at")
def landed_documents(e, d, s):
    return state.landed(e, d, s).withColumn("stale_since", F.col("stale_since").cast("string"))


@query("summaries_v", "SELECT docket_number, court_id, CASE WHEN court_id = 'mad' THEN false ELSE stale END AS stale, cast(CASE WHEN court_id = 'mad' THEN DATE '1999-01-01' ELSE generated_at END AS string) AS generated_at FROM summaries_v")
def written_summaries(s):
    """One court's summaries written anew."""
    new = s.where("court_id = 'mad'").select("docket_number", "court_id", F.lit("1999-01-01").cast("date").alias("generated_at"))
    return state.summaries_after(s, new).withColumn("generated_at", F.col("generated_at").cast("string"))


@query("dockets_v summaries_v", "SELECT DISTINCT docket_number, court_id FROM dockets_v d WHERE NOT EXISTS (SELECT 1 FROM summaries_v s WHERE s.docket_number = d.docket_number AND s.court_id = d.court_id)")
def missing_summaries(d, s):
    return state.missing_summaries(d, s)


@query("dockets_v", "SELECT court_id, arg_max(docket_number, (date_modified, docket_id)) AS citation, arg_max(docket_id, (date_modified, docket_id)) AS seen_on FROM dockets_v GROUP BY court_id")
def court_dimension(d):
    """The courts as the dockets give them, the last word of each."""
    rows = d.select("court_id", F.col("docket_number").alias("citation"), F.col("docket_id").alias("seen_on"), "date_modified", "docket_id")
    return state.latest(rows, "court_id", F.struct("date_modified", "docket_id"), ["citation", "seen_on"])


@query("hearings_v dockets_v", "SELECT case_id, hearing_key FROM hearings_v WHERE case_id NOT IN (SELECT case_id FROM dockets_v WHERE court_id = 'azd')")
def cleared_rows(h, d):
    return state.cleared(h, d.where("court_id = 'azd'").select("case_id").distinct()).select("case_id", "hearing_key")


@query("entries_v dockets_v", "SELECT entry_id FROM entries_v WHERE docket_id NOT IN (SELECT docket_id FROM dockets_v WHERE court_id = 'unk')")
def pruned_entries(e, d):
    return state.pruned(e, d.where("court_id = 'unk'")).select("entry_id")


@query("entries_v", "SELECT entry_id FROM entries_v WHERE is_sealed")
def forced_entries(e):
    """Everything is stored; the sealed entries are to be read again."""
    e = e.withColumn("fingerprint", ingest.fingerprint(F.col("description"), F.col("short_description"), F.col("date_filed")))
    return ingest.unseen(e, state.forced(e, e.where("is_sealed")), "docket_id", "entry_id", "fingerprint").select("entry_id")


@query("hearings_v", "SELECT case_id, hearing_key AS event_key, CASE status WHEN 'scheduled' THEN 'new-' || hearing_key WHEN 'held' THEN 'old-' || hearing_key END AS push_id FROM hearings_v")
def push_ids(h):
    """Scheduled rows were inserted, cancelled ones taken back; held ones keep the id they had."""
    key = [F.col("case_id"), F.col("hearing_key").alias("event_key")]
    stored = h.where("status <> 'scheduled'").select(*key, F.concat(F.lit("old-"), "hearing_key").alias("push_id"))
    done = h.where("status <> 'held'").select(*key, F.when(F.col("status") == "scheduled", "insert").otherwise("cancel").alias("op"), F.when(F.col("status") == "scheduled", F.concat(F.lit("new-"), "hearing_key")).alias("push_id"))
    return state.push_ids(stored, done)


@query("hearings_v dockets_v", "SELECT DISTINCT 'cal-' || court_id AS calendar FROM dockets_v WHERE case_id IN (SELECT case_id FROM hearings_v WHERE status = 'cancelled')")
def affected_calendars(h, d):
    cases = d.select("case_id", F.concat(F.lit("cal-"), "court_id").alias("calendar"))
    return state.affected_calendars(h.where("status = 'cancelled'"), cases)


@query("hearings_v deadlines_v", "SELECT 'cal-' || status AS calendar, count(*) AS events FROM (SELECT status FROM hearings_v WHERE start_date IS NOT NULL AND (significance IS NULL OR significance <> 'minor') UNION ALL SELECT CASE status WHEN 'pending' THEN 'scheduled' WHEN 'passed' THEN 'held' ELSE 'cancelled' END FROM deadlines_v WHERE due_date IS NOT NULL) e GROUP BY status")
def rendered_events(h, d):
    """Events of each feed; a feed a status here."""
    from docketflow.operators import feed

    rows = feed.events(h, d).withColumn("calendar", F.concat(F.lit("cal-"), "status"))
    return rows.groupBy("calendar").agg(F.count("*").alias("events"))


_USED = "tokens_in AS a, tokens_out AS b, cached AS c, turn AS w"


@query(
    "calls_v",
    "SELECT conv_id, turn, CASE purpose WHEN 'extract' THEN a + c + w ELSE a END AS input, b AS output, CASE WHEN purpose <> 'verify' THEN c ELSE 0 END AS cached, CASE WHEN purpose = 'extract' THEN cast(w AS bigint) ELSE 0 END AS cache_write "
    f"FROM (SELECT conv_id, turn, purpose, {_USED} FROM calls_v) x",
)
def usage_normalized(c):
    """Answers in three shapes written as JSON, their usage read back as one."""
    text = lambda name: F.col(name).cast("string")
    messages = F.format_string('{"usage":{"input_tokens":%s,"output_tokens":%s,"cache_read_input_tokens":%s,"cache_creation_input_tokens":%s}}', text("tokens_in"), text("tokens_out"), text("cached"), text("turn"))
    completions = F.format_string('{"usage":{"prompt_tokens":%s,"completion_tokens":%s,"prompt_tokens_details":{"cached_tokens":%s}}}', text("tokens_in"), text("tokens_out"), text("cached"))
    plain = F.format_string('{"prompt_eval_count":%s,"eval_count":%s,"note":"x"}', text("tokens_in"), text("tokens_out"))
    shape = F.when(F.col("purpose") == "extract", "messages").when(F.col("purpose") == "summary", "completions").otherwise("chat")
    payload = F.when(shape == "messages", messages).when(shape == "completions", completions).otherwise(plain)
    return c.select("conv_id", "turn", state.usage(payload, shape).alias("u")).select("conv_id", "turn", "u.*")


@query("actions_v", "SELECT type AS label, count(*) AS calls, round(avg(coalesce(local_hour, 0)), 6) AS mean_seconds, date_diff('day', min(entry_date), max(entry_date)) AS wall_days FROM actions_v GROUP BY type")
def call_times(a):
    """Mean seconds (the hour stands for them) and wall time of each label."""
    rows = a.select(F.col("type").alias("label"), F.coalesce("local_hour", F.lit(0)).alias("seconds"), F.datediff("entry_date", F.lit("1970-01-01").cast("date")).alias("at"))
    return runs.call_times(rows).select("label", "calls", F.round("mean_seconds", 6).alias("mean_seconds"), F.col("wall").cast("long").alias("wall_days"))


@query("hearings_v", "SELECT status, cast(sum(CASE WHEN hearing_key LIKE '%-2' THEN 2 ELSE 1 END) AS bigint) AS absorbed FROM hearings_v GROUP BY status")
def absorbed_keys(h):
    """Keys that the rows' audit notes say were absorbed: their own, and the base of those with a suffix."""
    base = T.base_key(F.regexp_replace("hearing_key", "^h-([0-9]+)", "h$1"))
    said = F.when(F.col("hearing_key").endswith("-2"), F.concat("hearing_key", F.lit(", "), base, F.lit(": drift"))).otherwise(F.concat("hearing_key", F.lit(" at same UTC slot 10:00")))
    rows = h.withColumn("audit_notes", F.concat(F.lit("[dedupe] Absorbed sibling key(s) "), said))
    return rows.groupBy("status").agg(F.sum(F.size(T.absorbed_keys(F.col("audit_notes")))).alias("absorbed"))


@query("actions_v", "SELECT event_id, entry_text, regexp_matches(entry_text, 'minute entry|held before', 'i') OR contains(lower(entry_text), 'proceedings held') AS record, CASE WHEN contains(entry_text, 'TRANSCRIPT') THEN 1 ELSE 0 END AS rank, starts_with(entry_text, 'NOTICE') AS admin_notice, CASE hearing_type WHEN 'sentencing' THEN 'sentencing' WHEN 'trial' THEN 'trial' WHEN 'status_conference' THEN 'status conference' ELSE '' END AS kinds FROM actions_v")
def proceeding_marks(a):
    """Records, transcripts and notices among the entries, and the kinds that a row's title signals."""
    c = F.col("entry_text")
    return a.select("event_id", "entry_text", T.records_proceeding(c).alias("record"), T.record_rank(c).alias("rank"), T.is_admin_notice(c).alias("admin_notice"), F.array_join(T.proceeding_types(F.replace("hearing_type", F.lit("_"), F.lit(" "))), ",").alias("kinds"))


@query("events_v", "SELECT count_if(k % 10 <> 0) AS good, count_if(k % 10 = 0) AS bad FROM events_v")
def quarantined_entries(v):
    """Deliveries of which some are broken JSON: the good ones go on, the others are kept aside."""
    text = F.when(F.col("k") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    good, bad = state.quarantined(v.select(text.alias("value")), F.col("value"), "struct<k:bigint>", ["k"])
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))  # one row each


@query("hearings_v", "SELECT case_id, coalesce(arg_min(CASE WHEN docket_id IS NOT NULL THEN title END, (-length(title), hearing_key)), '') AS title FROM hearings_v GROUP BY case_id")
def best_titles(h):
    """The title a merged case row would take: its own only spells a key, all others are explicit."""
    one = F.struct(F.col("hearing_key").alias("key"), "title", F.lit(False).alias("derived"))
    rows = h.groupBy("case_id").agg(F.collect_list(one).alias("t"))
    return rows.select("case_id", T.best_title(F.col("t"), F.lit("Sentencing 2"), F.lit(True)).alias("title"))
