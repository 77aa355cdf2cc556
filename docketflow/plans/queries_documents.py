"""Queries over titles, documents of entries, feeds' lines, logs and run figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import text as T
from docketflow.operators import documents, feed, ingest, runs, titles
from docketflow.plans.queries_ingest import _disposition, _due, _hit
from docketflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle

# Keys of four forms; one person a case, or two in cases with an odd number.
_KEYED = (
    "(SELECT case_id, docket_id, docket_id % 4 AS form, CASE WHEN cast(replace(case_id, 'case-', '') AS bigint) % 2 = 1 AND docket_id % 3 = 0 THEN 'jones' ELSE 'smith' END AS name FROM hearings_v) k"
)
_SEVERAL = f"(SELECT case_id, count(DISTINCT name) > 1 AS several FROM {_KEYED} WHERE form <> 2 GROUP BY case_id) n"


def _keyed(h):
    odd = F.replace("case_id", F.lit("case-"), F.lit("")).cast("long") % 2 == 1
    name = F.when(odd & (F.col("docket_id") % 3 == 0), "jones").otherwise("smith")
    form = F.col("docket_id") % 4
    key = F.when(form == 0, F.concat(F.lit("sentencing-"), name)).when(form == 1, F.concat(F.lit("status-conf-"), name)).when(form == 2, "msj-hearing-2").otherwise(name)
    return h.select("case_id", "docket_id", key.alias("hearing_key"), form.alias("form"))


@query(
    "hearings_v",
    "SELECT case_id, docket_id, CASE form WHEN 0 THEN 'Sentencing' || tail WHEN 1 THEN 'Status Conference' || tail WHEN 2 THEN 'Motion for Summary Judgment Hearing 2' ELSE cap END AS title FROM "
    f"(SELECT k.case_id, docket_id, form, upper(left(name, 1)) || substr(name, 2) AS cap, CASE WHEN coalesce(several, false) THEN ' - ' || upper(left(name, 1)) || substr(name, 2) ELSE '' END AS tail FROM {_KEYED} LEFT JOIN {_SEVERAL} ON n.case_id = k.case_id) t",
)
def fallback_titles(h):
    rows = _keyed(h)
    both = rows.join(titles.case_names(rows), "case_id")
    return both.select("case_id", "docket_id", titles.hearing_title(F.col("hearing_key"), F.col("several")).alias("title"))


@query(
    "hearings_v",
    "SELECT k.case_id, CASE form WHEN 0 THEN 'sentencing-' || name WHEN 1 THEN 'status-conf-' || name ELSE 'msj-hearing-2' END AS hearing_key, "
    "CASE form WHEN 0 THEN 'Sentencing ' || cap WHEN 1 THEN 'Status Conf ' || cap ELSE 'Msj Hearing 2' END AS old, "
    "CASE form WHEN 0 THEN 'Sentencing' || tail WHEN 1 THEN 'Status Conference' || tail ELSE 'Motion for Summary Judgment Hearing 2' END AS new FROM "
    f"(SELECT k.*, upper(left(name, 1)) || substr(name, 2) AS cap, CASE WHEN coalesce(several, false) THEN ' - ' || upper(left(name, 1)) || substr(name, 2) ELSE '' END AS tail FROM {_KEYED} LEFT JOIN {_SEVERAL} ON n.case_id = k.case_id) k WHERE form < 3 AND docket_id % 5 < 3",
)
def healed_titles(h):
    """Plain titles of two fifths of the hearings and more; the others have one of their own."""
    rows = _keyed(h)
    return titles.healed_titles(rows.withColumn("title", F.when(F.col("docket_id") % 5 < 3, T.key_title(F.col("hearing_key"))).otherwise("Hearing (CIPA)")))


_D_KEY = "CASE docket_id % 4 WHEN 0 THEN 'govt-response-' WHEN 1 THEN 'msj--reply-' WHEN 2 THEN 'status-conf-report-' ELSE 'brief-' END || cast(docket_id AS string)"


@query(
    "deadlines_v",
    "SELECT case_id, key AS deadline_key, old, new FROM (SELECT case_id, " + _D_KEY + " AS key, docket_id, CASE docket_id % 4 WHEN 0 THEN 'Govt Response ' WHEN 1 THEN 'Msj  Reply ' WHEN 2 THEN 'Status Conf Report ' ELSE 'Brief ' END || cast(docket_id AS string) AS old, "
    "CASE docket_id % 4 WHEN 0 THEN 'Government Response ' WHEN 1 THEN 'Motion for Summary Judgment Reply ' WHEN 2 THEN 'Status Conference Report ' ELSE 'Brief ' END || cast(docket_id AS string) AS new FROM deadlines_v) d WHERE old <> new AND docket_id % 3 > 0",
)
def healed_deadline_titles(l):  # noqa: E741
    """Plain titles of two thirds of the deadlines; the others have one of their own."""
    rows = l.select("case_id", F.expr(_D_KEY).alias("deadline_key"), "docket_id")
    return titles.healed_deadline_titles(rows.withColumn("title", F.when(F.col("docket_id") % 3 > 0, T.key_title(F.col("deadline_key"))).otherwise("Answer due")))


@query(
    "url_checks_v",
    "SELECT page_id, CASE WHEN length(line) <= 75 THEN line ELSE left(line, 75) || regexp_replace(substr(line, 76), '.{1,74}', chr(13) || chr(10) || ' \\0', 'g') END AS line FROM (SELECT page_id, 'X-LINK:' || url || ' ' || url || ' ' || url AS line FROM url_checks_v) u",
)
def folded_lines(u):
    return u.select("page_id", feed.folded(F.concat(F.lit("X-LINK:"), F.concat_ws(" ", "url", "url", "url"))).alias("line"))


@query(
    "url_checks_v",
    "SELECT page_id, 'webcal://' || regexp_replace(url, '^https?://', '') || '/c' || cast(page_id AS string) || '.ics' AS webcal, url || '/c' || cast(page_id AS string) || '.ics' AS https, 'c' || cast(page_id AS string) || '.ics' AS relative FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS url FROM url_checks_v) u",
)
def feed_links(u):
    links = feed.subscribe_links(F.concat(F.lit("/feeds/c"), F.col("page_id").cast("string"), F.lit(".ics")), F.col("url"))
    return u.select("page_id", links.alias("l")).select("page_id", "l.*")


_ABOUT = (
    "(SELECT entry_id, doc_id, attachment, is_sealed, plain_text, CASE doc_id % 4 WHEN 0 THEN 'INDICTMENT as to one' WHEN 1 THEN 'Exhibit' WHEN 2 THEN 'PLEA AGREEMENT' ELSE 'Notice' END AS description, "
    "CASE WHEN doc_id % 3 = 0 THEN 'https://store.example/' || cast(doc_id AS string) || '.pdf' WHEN doc_id % 3 = 1 THEN 'https://mirror.example/' || cast(doc_id AS string) END AS url, "
    "cast(entry_id AS string) || CASE WHEN attachment = 0 THEN '' ELSE '-' || cast(attachment AS string) END AS label FROM docs_v) d"
)


def _about(d):
    description = F.element_at(F.array(F.lit("INDICTMENT as to one"), F.lit("Exhibit"), F.lit("PLEA AGREEMENT"), F.lit("Notice")), (F.col("doc_id") % 4 + 1).cast("int"))
    stored = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).otherwise("")
    mirror = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("https://mirror.example/"), F.col("doc_id").cast("string")))
    url = documents.document_url("https://store.example/", stored, mirror)
    return d.select("entry_id", "doc_id", F.col("entry_id").alias("number"), "attachment", "is_sealed", F.col("plain_text").alias("text"), description.alias("description"), url.alias("url"))


@query("docs_v", f"SELECT entry_id, doc_id, label, coalesce(url, '') AS url, CASE WHEN is_sealed THEN 'sealed' WHEN url IS NULL THEN 'not yet available' ELSE '' END AS status FROM {_ABOUT}")
def document_links(d):
    return documents.link_rows(_about(d))


_BLANK = "'^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$'"


@query(
    "docs_v",
    "SELECT entry_id, sha256(coalesce(a, b, c, '')) AS text_sha, url, sha256(coalesce(heads, '')) AS all_sha FROM (SELECT entry_id, string_agg(t, chr(10) || chr(10) ORDER BY rank, attachment, doc_id) FILTER (rank < 2) AS a, "
    "string_agg(t, chr(10) || chr(10) ORDER BY attachment, doc_id) FILTER (rank = 2) AS b, string_agg(t, chr(10) || chr(10) ORDER BY attachment, doc_id) FILTER (rank = 3) AS c, "
    "arg_min(url, (rank, attachment, doc_id)) FILTER (NOT is_sealed AND url IS NOT NULL) AS url, string_agg('[doc ' || label || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY attachment, doc_id) AS heads FROM "
    f"(SELECT *, nullif(regexp_replace(plain_text, {_BLANK}, '', 'g'), '') AS t, CASE WHEN {_hit('description', 'PRIMARY')} THEN 0 WHEN doc_id % 4 = 2 THEN 1 WHEN attachment = 0 THEN 2 ELSE 3 END AS rank FROM {_ABOUT}) x GROUP BY entry_id) y",
)
def entry_documents(d):
    return documents.chosen(_about(d)).select("entry_id", F.sha2("text", 256).alias("text_sha"), "url", F.sha2("all_text", 256).alias("all_sha"))


_DECIDED = "(SELECT event_id, docket_id, type, hearing_key, significance, local_date FROM actions_v) a"


@query(
    "actions_v",
    f"SELECT docket_id, event_id AS entry_id, 0 AS pos, type, CASE WHEN event_id % 4 = 0 THEN '' ELSE hearing_key END AS key, coalesce(cast(local_date AS string), '') AS dates FROM {_DECIDED} WHERE type <> 'UPDATE_DETAILS' "
    f"UNION ALL SELECT docket_id, event_id, 2, 'MARK_FILED', 'd-1', '2024-01-02,2024-03-04' FROM {_DECIDED} WHERE event_id % 3 = 0",
)
def decision_log(a):
    """Log lines with one action, or three of which one is of no counted kind; a quarter have no key."""
    args = F.concat_ws(", ", F.when(F.col("event_id") % 4 != 0, F.col("hearing_key")), F.coalesce("significance", F.lit("major")), F.col("local_date").cast("string"))
    more = F.when(F.col("event_id") % 3 == 0, ", IGNORE(x), MARK_FILED(d-1, 2024-03-04, 2024-01-02)").otherwise("")
    line = F.concat(F.lit("INFO decisions extract docket="), F.col("docket_id").cast("string"), F.lit(" entry="), F.col("event_id").cast("string"), F.lit(' "a "b" -> c" -> '), F.col("type"), F.lit("("), args, F.lit(")"), more)
    found = runs.decisions(a.select(F.concat(F.lit("12:00 "), line).alias("value")).union(a.groupBy().agg(F.lit("12:00 INFO nothing decided"))))
    return found.select("docket_id", "entry_id", "pos", "type", "key", F.array_join("dates", ",").alias("dates"))


@query("truth_v", "SELECT cast(entry_id AS string) AS entry_id, CASE WHEN entry_id % 4 = 0 THEN 0 ELSE cast(h_scheduled AS int) END AS h_scheduled, CASE WHEN entry_id % 6 = 0 THEN 0 ELSE cast(d_set AS int) END AS d_set FROM truth_v WHERE entry_id % 7 <> 0 AND entry_id % 5 <> 0")
def scored_rows(t):
    """A count file with blanks, words for numbers, bad scans and unreviewed rows."""
    n = F.col("entry_id")
    text = t.select(
        F.concat(F.lit(" "), n.cast("string")).alias("entry_id"), F.when(n % 7 == 0, "1").otherwise("").alias("bad_ocr"), F.when(n % 5 == 0, "0").otherwise("1").alias("reviewed"),
        F.when(n % 4 == 0, "").otherwise(F.concat(F.col("h_scheduled").cast("string"), F.lit(" "))).alias("h_scheduled"), F.when(n % 6 == 0, "two").otherwise(F.col("d_set").cast("string")).alias("d_set"),
    )
    return runs.scored(text)


@query("entries_v dockets_v", "SELECT e.entry_id, 'north' AS provider, e.docket_id, entry_number, cast(date_filed AS string) AS date_filed, case_id, docket_number, court_id, e.entry_id % 3 AS h_scheduled FROM entries_v e LEFT JOIN dockets_v d ON d.docket_id = e.docket_id")
def entry_action_rows(e, d):
    counts = e.select(F.lit("north").alias("provider"), "entry_id", (F.col("entry_id") % 3).alias("h_scheduled"))
    return runs.entry_actions(counts, e, d).withColumn("date_filed", F.col("date_filed").cast("string"))


@query("entries_v dockets_v", f"SELECT cast(date_filed AS string) AS delivery, count(*) AS received, count(case_id) AS processed, count_if(case_id IS NOT NULL AND {_hit('description', 'HEARING')}) AS relevant, count(*) - count(case_id) AS unknown FROM entries_v e LEFT JOIN (SELECT * FROM dockets_v WHERE court_id <> 'unk') d ON d.docket_id = e.docket_id GROUP BY date_filed")
def delivery_stats(e, d):
    rows = e.select(F.col("date_filed").cast("string").alias("delivery"), "docket_id", "description")
    return runs.delivery_stats(rows, d.where("court_id <> 'unk'"), T.is_hearing(F.col("description")), "delivery")


@query("dockets_v entries_v", "SELECT case_id, count(*) AS dockets, count_if(d.court_id = 'mad') AS changed, cast(coalesce(sum(n), 0) AS bigint) AS entries, cast(max(m) AS string) AS newest FROM dockets_v d LEFT JOIN (SELECT docket_id, count(*) AS n, max(date_filed) AS m FROM entries_v GROUP BY docket_id) e ON e.docket_id = d.docket_id GROUP BY case_id")
def case_run_stats(d, e):
    return runs.case_stats(d, d.where("court_id = 'mad'"), e)


_PARTS = "SELECT entry_id, string_agg('|' || coalesce(source, '') || CASE WHEN is_available THEN '|True' ELSE '|False' END || CASE WHEN is_sealed THEN '|True' ELSE '|False' END || CASE WHEN regexp_matches(plain_text, '[^ \\t\\n\\x0B\\f\\r]') THEN '|1' ELSE '|0' END, '' ORDER BY attachment, doc_id) AS parts, string_agg(nullif(source, ''), ' | ' ORDER BY attachment, doc_id) AS said FROM docs_v GROUP BY entry_id"


@query("entries_v docs_v", f"SELECT e.entry_id, concat_ws(' | ', nullif(e.description, ''), nullif(e.short_description, ''), d.said) AS full_text, sha1(coalesce(e.description, '') || '|' || coalesce(e.short_description, '') || '|' || coalesce(cast(e.date_filed AS string), '') || coalesce(d.parts, '')) AS fingerprint FROM entries_v e LEFT JOIN ({_PARTS}) d USING (entry_id)")
def entries_with_documents(e, d):
    """Texts and fingerprints of entries with their documents' parts; a document is described by its source."""
    rows = documents.nested(e, d.withColumnsRenamed({"source": "description", "plain_text": "text"}))
    own = [F.col("description"), F.col("short_description")]
    return rows.select("entry_id", documents.full_text(*own, F.col("docs")).alias("full_text"), ingest.entry_fingerprint(*own, F.col("date_filed"), F.col("docs")).alias("fingerprint"))


_SAID = "CASE lang WHEN 'fr' THEN 'SUPERSEDING INDICTMENT' WHEN 'de' THEN 'Status conference set' ELSE source END"
_WHOLE = (
    "(SELECT e.entry_id, coalesce(nullif(trim(short_description), ''), nullif(trim(description), ''), '') AS head, concat_ws(' | ', nullif(description, ''), nullif(short_description, ''), d.said) AS body, coalesce(d.filed, false) AS filed FROM entries_v e LEFT JOIN "
    f"(SELECT entry_id, string_agg(nullif(said, ''), ' | ' ORDER BY attachment, doc_id) AS said, bool_or({_hit('said', 'PRIMARY')}) AS filed FROM (SELECT *, {_SAID} AS said FROM docs_v) s GROUP BY entry_id) d USING (entry_id)) w"
)


@query("entries_v docs_v", f"SELECT entry_id, CASE WHEN {_hit('body', 'HEARING')} OR {_due('body')} OR {_hit('head', 'PRIMARY')} OR filed OR {_disposition('head')} THEN body END AS kept FROM {_WHOLE}")
def retained_texts(e, d):
    """Texts kept of entries and their documents, which are described by their language here."""
    said = F.when(F.col("lang") == "fr", "SUPERSEDING INDICTMENT").when(F.col("lang") == "de", "Status conference set").otherwise(F.col("source"))
    return documents.retained(documents.nested(e, d.withColumnRenamed("plain_text", "text").withColumn("description", said)))
