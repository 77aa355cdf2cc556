"""Queries over entries, documents and dockets: ingest, gates, context joins, upkeep."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docketflow.functions import text as T
from docketflow.operators import audit, context, documents, guards, ingest, sweeps
from docketflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle

_FP = "sha1(concat(coalesce(description,''),'|',coalesce(short_description,''),'|',cast(date_filed AS string)))"
_NAMES = (
    "HEARING", "DEADLINE", "DEADLINE_FORMS", "PRIMARY", "DISPOSITION_HEAD", "DISPOSITION_WORDS", "DISPOSITION_NOT", "RULING_HEAD", "RULING_NOT", "REFERENCES", "ENTERED",
    "TRANSCRIPT", "SETS_DATES", "ORDER", "DETAIL", "PAGE_STAMP",
)
# The oracle's regular expressions know the flags i and m alone.
_RE = {k: getattr(T, k).replace("(?iU)", "(?i)").replace("(?imdU)", "(?im)").replace("'", "''") for k in _NAMES}


def _hit(c, name):
    return f"regexp_matches({c}, '{_RE[name]}')"


def _due(c):
    return f"({_hit(c, 'DEADLINE')} OR {_hit(c, 'DEADLINE_FORMS')})"


def _disposition(c):
    return f"(NOT {_hit(c, 'DISPOSITION_NOT')} AND ({_hit(c, 'DISPOSITION_HEAD')} OR {_hit(c, 'DISPOSITION_WORDS')}))"


def _ruling(c):
    return f"(NOT {_hit(c, 'DISPOSITION_NOT')} AND NOT {_hit(c, 'RULING_NOT')} AND ({_hit(c, 'DISPOSITION_HEAD')} OR ({_hit(c, 'RULING_HEAD')} AND {_hit(c, 'DISPOSITION_WORDS')})))"


_NOTICE = f"regexp_replace(coalesce(description, '') || ' ' || coalesce(short_description, ''), '{_RE['ENTERED']}', '', 'g')"
_TEXT = "concat_ws(' | ', nullif(trim(description), ''), nullif(trim(short_description), ''))"


def _body(e):
    return T.entry_text(F.col("description"), F.col("short_description"))


@query("entries_v", f"SELECT docket_id, entry_id, {_FP} AS fingerprint FROM entries_v WHERE entry_id % 3 <> 0 OR description = ''")
def unseen_entries(e):
    """Entries whose fingerprint is not stored; every third was, before its blank description was filled in."""
    e = e.withColumn("fingerprint", ingest.fingerprint(F.col("description"), F.col("short_description"), F.col("date_filed")))
    seen = e.where("entry_id % 3 = 0 AND description <> ''")
    return ingest.unseen(e, seen, "docket_id", "entry_id", "fingerprint").select("docket_id", "entry_id", "fingerprint")


@query("dockets_v entries_v", "SELECT docket_id, cast(date_modified AS string) AS date_modified FROM dockets_v LEFT JOIN (SELECT docket_id, max(date_filed) AS m FROM entries_v WHERE docket_id % 4 <> 0 GROUP BY docket_id) s USING (docket_id) WHERE m IS NULL OR date_modified > m")
def changed_dockets(d, e):
    stored = e.where("docket_id % 4 <> 0").groupBy("docket_id").agg(F.max("date_filed").alias("date_modified"))
    return ingest.changed(d.select("docket_id", "date_modified"), stored, "docket_id", "date_modified").select("docket_id", F.col("date_modified").cast("string").alias("date_modified"))


@query("dockets_v entries_v", "SELECT case_id, cast(min(f) AS string) AS first_filed, cast(max(m) AS string) AS last_filing FROM dockets_v LEFT JOIN (SELECT docket_id, min(date_filed) AS f, max(date_filed) AS m FROM entries_v GROUP BY docket_id) e USING (docket_id) GROUP BY case_id")
def case_aggregates(d, e):
    by_docket = e.groupBy("docket_id").agg(F.min("date_filed").alias("f"), F.max("date_filed").alias("m"))
    return d.join(by_docket, "docket_id", "left").groupBy("case_id").agg(F.min("f").cast("string").alias("first_filed"), F.max("m").cast("string").alias("last_filing"))


@query("entries_v", f"SELECT entry_id, {_TEXT} AS body, coalesce({_hit(_TEXT, 'HEARING')}, false) AS hearing, coalesce({_due(_TEXT)}, false) AS deadline FROM entries_v WHERE {_hit(_TEXT, 'HEARING')} OR {_due(_TEXT)}")
def extractable_entries(e):
    return T.gated(e, _body(e), "entry_id")


@query("entries_v", f"SELECT {_hit('description', 'PRIMARY')} AS is_primary, {_disposition('description')} AS disposition, {_ruling('description')} AS ruling, count(*) AS n FROM entries_v GROUP BY ALL")
def classified_entries(e):
    c = F.col("description")
    return e.groupBy(T.is_primary(c).alias("is_primary"), T.is_disposition(c).alias("disposition"), T.is_ruling(c).alias("ruling")).agg(F.count("*").alias("n"))


@query("entries_v docs_v", f"SELECT e.entry_id, d.doc_id FROM entries_v e JOIN docs_v d ON e.entry_id = d.entry_id WHERE CASE WHEN {_hit(_NOTICE, 'TRANSCRIPT')} THEN false WHEN {_hit(_NOTICE, 'SETS_DATES')} OR {_hit(_NOTICE, 'ORDER')} THEN true ELSE NOT {_hit(_NOTICE, 'DETAIL')} END AND CASE WHEN d.is_sealed THEN false WHEN coalesce(d.plain_text, '') <> '' THEN true ELSE d.is_available END")
def attachment_worklist(e, d):
    fetchable = d.where(T.fetchable(F.col("is_sealed"), F.col("plain_text"), F.col("is_available")))
    return documents.worklist(e, T.needs_attachment(T.notice(F.col("description"), F.col("short_description"))), fetchable)


# Every third document without an upload has no text yet.
_NO_TEXT = "CASE WHEN is_available OR doc_id % 2 = 0 THEN plain_text ELSE ' ' END"


@query("entries_v docs_v", f"SELECT e.entry_id FROM entries_v e WHERE trim(coalesce(description, '')) = '' AND date_filed >= DATE '1997-01-01' AND EXISTS (SELECT 1 FROM docs_v d WHERE d.entry_id = e.entry_id AND NOT d.is_sealed AND NOT d.is_available AND trim(coalesce({_NO_TEXT}, '')) = '')")
def placeholder_candidates(e, d):
    """Blank entries with a document that may still come: not sealed, not there, and without text."""
    pending = d.withColumn("plain_text", F.expr(_NO_TEXT)).where(T.pending(F.col("is_sealed"), F.col("is_available"), F.col("plain_text")))
    blank = T.blank_to_null(F.coalesce("description", F.lit(""))).isNull()
    return e.where(blank & (F.col("date_filed") >= F.lit("1997-01-01").cast("date"))).join(pending, "entry_id", "left_semi").select("entry_id")


@query("entries_v", f"SELECT entry_id, CASE WHEN {_hit('description', 'HEARING')} OR {_due('description')} OR {_hit('description', 'PRIMARY')} OR {_disposition('description')} THEN description END AS kept, {_FP} AS fingerprint FROM entries_v")
def body_retention(e):
    c = F.col("description")
    keep = T.is_hearing(c) | T.is_deadline(c) | T.is_primary(c) | T.is_disposition(c)
    return e.select("entry_id", F.when(keep, c).alias("kept"), ingest.fingerprint(c, F.col("short_description"), F.col("date_filed")).alias("fingerprint"))


_FIELDS = (
    "doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'x' || cast(doc_id AS string) WHEN 1 THEN NULL ELSE cast(10 - attachment AS string) END AS document_number, CASE WHEN attachment > 0 THEN attachment END AS attachment_number, "
    "CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || source || ' ' END AS description, CASE WHEN doc_id % 5 > 0 THEN is_available END AS is_available, is_sealed, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'ia/' || cast(doc_id AS string) END AS filepath_ia, "
    "CASE WHEN doc_id % 7 = 0 THEN 'local' END AS filepath_local, plain_text"
)
_NAMED = "concat_ws('|', cast(id AS string), coalesce(document_number, '-'), coalesce(cast(attachment_number AS string), '-'), coalesce(nullif(trim(description), ''), '-'), cast(coalesce(is_available, false) AS string), cast(is_sealed AS string), coalesce(nullif(filepath_ia, ''), '-'), coalesce(filepath_local, '-'), cast(length(nullif(regexp_replace(plain_text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '')) AS string))"


@query("docs_v", f"SELECT entry_id, string_agg({_NAMED}, ';' ORDER BY coalesce(try_cast(document_number AS int), 0), coalesce(attachment_number, 0), id) AS documents FROM (SELECT entry_id, {_FIELDS} FROM docs_v) d GROUP BY entry_id")
def nested_documents(d):
    """The nine kept fields of each entry's documents in order, some without a number that can be read."""
    rows = documents.compact_documents(d.selectExpr("entry_id", *re.split(r", (?=(?:CASE|is_sealed|plain_text|doc_id))", _FIELDS)))
    said = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    one = lambda x: F.concat_ws("|", *[said(x[c]) for c in documents.KEPT[:8]], F.length(x["plain_text"]).cast("string"))
    return rows.select("entry_id", F.array_join(F.transform("documents", one), ";").alias("documents"))


@query("docs_v", "SELECT doc_id, coalesce(length(plain_text) >= 100 AND length(regexp_replace(plain_text, '[^A-Za-z]', '', 'g')) >= 0.4 * length(regexp_replace(plain_text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AND length(regexp_replace(regexp_replace(plain_text, '" + _RE["PAGE_STAMP"] + "', '', 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) >= 100, false) AS usable, CASE WHEN is_sealed THEN 'sealed' WHEN NOT is_available THEN 'not available' WHEN plain_text = '' THEN 'unreadable' ELSE 'ok' END AS state FROM docs_v")
def text_quality(d):
    state = F.when(F.col("is_sealed"), "sealed").when(~F.col("is_available"), "not available").when(F.col("plain_text") == "", "unreadable").otherwise("ok")
    return d.select("doc_id", T.usable(F.col("plain_text")).alias("usable"), state.alias("state"))


_NORM = "regexp_replace(lower(regexp_replace(plain_text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"


@query("docs_v", f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN length({_NORM}) >= 100 THEN sha256({_NORM}) END AS fp FROM docs_v) x WHERE doc_id % 2 = 1 AND (fp IS NULL OR fp NOT IN (SELECT sha256({_NORM}) FROM docs_v WHERE doc_id % 2 = 0 AND length({_NORM}) >= 100))")
def extra_document_dedupe(d):
    """Pinned documents (odd ids) whose folded text the dockets (even ids) do not have."""
    d = d.select("doc_id", T.text_fingerprint(F.col("plain_text")).alias("fp"))
    have = d.where("doc_id % 2 = 0 AND fp IS NOT NULL").select("fp")
    return d.where("doc_id % 2 = 1").join(have, "fp", "left_anti").select("doc_id")


@query("docs_v", "SELECT doc_id FROM docs_v WHERE contains(lower(plain_text), 'the') AND contains(lower(plain_text), 'tion') AND contains(lower(source), 'src1')")
def search(d):
    haystack = F.lower(F.concat_ws(" ", "source", "plain_text"))
    terms = F.array(F.lit("the"), F.lit("tion"))
    return d.where(F.forall(terms, lambda t: F.contains(haystack, t)) & F.contains(F.lower("source"), F.lit("src1"))).select("doc_id")


@query("dockets_v courts_v", "SELECT docket_id, citation, coalesce(timezone, 'America/New_York') AS timezone FROM dockets_v LEFT JOIN courts_v USING (court_id)")
def court_enrichment(d, c):
    return context.with_court(d, c).select("docket_id", "citation", "timezone")


@query("entries_v", f"SELECT n.docket_id, n.entry_id, n.ref_number, b.entry_id AS ref_entry_id FROM (SELECT DISTINCT docket_id, entry_id, cast(unnest(regexp_extract_all(description, '{_RE['REFERENCES']}', 1)) AS bigint) AS ref_number FROM entries_v) n JOIN entries_v b ON b.docket_id = n.docket_id AND b.entry_number = n.ref_number AND b.description <> ''")
def cross_refs(e):
    return context.cross_references(e, T.references(F.col("description"))).select("docket_id", "entry_id", "ref_number", "ref_entry_id")


@query("entries_v", "SELECT a.docket_id, a.entry_id, coalesce(string_agg(cast(b.entry_id AS string), ',' ORDER BY b.date_filed DESC, b.entry_id DESC), '') AS prior FROM entries_v a LEFT JOIN (SELECT x.entry_id AS target, y.entry_id, y.date_filed, row_number() OVER (PARTITION BY x.entry_id ORDER BY y.date_filed DESC, y.entry_id DESC) AS r FROM entries_v x JOIN entries_v y ON x.docket_id = y.docket_id AND y.date_filed < x.date_filed AND y.description <> '') b ON b.target = a.entry_id AND b.r <= 5 GROUP BY a.docket_id, a.entry_id")
def prior_context_top5(e):
    return context.prior_context(e, 5).select("docket_id", "entry_id", F.array_join(F.col("prior").cast("array<string>"), ",").alias("prior"))


@query("hearings_v entries_v", "SELECT case_id, hearing_key, entry_id FROM (SELECT h.case_id, h.hearing_key, e.entry_id, row_number() OVER (PARTITION BY h.case_id, h.hearing_key ORDER BY e.date_filed DESC, e.entry_id DESC) AS r FROM hearings_v h JOIN entries_v e ON e.docket_id = h.docket_id AND e.date_filed BETWEEN h.start_date - 2 AND h.start_date + 45) x WHERE r <= 20")
def around_date_context(h, e):
    return context.around_date(h.select("case_id", "hearing_key", "docket_id", "start_date"), e)


@query("entries_v", "SELECT docket_id, string_agg(cast(entry_number AS string), ',' ORDER BY entry_id DESC) AS numbers FROM entries_v GROUP BY docket_id")
def lineage(e):
    rows = e.groupBy("docket_id").agg(F.reverse(F.array_sort(F.collect_list("entry_id"))).alias("source_entry_ids"))
    return context.lineage_numbers(rows, e, ["docket_id"]).select("docket_id", F.nullif(F.array_join(F.col("entry_numbers").cast("array<string>"), ","), F.lit("")).alias("numbers"))


@query("dockets_v", "SELECT docket_number, court_id, string_agg(cast(docket_id AS string), ',' ORDER BY date_modified DESC, docket_id DESC) AS docket_ids FROM dockets_v GROUP BY docket_number, court_id")
def docket_groups(d):
    return context.docket_groups(d).select("docket_number", "court_id", F.array_join(F.col("docket_ids").cast("array<string>"), ",").alias("docket_ids"))


@query("dockets_v entries_v", f"SELECT d.case_id, d.docket_id, g.docket_id AS from_docket FROM dockets_v d JOIN (SELECT case_id, docket_id, row_number() OVER (PARTITION BY case_id ORDER BY pos, docket_id) AS r FROM dockets_v WHERE docket_id IN (SELECT docket_id FROM entries_v WHERE {_hit('description', 'PRIMARY')})) g ON g.case_id = d.case_id AND g.r = 1 WHERE d.docket_id NOT IN (SELECT docket_id FROM entries_v WHERE {_hit('description', 'PRIMARY')})")
def sibling_borrow(d, e):
    return context.siblings_with_text(d, e.where(T.is_primary(F.col("description"))))


@query("url_checks_v")
def url_repair(u):
    """The url itself and its parent path, if it has two segments; the first that checks ok."""
    parent = F.when(F.col("url").rlike(r"^https?://[^/]+/[^/]+/[^/?#]+"), F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/[^/]*$", ""))
    candidates = u.select(F.col("page_id").alias("id"), F.posexplode(F.array_compact(F.array("url", parent))).alias("pos", "url"))
    return context.first_usable(candidates, u.select("url", "outcome").distinct())


ORACLE["url_repair"] = (
    "WITH u AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN '4xx' ELSE 'flake' END AS outcome FROM pages), "
    "c AS (SELECT page_id AS id, 0 AS pos, url FROM u UNION ALL SELECT page_id, 1, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') FROM u WHERE regexp_matches(url, '^https?://[^/]+/[^/]+/[^/?#]+')), "
    "s AS (SELECT c.id, c.pos, c.url, k.outcome FROM c LEFT JOIN (SELECT DISTINCT url, outcome FROM u) k USING (url)) "
    "SELECT id, coalesce(arg_min(url, pos) FILTER (outcome = 'ok'), CASE WHEN NOT coalesce(bool_or(outcome = '4xx'), false) THEN arg_min(url, pos) END) AS url FROM s GROUP BY id"
)


@query("dockets_v entries_v", "SELECT docket_id FROM (SELECT docket_id FROM entries_v UNION SELECT docket_id FROM dockets_v) x WHERE docket_id NOT IN (SELECT docket_id FROM dockets_v WHERE docket_id % 10 <> 3)")
def orphan_dockets(d, e):
    return ingest.orphans([e, d], d.where("docket_id % 10 <> 3"))


@query("dockets_v entries_v hearings_v summaries_v", "SELECT 'entries' AS table_name, count(*) AS n FROM entries_v WHERE docket_id % 4 < 2 UNION ALL SELECT 'hearings', count(*) FROM hearings_v WHERE docket_id % 4 < 2 UNION ALL SELECT 'summaries', count(*) FROM summaries_v s WHERE NOT EXISTS (SELECT 1 FROM dockets_v d WHERE d.docket_number = s.docket_number AND d.court_id = s.court_id AND d.docket_id % 4 >= 2)")
def prune_preview(d, e, h, s):
    return sweeps.prune_preview(d, d.where("docket_id % 4 < 2"), s, entries=e, hearings=h)


@query("dockets_v", "SELECT DISTINCT case_id FROM dockets_v WHERE docket_id % 5 = 0")
def only_new_cases(d):
    return ingest.only_new_cases(d, d.where("docket_id % 5 <> 0"))


@query("dockets_v docs_v", "SELECT doc_id, reason FROM docs_v JOIN dockets_v ON docket_id = doc_id CROSS JOIN (SELECT 'url' AS reason, 9 AS m UNION ALL SELECT 'note', 8 UNION ALL SELECT 'docket', 7) r WHERE doc_id % m = 0")
def config_violations(d, x):
    extra = x.join(d, d["docket_id"] == x["doc_id"]).select(
        F.when(F.col("doc_id") % 7 == 0, "case-none").otherwise(F.col("case_id")).alias("case_id"), "docket_id", "doc_id",
        F.when(F.col("doc_id") % 9 != 0, "u").alias("url"), F.when(F.col("doc_id") % 8 == 0, "  ").otherwise("n").alias("note"),
    )
    return ingest.violations(extra, d).select("doc_id", "reason")


@query("docs_v", "SELECT 'case-' || cast(entry_id AS string) AS case_id, string_agg(tag, ',' ORDER BY pos) AS tags FROM (SELECT entry_id, pos, tag, row_number() OVER (PARTITION BY entry_id, lower(tag) ORDER BY pos) AS r FROM (SELECT entry_id, attachment AS pos, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS tag FROM docs_v) a) b WHERE r = 1 GROUP BY entry_id")
def case_tags(d):
    tag = F.concat(F.lit(" "), F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")))
    return ingest.normalized_tags(d.select(F.concat(F.lit("case-"), F.col("entry_id").cast("string")).alias("case_id"), F.col("attachment").alias("pos"), tag.alias("tag")))


@query("entries_v", "SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN 'new ' || description ELSE description END AS description, CASE WHEN entry_id % 4 = 0 THEN 1 ELSE entry_number END AS entry_number FROM entries_v")
def snapshot_backfill(e):
    """Bodies overwritten from a full fetch of half the entries; numbers only where the fetch has one."""
    fetch = e.where("entry_id % 2 = 0").select("entry_id", F.concat(F.lit("new "), "description").alias("description"), F.when(F.col("entry_id") % 4 == 0, F.lit(1)).alias("entry_number"))
    return ingest.upsert(e, fetch, ["entry_id"], ["description"], ["entry_number"])


@query("dockets_v entries_v", "SELECT docket_id, cast(greatest(date_modified, coalesce(m, date_modified)) AS string) AS date_modified FROM dockets_v LEFT JOIN (SELECT docket_id, max(date_filed) AS m FROM entries_v GROUP BY docket_id) e USING (docket_id) UNION ALL SELECT docket_id, cast(max(date_filed) AS string) FROM entries_v WHERE docket_id NOT IN (SELECT docket_id FROM dockets_v) GROUP BY docket_id")
def docket_bump(d, e):
    newest = e.select("docket_id", F.col("date_filed").alias("date_modified"))
    return ingest.bumped(d, newest, "docket_id", "date_modified").select("docket_id", F.col("date_modified").cast("string").alias("date_modified"))


@query("entries_v dockets_v docs_v", "SELECT 'entries' AS table_name, count(*) AS n FROM entries_v UNION ALL SELECT 'dockets', count(*) FROM dockets_v UNION ALL SELECT 'documents', count(*) FROM docs_v")
def table_manifest(e, d, x):
    return ingest.manifest(entries=e, dockets=d, documents=x)


_CLAUSE = "regexp_replace(regexp_extract(description, '{0}[^;]*?([$][0-9,.]+[0-9])', 1, 'i'), '[$,]', '', 'g')"


@query("entries_v", f"SELECT entry_id, a AS amounts FROM (SELECT entry_id, {_CLAUSE.format('restitution')} AS a, {_CLAUSE.format('forfeiture')} AS b FROM entries_v) x WHERE a <> '' AND a = b")
def money_overlap(e):
    return audit.money_overlap(e)


# Dockets whose case is disposed of in the open; every other one, as most dockets here have some word of it.
_OPEN = f"(SELECT docket_id FROM entries_v WHERE {_disposition('description')} AND docket_id % 2 = 0)"
_SEAL_TEXT = "description || CASE WHEN docket_id % 3 = 0 THEN repeat(' of the United States', 15) ELSE '' END"


@query(
    "entries_v",
    f"SELECT docket_id, seal_entry, seal_number, cast(seal_date AS string) AS seal_date, CASE WHEN length(t) > 240 THEN rtrim(left(t, 237)) || '...' ELSE t END AS seal_text, later FROM (SELECT l.*, count_if(e.date_filed > seal_date AND e.is_available) AS later, bool_or(e.date_filed > seal_date AND regexp_matches(e.description, '\\border\\b[^.]*\\bgrant(s|ed|ing)\\b[^.]*\\bto\\s+unseal\\b', 'i')) AS lifted FROM "
    f"(SELECT docket_id, entry_id AS seal_entry, entry_number AS seal_number, date_filed AS seal_date, trim({_SEAL_TEXT}) AS t FROM entries_v WHERE regexp_matches(description, '\\border\\b[^.]*\\bgrant(s|ed|ing)\\b[^.]*\\bto\\s+seal\\b', 'i') QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY date_filed DESC, entry_id) = 1) l "
    f"JOIN entries_v e USING (docket_id) WHERE docket_id NOT IN {_OPEN} GROUP BY ALL) x WHERE NOT lifted AND later <= 3",
)
def sealing_advisory(e):
    """Dockets sealed in effect, by the text of entries (some with a long caption)."""
    disposed = e.where(T.is_disposition(F.col("description")) & (F.col("docket_id") % 2 == 0))
    return audit.sealing(e.withColumn("description", F.expr(_SEAL_TEXT)), disposed).withColumn("seal_date", F.col("seal_date").cast("string"))


@query("entries_v dockets_v", "SELECT docket_number, court_id, description, entry_id FROM (SELECT d.docket_number, d.court_id, e.description, e.entry_id, row_number() OVER (PARTITION BY d.docket_number, d.court_id, e.description ORDER BY e.is_available DESC, d.date_modified DESC, e.date_filed, e.entry_id) AS r FROM entries_v e JOIN dockets_v d USING (docket_id) WHERE e.description <> '') x WHERE r = 1")
def best_copy(e, d):
    return audit.best_copies(e, d)


@query("entries_v", "SELECT x.docket_id, x.ref FROM (SELECT DISTINCT docket_id, cast(unnest(regexp_extract_all(description, '[0-9]+')) AS bigint) AS ref FROM entries_v) x WHERE NOT EXISTS (SELECT 1 FROM entries_v e WHERE e.docket_id = x.docket_id AND e.entry_number = x.ref)")
def ungrounded_mentions(e):
    said = e.select("docket_id", F.explode(F.regexp_extract_all("description", F.lit("[0-9]+"), F.lit(0)).cast("array<long>")).alias("ref"))
    return audit.ungrounded(said, e.select("docket_id", F.col("entry_number").cast("long").alias("ref")), "docket_id", "ref")


_END = guards.NO_END.replace(r"\b[A-Z]", r"(?:^|[^\p{L}\p{N}_])[A-Z]").replace("'", "''")


@query(
    "docs_v",
    "SELECT doc_id, cast(g - 1 AS int) AS pos, string_agg(piece, ' ' ORDER BY i) AS sentence FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM "
    f"(SELECT *, CASE WHEN i > 1 AND regexp_matches(lag(piece) OVER (PARTITION BY doc_id ORDER BY i), '(?i){_END}$') THEN 0 ELSE 1 END AS fresh FROM "
    "(SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(plain_text, '([.!?])[\\s\\x0B\\x{85}\\p{Z}]+(" + guards.OPENING + ")', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM docs_v) a) b) c) d GROUP BY doc_id, g",
)
def sentence_split(d):
    return audit.sentences(d, "doc_id", "plain_text")
