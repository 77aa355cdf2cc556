"""Docket-shaped views over the generic tables, in SQL that Spark and the oracle both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PHRASES = [
    "MINUTE ENTRY for proceedings held before the judge: status hearing held",
    "ORDER granting 4 Motion to Continue; hearing reset as to docket entry 2",
    "NOTICE OF HEARING: sentencing set for 10:00 AM",
    "INDICTMENT as to defendant",
    "JUDGMENT as to defendant; restitution in the amount of $1,250.00 and forfeiture of $1,250.00",
    "TRANSCRIPT of proceedings re 3 Motion; redaction request due 2/14/2024",
    "MOTION to Seal Document",
    "ORDER granting 6 Motion to Seal",
    "Paperless order: response due by 03/01/2024",
    "Set/Reset Deadlines: brief due 04/05/2024",
    "Summons returned executed",
    "",
    "ORDER granting 1 Motion for Status Conference. (Entered: 05/06/2024 01:51 PM)",
    "APPELLANT BRIEF by Doe [Service Date: 04/08/2024]",
    "CLERK ORDER: docketing statement due 04/08/2024",
    "TRANSCRIPT ORDER FORM re 3",
    "PLEA AGREEMENT as to defendant",
    "Paperless ORDER adopting report and recommendation on change of plea; see 2",
    "Notice of appearance via zoom",
    "2 SUPERSEDING INDICTMENT as to defendant",
    "ORDER (Sealed) granting in part Motion to Seal as to all defendants",
    "ORDER granting 7 Motion to Unseal Case",
    "Sealed order. The court is granting leave to seal",
    # Near misses and other forms of what the gates look for.
    "Statuses of the parties are unchanged",
    "Arguments were not heard in this matter",
    "NOTICE of attorney appearance for the government",
    "Letter overdue by counsel; nothing due",
    "Reply brief of appellee filed under separate cover",
    "SECOND AMENDED COMPLAINT against all parties",
    "Motion for leave to file an amended complaint",
    "INFORMATION as to a single count",
    "Information sheet received from counsel",
    "VERDICT FORM returned by the jury",
    "Proposed verdict conference schedule",
    "ORDER OF DISMISSAL with prejudice",
    "Stipulation of facts for trial",
    "STIPULATION OF DISMISSAL by all parties",
    "Scheduling order: discovery cutoff and Markman dates; see 3",
    "ORDER setting trial date and briefing schedule",
    "MEMORANDUM OPINION denying 5 Motion to Dismiss",
    "Motion to dismiss conference call held over",
    "Official transcript filed; courtroom 9B at 2:30 PM",
    "Endorsed letter: application granted. So ordered",
    "Exhibit list, unendorsable",
    "Sentencing memorandum by the government; restitution of $25,000 and forfeiture of $90,000.50",
    "Judgment; restitution in the amount of $10.00; forfeiture of $10.00",
    "Order of restitution, amount to be determined",
    "Temporary restraining order dissolved; injunction vacated",
    "Mandate issued; affirmed in part",
    "Consent to videoconference by Zoom before Judge Roe",
    "Set for telephonic argument 10:15 via teleconference",
    "Motion in limine as to [12]; response to 11",
    "Order re 2 Motion to Extend granted in part (3) denied",
    "Case 1:24-cr-00001-ABC Document 7 Filed 01/02/24 Page 1 of 2 PageID: 9",
    "Notice of filing of official transcript of jury selection",
]
# What follows a sentence: with these, an entry has one of some hundreds of texts.
_ENDINGS = ["", " as to John Doe (1)", " as to Jane Roe (2), John Doe (1)", " (Attachments: 2 Exhibits)", ". (Entered: 02/03/2024)", " [4]", " re 5"]
_PHRASE = f"CASE l_partkey % {len(_PHRASES)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"
_ENDING = f"CASE WHEN l_partkey % {len(_PHRASES)} = {_PHRASES.index('')} THEN '' ELSE CASE l_suppkey % {len(_ENDINGS)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_ENDINGS)) + " END END"
_DESCRIPTION = f"{_PHRASE} || {_ENDING}"



def _day(d: str) -> str:
    months = "January February March April May June July August September October November December".split()
    name = f"CASE month({d}) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(months, 1)) + " END"
    return f"({name} || ' ' || cast(day({d}) AS string) || ', ' || cast(year({d}) AS string))"


def _slashes(d: str) -> str:
    return f"(cast(month({d}) AS string) || '/' || cast(day({d}) AS string) || '/' || cast(year({d}) AS string))"


# Two drafts a docket; the second of an even docket has no fault but the credit.
_DRAFTS = (
    f"SELECT k AS docket_id, attempt, 'Mr. Doe was indicted on ' || {_day('d')} || '. He owes ' || CASE WHEN bad AND k % 4 = 1 THEN '$1,250.00 in restitution, and a forfeiture money judgment of $1,250 against him.' ELSE '$900 in restitution.' END || "
    f"' Sentencing is scheduled for ' || CASE WHEN bad AND k % 5 = 0 THEN {_day('e')} ELSE {_day('d')} END || '.' || CASE WHEN k % 7 = 0 THEN ' The operator notes that he left.' ELSE '' END AS text, "
    f"'restitution 1,250.00 and 900' || CASE WHEN k % 3 = 0 AND k % 9 <> 0 THEN ' ' || {_slashes('d')} ELSE '' END || CASE WHEN k % 5 = 0 THEN ' ' || {_slashes('e')} ELSE '' END AS source, "
    "CASE WHEN k % 3 <> 0 OR (k % 9 = 0 AND NOT bad) THEN cast(d AS string) END AS known_date, cast(d AS string) AS hearing_date FROM "
    "(SELECT o_orderkey AS k, cast(o_orderdate AS date) AS d, cast(o_orderdate AS date) + 1 AS e, attempt, attempt = 1 OR o_orderkey % 2 = 1 AS bad FROM orders CROSS JOIN (SELECT 1 AS attempt UNION ALL SELECT 2) a) o"
)

#: name -> (tables it reads, SELECT).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "dockets_v": (
        ("orders",),
        "SELECT o_orderkey AS docket_id, 'dn-' || cast(cast(floor(o_orderkey / 4) AS bigint) AS string) AS docket_number, "
        "CASE o_custkey % 5 WHEN 0 THEN 'mad' WHEN 1 THEN 'cand' WHEN 2 THEN 'ilnd' WHEN 3 THEN 'azd' ELSE 'unk' END AS court_id, "
        "'case-' || cast(cast(floor(o_orderkey / 8) AS bigint) AS string) AS case_id, o_orderkey % 8 AS pos, "
        "cast(o_orderdate AS date) AS date_modified FROM orders",
    ),
    "courts_v": (
        (),
        "SELECT 'mad' AS court_id, 'D. Mass.' AS citation, 'America/New_York' AS timezone UNION ALL SELECT 'cand', 'N.D. Cal.', 'America/Los_Angeles' "
        "UNION ALL SELECT 'ilnd', 'N.D. Ill.', 'America/Chicago' UNION ALL SELECT 'azd', 'D. Ariz.', 'America/Phoenix' UNION ALL SELECT 'unk', NULL, NULL",
    ),
    "entries_v": (
        ("lineitem",),
        "SELECT l_orderkey AS docket_id, l_orderkey * 10 + l_linenumber AS entry_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linenumber END AS entry_number, "
        f"cast(l_shipdate AS date) AS date_filed, {_DESCRIPTION} AS description, "
        "CASE WHEN l_suppkey % 3 = 0 THEN 'short ' || cast(l_suppkey AS string) END AS short_description, l_partkey % 17 = 0 AS is_sealed, l_partkey % 3 <> 0 AS is_available FROM "
        "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey, l_linenumber) l",
    ),
    "actions_v": (
        ("events",),
        "SELECT event_id, 'case-' || cast(user_id % 50 AS string) AS case_id, 'h-' || cast(k % 7 AS string) || CASE WHEN k % 11 = 0 THEN '-2' ELSE '' END AS hearing_key, "
        "CASE event_type WHEN 'signup' THEN 'ADD_HEARING' WHEN 'click' THEN 'RESCHEDULE_HEARING' WHEN 'view' THEN 'UPDATE_DETAILS' WHEN 'purchase' THEN 'MARK_HELD' ELSE 'CANCEL_HEARING' END AS type, "
        "CASE WHEN k % 8 <> 7 THEN cast(ts AS date) + cast(k % 30 AS int) END AS local_date, CASE WHEN k % 2 = 0 THEN cast(k % 24 AS int) END AS local_hour, user_id AS docket_id, cast(ts AS date) AS entry_date, "
        "CASE WHEN k % 5 = 0 THEN 'minor' WHEN k % 5 = 1 THEN 'major' END AS significance, "
        "CASE user_id % 7 WHEN 4 THEN 'cand' WHEN 5 THEN NULL ELSE 'mad' END AS court_id, CASE user_id % 7 WHEN 4 THEN 'America/Los_Angeles' ELSE 'America/New_York' END AS timezone, "
        "CASE k % 4 WHEN 0 THEN 'sentencing' WHEN 1 THEN 'trial' WHEN 2 THEN 'status_conference' END AS hearing_type, CASE k % 6 WHEN 0 THEN 'Title ' || cast(k % 10 AS string) WHEN 1 THEN '' END AS title, "
        "CASE k % 5 WHEN 0 THEN 'bring exhibits' WHEN 1 THEN 'notice of zoom access' WHEN 2 THEN '' WHEN 3 THEN 'minutes of status conference' END AS notes, "
        "CASE k % 3 WHEN 0 THEN 'MINUTE ENTRY for proceedings held before the judge' WHEN 1 THEN 'NOTICE of hearing' ELSE 'TRANSCRIPT of proceedings held' END AS entry_text, "
        "CASE k % 7 WHEN 0 THEN 30 WHEN 1 THEN 0 END AS duration_minutes, CASE WHEN k % 4 = 1 THEN 'Judge ' || cast(k % 3 AS string) END AS judge, CASE WHEN k % 9 = 2 THEN 'Courtroom ' || cast(k % 5 AS string) END AS location, "
        "CASE WHEN k % 10 = 3 THEN 'dial ' || cast(k % 6 AS string) END AS dial_in, k % 13 = 0 AS conditional, CASE WHEN k % 3 = 1 THEN 'brief' END AS deadline_type "
        "FROM (SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k FROM events) e",
    ),
    "events_v": (("events",), "SELECT event_id, ts, user_id, event_type, props, cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k FROM events"),
    "docs_v": (
        ("documents",),
        "SELECT doc_id, CASE WHEN cast(floor(doc_id / 5) AS bigint) % 13 = 4 THEN '' ELSE coalesce(text, '') END AS plain_text, doc_id % 17 = 0 AS is_sealed, doc_id % 3 <> 0 AS is_available, "
        "cast(floor(doc_id / 5) AS bigint) AS entry_id, doc_id % 5 AS attachment, source, lang FROM documents",
    ),
    "calls_v": (
        ("conversations",),
        "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'extract' WHEN 'assistant' THEN 'summary' ELSE 'verify' END AS purpose, "
        "CASE conv_id % 5 WHEN 0 THEN 'small-1' WHEN 1 THEN 'large-2' WHEN 2 THEN CASE turn % 3 WHEN 0 THEN 'large-2-2025-01-15' WHEN 1 THEN 'small-1-002' ELSE 'large-2-20250101' END WHEN 3 THEN 'local:tiny' ELSE 'unlisted' END AS model, "
        "cast(length(text) AS bigint) AS tokens_in, cast(floor(length(text) / 4) AS bigint) AS tokens_out, CASE WHEN turn % 2 = 0 THEN cast(floor(length(text) / 2) AS bigint) ELSE 0 END AS cached, CASE WHEN turn % 2 = 1 THEN cast(floor(length(text) / 8) AS bigint) ELSE 0 END AS cache_write, "
        "CASE WHEN conv_id % 9 = 0 THEN NULL ELSE 'd-' || cast(conv_id % 7 AS string) END AS docket FROM conversations",
    ),
    "rates_v": ((), "SELECT 'small-1' AS model, 100 AS rate_in, 25 AS rate_cached, 0 AS rate_write, 400 AS rate_out UNION ALL SELECT 'large-2', 300, 75, 375, 1500"),
    "truth_v": (
        ("documents",),
        "SELECT doc_id AS entry_id, cast(floor(doc_id / 10) AS bigint) AS docket, doc_id % 3 AS h_scheduled, doc_id % 2 AS h_rescheduled, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS h_cancelled, doc_id % 4 AS h_held, "
        "doc_id % 5 AS d_set, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 0 END AS d_rescheduled, CASE WHEN doc_id % 8 = 3 THEN 1 ELSE 0 END AS d_cancelled, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS d_met FROM documents",
    ),
    # A provider has no row for an entry in the language it cannot read, and finds nothing in those of one source.
    "model_v": (
        ("documents",),
        "SELECT p.provider, d.doc_id AS entry_id, f * ((d.doc_id + p.shift) % 3) AS h_scheduled, f * ((d.doc_id + p.shift) % 2) AS h_rescheduled, f * (CASE WHEN d.doc_id % 22 = p.shift THEN 1 ELSE 0 END) AS h_cancelled, f * (d.doc_id % (3 + p.shift)) AS h_held, "
        "f * (d.doc_id % (4 + p.shift)) AS d_set, f * p.shift AS d_rescheduled, 0 AS d_cancelled, 0 AS d_met FROM (SELECT *, CASE WHEN source LIKE '%1' THEN 0 ELSE 1 END AS f FROM documents) d "
        "CROSS JOIN (SELECT 'north' AS provider, 0 AS shift, 'en' AS blind UNION ALL SELECT 'south', 1, 'fr' UNION ALL SELECT 'west', 2, 'de') p WHERE d.lang IS DISTINCT FROM p.blind",
    ),
    "hearings_v": (
        ("orders",),
        "SELECT 'case-' || cast(o_custkey % 200 AS string) AS case_id, 'h-' || cast(o_orderkey AS string) || CASE WHEN o_orderkey % 6 = 0 THEN '-2' ELSE '' END AS hearing_key, o_orderkey AS docket_id, "
        "cast(o_orderdate AS date) AS start_date, CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey % 9 + 9 AS int) ELSE 0 END AS start_hour, "
        "CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'held' ELSE 'cancelled' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'minor' WHEN 1 THEN NULL ELSE 'major' END AS significance, "
        "CASE WHEN o_orderkey % 3 = 0 THEN 60 END AS duration_minutes, 'Hearing ' || cast(o_orderkey % 5 AS string) AS title, o_orderpriority AS notes FROM orders",
    ),
    "deadlines_v": (
        ("orders",),
        "SELECT 'case-' || cast(o_custkey % 200 AS string) AS case_id, 'd-' || cast(o_orderkey AS string) AS deadline_key, o_orderkey AS docket_id, CASE WHEN o_orderkey % 19 <> 0 THEN cast(o_orderdate AS date) END AS due_date, "
        "CASE o_orderkey % 4 WHEN 0 THEN 'met' WHEN 1 THEN 'pending' WHEN 2 THEN 'passed' ELSE 'cancelled' END AS status, 'Deadline ' || cast(o_orderkey % 5 AS string) AS title FROM orders",
    ),
    "summaries_v": (
        ("orders",),
        "SELECT docket_number, court_id, min(docket_id) % 3 = 0 AS stale, max(date_modified) AS generated_at FROM (SELECT o_orderkey AS docket_id, 'dn-' || cast(cast(floor(o_orderkey / 4) AS bigint) AS string) AS docket_number, "
        "CASE o_custkey % 5 WHEN 0 THEN 'mad' WHEN 1 THEN 'cand' WHEN 2 THEN 'ilnd' WHEN 3 THEN 'azd' ELSE 'unk' END AS court_id, cast(o_orderdate AS date) AS date_modified FROM orders WHERE o_orderpriority <> '5-LOW') o GROUP BY docket_number, court_id",
    ),
    "drafts_v": (("orders",), _DRAFTS),
    "url_checks_v": (("pages",), "SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN '4xx' ELSE 'flake' END AS outcome FROM pages"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows.  Its tables are read by Spark; nothing is cached."""
    tables, sql = VIEWS[name]
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(names: str, sql: str) -> str:
    """``sql`` for the oracle with the named views before it."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names.split()) + " " + sql
