"""Text predicates and projections over entry and document columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the gates.  Matching is Unicode-aware, as the entries are.
HEARING = (
    r"(?iU)\b(hearing|sentenc\w*|arraignment|argu\w*|conference|trial|proceedings?|set\s*for|reset\s*for|scheduled\s*for|set/reset|"
    r"notice\s*of\s*hearing|notice\s*of\s*rescheduling|change\s*of\s*plea|initial\s*appearance|status|telephonic|videoconference|video conference|zoom|"
    r"mandates?|calendared|continued\s*to|continue\s*to|continued\s*until|vacated)\b"
)
DEADLINE = (
    r"(?iU)\b(due\s*by|due\s*on|due\s*no\s*later\s*than|shall\s*(?:file|respond|reply|submit|serve)|response\s*(?:is\s*)?due|reply\s*(?:is\s*)?due|"
    r"opposition\s*(?:is\s*)?due|brief\s*(?:is\s*)?due|appendix\s*(?:is\s*)?due|answer\s*(?:is\s*)?due|notice\s*(?:is\s*)?due|report\s*(?:is\s*)?due|"
    r"memo(?:randum)?\s*(?:is\s*)?due|material\s*(?:is\s*)?due|briefing\s*schedules?|briefing\s*orders?|scheduling\s*orders?|deadlines?|"
    r"motions?\b[^.\n]{0,80}\b(?:to|for)\s*(?:extend|extension)|extensions?\s*(?:of|granted|denied)|rehearing|mandates?|presentenc\w*|psr|cipa|jencks|"
    r"notice\s+of\s+appeal|disclosures?|discovery\s+(?:cutoff|cut-off|close|closes)|motions?\s+in\s+limine|class\s*cert(?:ification)?|"
    r"(?:joint\s+)?status\s+reports?|mediations?|pretrial\s+orders?|claim\s+construction|markman|stipulations?|stipulated|so\s*ordered|"
    r"file\s*(?:a|its|their)\s*(?:response|reply|opposition|brief|memorandum|answer|supplemental))\b"
)
DEADLINE_FORMS = (
    r"(?imdU)\bdue\s+(?:by\s+|on\s+|within\s+|no\s+later\s+than\s+)?(?:\d{1,2}[/-]\d|\d{4}\b|\d{1,2}\s+(?:business\s+)?days\b|"
    r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))|\[service\s+date:|^\s*(?:\d+\s+)?"
    r"(?:(?:petitioner|respondent|appellant|appellee|cross-?appell\w+|opening|answering|amended|corrected|supplemental|first|second|third|final|joint)\s+)*"
    r"(?:response|opposition|reply|sur-?reply|brief|proposed\s+order|notice\s+of\s+compliance)\b"
)
PRIMARY = (
    r"(?iU)^\s*(?:\d+\s+)?(?:[A-Z]+\s+)?(?:(?:SUPERSEDING|AMENDED|FIRST\sAMENDED|SECOND\sAMENDED|THIRD\sAMENDED|FOURTH\sAMENDED|CORRECTED|REDACTED|SEALED|UNSEALED)\s+)?"
    r"(?:INDICTMENT|INFORMATION|COMPLAINT|PETITION\sFOR\sWRIT|PETITION)\b"
)
DISPOSITION_HEAD = (
    r"(?iU)^\s*(?:\d+\s+)?(?:JUDGMENT|FINAL\sJUDGMENT|VERDICT\sFORM|VERDICT|ORDER\sOF\sDISMISSAL|ORDER\sGRANTING\sMOTION\sTO\sDISMISS|STIPULATION\sOF\sDISMISSAL|"
    r"STIPULATED\sDISMISSAL|NOTICE\sOF\sVOLUNTARY\sDISMISSAL|PLEA\sAGREEMENT|(?:FACTUAL\s+)?PROFFER\s+STATEMENT|"
    r"(?:AMENDED\s+)?REPORT\s+AND\s+RECOMMENDATIONS?\s+ON\s+(?:PLEA\s+OF\s+GUILTY|CHANGE\s+OF\s+PLEA)|SENTENCING\sJUDGMENT|SENTENCE|"
    r"SETTLEMENT\sAGREEMENT|MEMORANDUM\sOPINION|MEMORANDUM\sORDER|OPINION\sAND\sORDER|OPINION)\b"
)
DISPOSITION_WORDS = (
    r"(?iU)\b(?:sentencing|mistrials?|acquit(?:tals?|ted)|forfeitures?|nolle\s+prosequi|nolle\s+prossed|pled\s+guilty|pleads?\s+guilty|plea\s+of\s+guilty|"
    r"(?:report\s+and\s+recommendations?|r&r)\s+on\s+(?:plea\s+of\s+guilty|change\s+of\s+plea)|class\s+certification|remand(?:ed)?|entry\s+of\s+default|tros?|"
    r"temporary\s+restraining\s+orders?|injunctions?|judg(?:e)?ments?|decrees?|dismiss(?:al|als|ed)|mandates?|affirm(?:s|ed|ance|ances)?|reversed|vacated)\b"
)
DISPOSITION_NOT = r"(?iU)\bconferences?\b"
RULING_HEAD = (
    r"(?iU)^\s*(?:\d+\s+)?(?:(?:PAPERLESS|TEXT[\s-]?ONLY|TEXT|AMENDED|FINAL|PRELIMINARY|STIPULATED|CONSENT|DEFAULT|CORRECTED|REDACTED|SEALED|UNSEALED|"
    r"SUPERSEDING|INTERIM|TEMPORARY|PERMANENT)\s+)*(?:ORDER|JUDGMENT|JUDGEMENT|VERDICT|OPINION|MEMORANDUM\s+OPINION|MEMORANDUM\s+ORDER|MINUTE\s+ENTRY|"
    r"MINUTE\s+ORDER|ELECTRONIC\s+CLERK['’]?S\s+NOTES|CLERK['’]?S\s+NOTES|PLEA\s+AGREEMENT|SETTLEMENT\s+AGREEMENT|DECREE|INJUNCTION|MANDATE|NOLLE\s+(?:PROSEQUI|PROSSED))\b"
)
RULING_NOT = (
    r"(?iU)\b(?:motion\s+hearing\s+(?:re:?|held|on)|order\s+(?:re(?:garding|\s+\d+)?|on)\s+(?:joint\s+)?stipulation|"
    r"(?:order\s+|paperless\s+order\s+)?setting\s+(?:case|trial|sentencing|hearing|status|motion|briefing)|motion\s+(?:to|for)\s+continu|"
    r"continu(?:e|ing|ed|ance)\s+(?:sentencing|hearing|trial)|notice\s+of\s+(?:sentencing|hearing)\s+date)"
)
REFERENCES = r"(?iU)\b(?:granting|denying|grants|denies|granted|denied|ruling\s+on|see|re|response\s+to)\s+(?:in\s+part\s+)?(?:\[)?(\d{1,4})(?:\])?\b"
ENTERED = r"(?iU)[\(\[]Entered:[^\)\]]*[\)\]]"
TRANSCRIPT = (
    r"(?iU)\btranscript\s+order\b|\border\s+for\s+transcript\b|\btranscript\s+of\s+[^.\n]*?\bproceedings?\b|"
    r"\b(?:official|corrected|amended|redacted|rough)\s+transcript\b|\bnotice\s+of\s+filing\s+of\s+(?:official\s+)?transcript\b|\btranscript\s+filed\b"
)
SETS_DATES = (
    r"(?iU)\bgranting\b[^.]{0,80}?\bMotion\s+(?:for\s+Hearing|for\s+Continuance|for\s+Status\s+Conference|to\s+(?:Continue|Reschedule|Vacate|Set|Schedule|Adjourn))|"
    r"\bscheduling\s+order\b|\b(?:setting|re-?setting|amend(?:ing|ed)|modif(?:ying|ied)|adopting)\b[^.]{0,40}?\b(?:trial\s+date|(?:briefing|hearing|pretrial|case)\s+schedul)|"
    r"\bstipulation\b[^.]{0,80}?\b(?:trial\s+date|(?:briefing|hearing)\s+schedul|scheduling)|\btrial\s+date\s+and\s+(?:briefing|hearing|pretrial)\s+schedul"
)
ORDER = r"(?iU)\border\b|\bendors(?:ed|ement)\b"
DETAIL = r"(?iU)\b(\d{1,2}:\d{2}\s*(AM|PM)?|courtroom|judge|via\s+(zoom|teleconf|video))"
PAGE_STAMP = (
    r"(?iU)Case\s+\d+:\d+-[a-z]+-\d+(?:-\w+)?\s+Document\s+\d+(?:-\d+)?(?:\s+Filed\s+\d+/\d+/\d+)?(?:\s+Page\s+\d+\s+of\s+\d+)?(?:\s+Page\s*ID:?\s*\#?:?\s*\d+)?"
)
# What reads as the record of a held proceeding, as a transcript's filing and as a notice before it; the kinds of proceedings.
RECORD = (
    r"(?i)minute entry|minute order|minutes of|clerk'?s? notes|transcript\s+of\s+(?:[a-z ]*?\s)?proceedings?\s+held|"
    r"proceedings?\s+(?:were\s+)?held\s+(?:before|on)\b|held\s+before|stated\s+appearances|under\s+submission"
)
TRANSCRIPT_RECORD = r"(?i)transcript\s+of\s+(?:[a-z ]*?\s)?proceedings?\s+held"
ADMIN_NOTICE = (
    r"(?i)clerk'?s? notice|notice\s+(?:re|of)\b|zoom\s+(?:access|webinar|information|link)|providing\s+zoom|courtroom\s+change|audio\s+observation|access\s+information"
)
PROCEEDINGS = {
    "sentencing": r"sentenc", "status conference": r"status conf", "initial appearance": r"initial appearance", "arraignment": r"arraign", "plea": r"\bplea",
    "pretrial": r"pre ?trial", "trial": r"\btrial", "motion": r"motion|in limine|daubert|suppress", "show cause": r"show cause|\bosc\b",
    "charging conference": r"charging conf", "oral argument": r"oral arg", "evidentiary": r"evidentiary", "detention": r"detention",
}
PROCEEDING_NAME = r"(?i)minutes?\s+of\s+(.+?)(?:\s+(?:as to|held|before)\b|[.:]|$)|:\s*(.+?)(?:\s+(?:as to|held|before)\b|[.:]|$)"
ABSORBED = r"Absorbed sibling key\(s\)\s+(.+?)(?::| at same UTC slot|\n|$)"
MONEY = r"\$[0-9,]+(?:\.[0-9]{2})?"
# The proceedings that a person has once.
ONCE_ONLY = ("sentencing", "arraignment", "initial-appearance", "change-of-plea", "plea")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def entry_text(*parts: Column) -> Column:
    """The non-blank parts, joined by ' | '; '' if there is none."""
    return F.array_join(F.filter(F.array(*[F.coalesce(blank_to_null(p), F.lit("")) for p in parts]), lambda x: x != ""), " | ")


def _hits(text: Column, pattern: str) -> Column:
    """``rlike``; a text of ASCII is searched by the same pattern without the tables of Unicode, which cost more."""
    flags, rest = pattern.split(")", 1)
    return F.when(F.length(text) == F.octet_length(text), text.rlike(flags.replace("U", "") + ")" + rest)).otherwise(text.rlike(pattern))


def is_hearing(text: Column) -> Column:
    return F.coalesce(_hits(text, HEARING), F.lit(False))


def is_deadline(text: Column) -> Column:
    return F.coalesce(_hits(text, DEADLINE) | _hits(text, DEADLINE_FORMS), F.lit(False))


def gated(rows: DataFrame, body: Column, *kept: str) -> DataFrame:
    """``kept`` and the ``body`` of rows that are about a hearing or a deadline, with both flags; a body is made and searched once."""
    # As a generated row: a filter on computed columns would be pushed below them, and compute them twice.
    flags = F.transform(F.array(body), lambda b: F.struct(b.alias("body"), is_hearing(b).alias("hearing"), is_deadline(b).alias("deadline")))
    return rows.select(*kept, F.inline(flags)).where("hearing OR deadline")


def is_primary(head: Column) -> Column:
    return F.coalesce(head.rlike(PRIMARY), F.lit(False))


def is_disposition(head: Column) -> Column:
    """Any entry whose outcome changes where a case stands."""
    return F.coalesce(~head.rlike(DISPOSITION_NOT) & (head.rlike(DISPOSITION_HEAD) | head.rlike(DISPOSITION_WORDS)), F.lit(False))


def is_ruling(head: Column) -> Column:
    """The disposing document itself: no motion, schedule or notice about one."""
    said = head.rlike(DISPOSITION_HEAD) | (head.rlike(RULING_HEAD) & head.rlike(DISPOSITION_WORDS))
    return F.coalesce(~head.rlike(DISPOSITION_NOT) & ~head.rlike(RULING_NOT) & said, F.lit(False))


def notice(description: Column, short: Column) -> Column:
    """Both descriptions without the clerk's stamp of entry."""
    return F.regexp_replace(F.concat(F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(short, F.lit(""))), ENTERED, "")


def needs_attachment(text: Column) -> Column:
    """A cascade over a notice: transcripts never, schedules and orders always, others unless they give the details."""
    return F.when(text.rlike(TRANSCRIPT), False).when(text.rlike(SETS_DATES) | text.rlike(ORDER), True).otherwise(~text.rlike(DETAIL))


def fetchable(sealed: Column, text: Column, available: Column) -> Column:
    return F.when(sealed, False).when(F.coalesce(text, F.lit("")) != "", True).otherwise(available)


def pending(sealed: Column, available: Column, text: Column) -> Column:
    """A document whose text may still come."""
    return ~F.coalesce(sealed, F.lit(False)) & ~F.coalesce(available, F.lit(False)) & blank_to_null(F.coalesce(text, F.lit(""))).isNull()


def references(text: Column) -> Column:
    """Entry numbers a text refers to, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REFERENCES), F.lit(1)), lambda x: x.cast("long")))


def usable(text: Column) -> Column:
    """Long enough, also without page stamps, and made of letters for the most part."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    body = F.regexp_replace(F.regexp_replace(text, PAGE_STAMP, ""), r"^\s+|\s+$", "")
    return F.coalesce((F.length(text) >= 100) & (letters >= 0.4 * solid) & (F.length(body) >= 100), F.lit(False))


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")


def text_fingerprint(text: Column, least: int = 100) -> Column:
    """sha256 of the folded text; null for short ones."""
    # Bound once, so that the text is folded once.
    return F.transform(F.array(normal_text(text)), lambda t: F.when(F.length(t) >= least, F.sha2(t, 256)))[0]


def amounts(text: Column) -> Column:
    """Dollar amounts as decimal text without commas, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MONEY), F.lit(0)), lambda x: F.regexp_replace(x, "[$,]", "")))


def base_key(key: Column) -> Column:
    """A key without its -<digits> suffix."""
    return F.regexp_replace(key, "-[0-9]+$", "")


def once_only(key: Column) -> Column:
    """'kind|person' of a key that names a proceeding held once, whatever number ends it; null for other keys."""
    k, whole = F.lower(F.trim(key)), f"^({'|'.join(ONCE_ONLY)})(?:-+(.*))?$"
    person = F.coalesce(F.nullif(F.regexp_extract(k, whole, 2), F.lit("")), F.lit("(unnamed)"))
    return F.when(k.rlike(whole), F.concat_ws("|", F.regexp_extract(k, whole, 1), F.regexp_replace(person, r"-\d+$", "")))


def titled(text: Column) -> Column:
    """A capital on every letter that follows none, small letters elsewhere."""
    return F.array_join(F.transform(F.split(text, r"(?<=[^\p{L}])(?=\p{L})"), F.initcap), "")


def key_title(key: Column) -> Column:
    """Kebab key to words with capitals."""
    return titled(F.replace(F.coalesce(key, F.lit("")), F.lit("-"), F.lit(" ")))


def event_id(case_id: Column, key: Column) -> Column:
    return F.concat(F.lit("cc"), F.sha1(F.concat(case_id, F.lit("::"), key)))


def audit_line(old: Column, source: str, note: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(F.rtrim(F.coalesce(old, F.lit(""))), F.lit("")), F.concat(F.lit(f"[{source}] "), note))


def records_proceeding(text: Column) -> Column:
    return F.coalesce(text.rlike(RECORD), F.lit(False))


def record_rank(text: Column) -> Column:
    """0 for an account of a proceeding, 1 for a transcript's filing."""
    return F.when(text.rlike(TRANSCRIPT_RECORD), 1).otherwise(0)


def is_admin_notice(text: Column) -> Column:
    """A notice that set a proceeding up and tells nothing of it."""
    return F.coalesce(text.rlike(ADMIN_NOTICE), F.lit(False)) & ~records_proceeding(text)


def proceeding_types(text: Column) -> Column:
    """The kinds of proceedings a key, title or record signals; a pretrial alone is no trial."""
    blob = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("-"), F.lit(" "))
    alone = F.regexp_replace(blob, r"pre ?trial\w*", " ")
    tags = [F.when((alone if tag == "trial" else blob).rlike(rx), F.lit(tag)) for tag, rx in PROCEEDINGS.items()]
    return F.array_compact(F.array(*tags))


def record_name(text: Column) -> Column:
    """The proceeding a record names at its head, else the whole text."""
    named = [F.nullif(F.regexp_extract(text, PROCEEDING_NAME, i), F.lit("")) for i in (1, 2)]
    return F.coalesce(*named, text)


def absorbed_keys(audit: Column) -> Column:
    """Keys that audit notes say were absorbed, distinct."""
    lists = F.regexp_extract_all(F.coalesce(audit, F.lit("")), F.lit(ABSORBED), F.lit(1))
    keys = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda k: F.trim(k))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def best_title(titles: Column, own: Column, derived: Column) -> Column:
    """A survivor's title: its own unless that only spells its key, else the longest explicit one of ``titles`` (structs key, title, derived)."""
    explicit = F.filter(titles, lambda t: ~t["derived"])
    order = F.array_sort(F.transform(explicit, lambda t: F.struct((-F.length(t["title"])).alias("l"), t["key"].alias("k"), t["title"].alias("t"))))
    return F.when(derived, F.coalesce(F.get(order, F.lit(0))["t"], own)).otherwise(own)
