"""Guards over generated summaries: what a text claims against what is known, and its repair.

Every function takes and returns columns of one row a summary, so a guard runs
where the summary already is; only the known facts are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentence of a refusal, and the patterns of the guards.
REFUSAL = "Documents available for this docket are insufficient to generate a reliable summary."
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NOUN = (
    r"(?:disposition|judgments?|hearings?|deadlines?|scheduling\s+orders?|docket\s+entr(?:y|ies)|trial\s+dates?|recent\s+activity|arrests?|initial\s+appearances?)"
)
ABSENCE = [
    rf"\bno\s+(?:\w+\s+){{0,3}}{NOUN}\b",
    r"\b(?:docket|record)\s+(?:does|do|did)\s+not\s+(?:reflect|show|indicate|contain|list|record)\b",
    rf"{NOUN}\s+(?:\w+\s+){{0,3}}(?:have|has)\s+not\s+been\s+(?:filed|entered|recorded|scheduled|set|reflected)",
    r"\bthe case remains pending\b",
    r"\bcannot be determined from the\b",
    r"\bit is unknown whether\b",
    r"\b(?:custody|arrest|appearance)\s+status\b[^.]{0,40}?\b(?:unknown|cannot be|not (?:known|clear|established))\b",
    r"\bif (?:convicted|found guilty)\b",
    r"\bif a (?:term of )?(?:imprisonment|incarceration|sentence)\s+(?:is|were|is to be)\s+(?:imposed|ordered)\b",
    r"\bshould the court impose\b",
]
CUSTODY = [
    r"\bremains?\s+(?:a\s+)?fugitive\b",
    r"\bis\s+a\s+fugitive\b",
    r"\b(?:remain|remains|remaining|appears?\s+to\s+remain)\s+at\s+large\b",
]
# What every text that a pattern of ABSENCE or CUSTODY hits has in it.
ABSENCE_HAS = ["no", "not", "been", "remains pending", "cannot be", "unknown whether", "status", "if ", "if a ", "the court impose"]
CUSTODY_HAS = ["fugitive", "fugitive", "large"]
CUSTODY_GROUND = r"\b(?:fugitive|at large|apprehend|in custody|remains? abroad|not been arrested)\b"
DATE = r"\b(?=[jfmasond])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
MONEY = r"\$\s?\d[\d,]*(?:\.\d{1,2})?(?:\s*(?:million|billion))?"
FORFEIT = r"\[?forfeiture\s+money\s+judgment\]?(?:\(doc:[^)]*\))?"
AMOUNT = r"\$\s?(\d[\d,]*(?:\.\d{1,2})?)"
FORFEITURES = [FORFEIT + r"\s+(?:of|in\s+the\s+amount\s+of|for)\s+" + AMOUNT, AMOUNT + r"\s+forfeiture\s+money\s+judgment"]
RESTITUTIONS = [AMOUNT + r"\s+in\s+restitution", r"restitution\s+(?:of|in\s+the\s+amount\s+of|totaling)?\s*" + AMOUNT]
STATEMENT = (
    FORFEIT + r"\s+(?:of|in\s+the\s+amount\s+of|for)\s+\$\s?\d[\d,]*(?:\.\d{1,2})?(?:\s+(?:was|is|were))?(?:\s+also)?(?:\s+entered)?"
    r"(?:\s+against\s+(?:him|her|them|the\s+defendants?))?"
)
STATEMENT_INSIDE = r"[,;]\s*(?:and\s+|with\s+)?(?:a\s+)?" + STATEMENT
STATEMENT_FIRST = r"\b(?:A\s+)?" + STATEMENT + r",?\s+and\s+(?=\w)"
CLAIM = (
    r"\b(sentencing|jury\s+trial|trial|arraignment|oral\s+argument|change\s+of\s+plea)\b(?:\s+hearing)?([^.!?;:]{0,60}?)"
    r"\b(?:(?:re)?scheduled|set|continued)\s+(?:for|to|until)\s+(?:begin\s+)?(?:on\s+)?"
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
)
EVENT_WORDS = {"jury trial": "trial", "oral argument": "argument", "change of plea": "plea"}
PAST = r"\b(?:was|were|had\s+been|previously|originally|initially|earlier|then)\b"
CREDIT = (
    r"(?:the\s+)?(?:operator(?:'s)?(?:[-\s]provided)?\s+note[sd]?|aggregation\s+note)"
    r"\s+(?:that|states?\s+that|indicates?\s+that|says?\s+that|notes?\s+that|reflects?\s+that)\s+"
    r"|according\s+to\s+the\s+(?:operator(?:'s)?|(?:provided\s+)?note[s]?)\s*,?\s*|as\s+noted\s+by\s+the\s+operator\s*,?\s*|per\s+the\s+operator(?:'s)?\s+note\s*,?\s*"
)
OPENING = r"[A-Z\"“‘\[]"
NO_END = (
    r"(?:\b[A-Z]|U\.S|U\.S\.C|U\.S\.A|Mr|Mrs|Ms|Dr|Jr|Sr|St|No|Inc|Corp|Co|Ltd|vs?|et al|e\.g|i\.e|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|Cir|Fed|art|sec)\."
)

MARKER = r"\[([^\]]+)\]\(doc:([A-Za-z0-9_-]+)\)"
VERB = r"(?:was|were|is|are|be|been|has|have|had)"
PREPOSITION = r"(?:of|to|with|for|on|in|against|upon|into)"
LINK_URL = r"\((https?://[^\s)]+)\)"

_I = "(?iU)"
_MARK = "\u0001"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_I + pattern), F.lit(group))


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(_I + pattern), F.lit(False))


def _part(raw: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(raw, _I + pattern, group)


def _first(text: Column, patterns: list[str], words: list[str] | None = None) -> Column:
    """The first hit of each pattern that hits; ``words``: what a text must have for each."""
    if words is None:
        return F.filter(F.array(*[_part(text, p, 0) for p in patterns]), lambda x: x != "")

    def hits(low: Column) -> Column:
        return F.filter(F.array(*[F.when(_may(low, w), _part(text, p, 0)).otherwise("") for p, w in zip(patterns, words, strict=True)]), lambda x: x != "")

    return _let(_low(text), hits)


def _low(text: Column) -> Column:
    """A text of ASCII in small letters; null for others, whose letters fold in more ways."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text))


def _may(low: Column, *words: str) -> Column:
    """Whether a text may have all ``words``: so says its ``_low``, or it has none."""
    has = [F.contains(low, F.lit(w)) for w in words]
    out = has[0]
    for h in has[1:]:
        out = out & h
    return F.coalesce(out, F.lit(True))


def _groups(raw: Column, pattern: str, n: int) -> Column:
    """The first ``n`` groups of a pattern's hit, by one search."""
    return F.split(F.regexp_replace(raw, _I + pattern, _MARK.join(f"${i}" for i in range(1, n + 1))), _MARK)


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _speaks(text: Column) -> Column:
    """Not empty, and no refusal: a refusal claims nothing."""
    return (F.trim(F.coalesce(text, F.lit(""))) != REFUSAL) & (F.coalesce(text, F.lit("")) != "")


def _spaced(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")


def _iso(month: Column, day: Column, year: Column) -> Column:
    # The place in one text: an array of names would be made and searched for each date.
    number = F.floor((F.instr(F.lit("".join(MONTHS)), F.lower(F.left(month, F.lit(3)))) + 2) / 3)
    return F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))


def sentences(text: Column) -> Column:
    """The sentences of a text: split before a capital, quote or bracket, not after an abbreviation."""
    # A full stop ends every abbreviation; asked first, the abbreviations are not tried at every character.
    kept = F.regexp_replace(text, rf"(?<=\.)(?<=(?i:{NO_END}))(?U:\s+)(?={OPENING})", " ")
    return F.split(kept, rf"(?<=[.!?])(?<!(?i:{NO_END}))(?U:\s+)(?={OPENING})")


def record_claims(text: Column, source: Column) -> Column:
    """Claims about what the record lacks, and of flight or custody that the source text does not speak of."""
    # The source is read only for a text that speaks of flight.
    flight = _let(_first(text, CUSTODY, CUSTODY_HAS), lambda hits: F.when(F.size(hits) == 0, hits).when(_has(source, CUSTODY_GROUND), _nothing()).otherwise(hits))
    return F.when(_speaks(text), F.concat(_first(text, ABSENCE, ABSENCE_HAS), flight)).otherwise(_nothing())


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def corpus(source: Column) -> Column:
    """A source as the grounding guard reads it: single spaces, in small letters, and without commas."""
    one = lambda c: F.struct(c.alias("text"), F.lower(c).alias("low"), F.replace(c, F.lit(","), F.lit("")).alias("plain"))
    return _let(_spaced(source), one)


def ungrounded(text: Column, known_dates: Column, given: Column) -> Column:
    """Dates (ISO in ``known_dates``, or in the ``corpus`` given in some form) and amounts that nothing given has."""

    def unknown(raw: Column) -> Column:
        def missing(iso: Column) -> Column:
            m, d, y = F.substring(iso, 6, 2), F.substring(iso, 9, 2), F.left(iso, F.lit(4))
            bare = lambda c: c.cast("int").cast("string")
            forms = [F.concat_ws("/", bare(m), bare(d), y), F.concat_ws("/", bare(m), bare(d), F.right(y, F.lit(2))), F.concat_ws("/", m, d, y), iso]
            found = F.coalesce(F.array_contains(known_dates, iso), F.lit(False)) | F.contains(given["low"], F.lower(_spaced(raw)))
            for form in forms:
                found = found | F.contains(given["text"], form)
            return ~found

        return _let(_groups(raw, DATE, 3), lambda g: _let(_iso(g[0], g[1], g[2]), missing))

    def unpaid(raw: Column) -> Column:
        return ~_has(raw, "million|billion") & ~F.contains(given["plain"], F.replace(F.trim(F.replace(raw, F.lit("$"), F.lit(""))), F.lit(","), F.lit("")))

    return F.when(_speaks(text), F.concat(F.filter(_all(text, DATE), unknown), F.filter(_all(text, MONEY), unpaid))).otherwise(_nothing())


def _money(text: Column, patterns: list[str]) -> Column:
    """Amounts without commas and without zeros after the point."""
    found = F.concat(*[_all(text, p, 1) for p in patterns])
    bare = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(bare(x), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")))


def doubled_forfeitures(text: Column) -> Column:
    """Forfeiture money judgments of an amount that is owed in restitution too."""
    both = F.array_sort(F.array_intersect(_money(text, RESTITUTIONS), _money(text, FORFEITURES)))
    return F.when(_may(_low(text), "forfeiture", "restitution") | text.isNull(), both).otherwise(_nothing())


def stale_events(text: Column, scheduled: Column) -> Column:
    """Claims of a scheduled date that no scheduled row of that kind has; ``scheduled`` is array<struct<title, dates array<string>>>."""

    def stale(raw: Column) -> Column:
        def old(g: Column) -> Column:
            event = F.regexp_replace(F.lower(g[0]), r"(?U)\s+", " ")
            words = F.create_map(*[F.lit(x) for pair in EVENT_WORDS.items() for x in pair])
            told = F.struct(F.coalesce(F.try_element_at(words, event), event).alias("word"), _iso(g[2], g[3], g[4]).alias("day"))
            kind = lambda t: F.filter(scheduled, lambda h: F.contains(F.lower(h["title"]), t["word"]))
            gone = lambda t: _let(kind(t), lambda rows: (F.size(rows) > 0) & ~F.exists(rows, lambda h: F.array_contains(h["dates"], t["day"])))
            return ~_has(g[1], PAST) & _let(told, gone)

        return _let(_groups(raw, CLAIM, 5), old)

    return F.when(_speaks(text) & scheduled.isNotNull(), F.filter(_all(text, CLAIM), stale)).otherwise(_nothing())


def credits(text: Column) -> Column:
    """The first place that names the operator or a note as the source of a fact."""
    return _first(text, [CREDIT])


def _or_refusal(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("")), F.lit(REFUSAL))


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+([,;.])", "$1"), r"(?U)\s{2,}", " ")


def keep_sentences(text: Column, bad) -> Column:
    """The sentences that ``bad`` finds nothing in; the refusal if none is left."""
    kept = F.filter(sentences(text), lambda s: F.size(bad(s)) == 0)
    return _or_refusal(F.array_join(F.transform(kept, lambda x: F.trim(x)), " "))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def cut_forfeiture(text: Column) -> Column:
    """Cuts the clause of a doubled forfeiture; a sentence that is nothing else goes."""

    def cut(doubled: Column) -> Column:
        led = F.split(F.regexp_replace(text, _I + STATEMENT_FIRST, _MARK), _MARK)
        joined = F.array_join(F.transform(led, lambda p, i: F.when(i > 0, _capital(p)).otherwise(p)), "")
        over = lambda s: F.arrays_overlap(_money(s, FORFEITURES), doubled)
        rest = lambda t: F.when(F.exists(sentences(t), over), F.array_join(F.transform(F.filter(sentences(t), lambda s: ~over(s)), lambda x: F.trim(x)), " ")).otherwise(t)
        return F.when(F.size(doubled) > 0, _or_refusal(_tidy(_let(F.regexp_replace(joined, _I + STATEMENT_INSIDE, ""), rest)))).otherwise(text)

    return _let(doubled_forfeitures(text), cut)


def cut_credit(text: Column) -> Column:
    """Cuts lead-ins to a note and keeps what they introduce, with a capital where they opened a sentence."""
    parts = F.split(F.regexp_replace(text, _I + CREDIT, _MARK), _MARK)
    opens = lambda done: (F.trim(done) == "") | done.rlike(r"(?U)[.!?]\s*$")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    joined = F.aggregate(rest, F.element_at(parts, 1), lambda done, p: F.concat(done, F.when(opens(done), _capital(p)).otherwise(p)))
    return F.when(_has(text, CREDIT), _or_refusal(_tidy(joined))).otherwise(text)


def tidy_links(text: Column) -> Column:
    """A verb right before a link goes into it, prepositions at its end go out."""
    one = F.regexp_replace(text, rf"{_I}\b({VERB})\s+(?=(?:{VERB}\s+)*\[[^\]]+\]{LINK_URL})", "$1 ")
    led = F.regexp_replace(one, rf"{_I}\b((?:{VERB} )+)\[([^\]]+)\]{LINK_URL}", "[$1$2]($3)")
    ends = F.regexp_replace(led, rf"{_I}(\s+{PREPOSITION})\s+(?=(?:{PREPOSITION}\s+)*{PREPOSITION}\]{LINK_URL})", "$1 ")
    return F.regexp_replace(ends, rf"{_I}\[([^\]]+?)\s+({PREPOSITION}(?: {PREPOSITION})*)\]{LINK_URL}", "[$1]($3) $2")


def resolved_links(text: Column, urls: Column) -> Column:
    """Markers [words](doc:Dn) as links by the map ``urls``; plain words where it has no url."""
    raw = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))

    def put(done: Column, marker: Column) -> Column:
        words, url = F.regexp_extract(marker, MARKER, 1), F.element_at(urls, F.regexp_extract(marker, MARKER, 2))
        return F.replace(done, marker, F.when(F.coalesce(url, F.lit("")) == "", words).otherwise(F.concat(F.lit("["), words, F.lit("]("), url, F.lit(")"))))

    return tidy_links(F.aggregate(F.array_distinct(raw), text, put))


#: The guards whose findings ask for another draft, in their order.
GUARDS = ("record", "ungrounded", "doubled", "stale")


def findings(text: Column, source: Column, given: Column, known_dates: Column, scheduled: Column) -> dict[str, Column]:
    """The findings that ask for another draft, by guard, in the order of the guards; ``given`` is the source's ``corpus``."""
    return {
        "record": record_claims(text, source), "ungrounded": ungrounded(text, known_dates, given),
        "doubled": doubled_forfeitures(text), "stale": stale_events(text, scheduled),
    }


def found(drafts: DataFrame, guards: tuple[str, ...] = GUARDS) -> DataFrame:
    """``drafts`` with the findings of ``guards`` in ``found``; the corpus is made once a row."""
    rows = drafts.withColumn("given", corpus(F.col("source")))
    by = findings(F.col("text"), F.col("source"), F.col("given"), F.col("known_dates"), F.col("scheduled"))
    return rows.withColumn("found", F.struct(*[by[g].alias(g) for g in guards])).drop("given")


def dirty(drafts: DataFrame) -> DataFrame:
    """``drafts`` with ``dirty``: whether any guard finds something; the guards after one that does are not asked."""
    rows = drafts.withColumn("given", corpus(F.col("source")))
    by = findings(F.col("text"), F.col("source"), F.col("given"), F.col("known_dates"), F.col("scheduled"))
    some = [F.size(by[g]) > 0 for g in ("doubled", "ungrounded", "stale", "record")]
    return rows.withColumn("dirty", some[0] | some[1] | some[2] | some[3]).drop("given")


def repaired(rows: DataFrame) -> DataFrame:
    """``text`` of the dirty rows without ungrounded sentences, doubled forfeitures and stale dates, in this order.

    One projection a step: a step names its text several times, and nested steps would multiply.
    """
    steps = [
        lambda t: keep_sentences(t, lambda s: ungrounded(s, F.col("known_dates"), F.col("given"))),
        cut_forfeiture,
        lambda t: keep_sentences(t, lambda s: stale_events(s, F.col("scheduled"))),
    ]
    for step in steps:
        rows = rows.withColumn("text", F.when(F.col("dirty"), step(F.col("text"))).otherwise(F.col("text")))
    return rows


def guarded(drafts: DataFrame) -> DataFrame:
    """(key, attempt, text, repaired) from ``drafts(key, attempt, text, source, known_dates, scheduled)``.

    The first draft without findings stays; without one the last is repaired.
    Credits are cut from any.  Drafts of a key meet once, and the repair is
    computed for the chosen row alone.
    """
    rows = dirty(drafts)
    # false before true; among clean drafts the first, among others the last.
    rank = F.struct("dirty", F.when(F.col("dirty"), -F.col("attempt")).otherwise(F.col("attempt")).alias("n"))
    row = F.struct("attempt", "text", "source", "known_dates", "scheduled", "dirty")
    best = rows.groupBy("key").agg(F.min_by(row, rank).alias("r")).select("key", "r.*")
    return repaired(best.withColumn("given", corpus(F.col("source")))).select("key", "attempt", cut_credit(F.col("text")).alias("text"), F.col("dirty").alias("repaired"))
