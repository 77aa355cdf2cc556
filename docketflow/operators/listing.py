"""Listings of cases, entries and documents, in their stated orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions.text import blank_to_null

# A verdict form, which is never a link's target.
VERDICT_FORM = r"(?i)\bverdict\s+form\b"
_CONFIG = "struct<id:string,name:string,calendar:string,dockets:array<bigint>>"


def modified_since(feed: DataFrame, stamp: str, cutoff: str) -> DataFrame:
    """Rows of a feed at or after the cutoff, with the key ``seq`` that orders them oldest first in a fold."""
    return feed.where(F.col(stamp) >= F.lit(cutoff).cast("date")).withColumn("seq", F.struct(stamp, "entry_id"))


def case_config(config: DataFrame) -> DataFrame:
    """(case_id, name, calendar, pos, docket_id) of ``config(value)``: a JSON object a case."""
    c = F.from_json("value", _CONFIG)
    return config.select(c.alias("c")).select(F.col("c.id").alias("case_id"), "c.name", "c.calendar", F.posexplode("c.dockets").alias("pos", "docket_id"))


def settings(cases: DataFrame, calendars: DataFrame, name: str) -> DataFrame:
    """A list setting of each case: its own, else its calendar's; an empty list counts as missing."""
    some = lambda c: F.when(F.size(c) > 0, c)
    both = cases.join(calendars.select("calendar", F.col(name).alias("of_calendar")), "calendar", "left")
    return both.select("case_id", F.coalesce(some(F.col(name)), some(F.col("of_calendar")), F.array().cast("array<string>")).alias(name))


def entry_order() -> list[Column]:
    """Chronological, numbered entries of a day before paperless ones, then by id."""
    return [F.asc_nulls_first("date_filed"), F.asc_nulls_last("entry_number"), F.asc("entry_id")]


def _place() -> Column:
    """``entry_order`` as a struct that sorts in an array."""
    return F.struct(F.coalesce(F.col("date_filed"), F.lit("0001-01-01").cast("date")).alias("d"), F.coalesce("entry_number", F.lit(1 << 30)).cast("long").alias("n"), F.col("entry_id").alias("entry_id"))


def ordered_entries(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, entry_ids): the entries of each group in their order."""
    return entries.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(_place())), lambda x: x["entry_id"]).alias("entry_ids"))


def first_documents(documents: DataFrame, value: Column) -> DataFrame:
    """(entry_id, first): ``value`` of each entry's first document for which it is there."""
    return documents.groupBy("entry_id").agg(F.min_by(value, F.when(value.isNotNull(), F.struct("attachment", "doc_id"))).alias("first"))


def head_texts(entries: DataFrame, documents: DataFrame, of_document: Column) -> DataFrame:
    """(entry_id, head): the short description, else the description, else the first document's, else ''."""
    first = first_documents(documents, blank_to_null(of_document))
    own = F.coalesce(blank_to_null(F.col("short_description")), blank_to_null(F.col("description")))
    return entries.join(first, "entry_id", "left").select("entry_id", F.coalesce(own, "first", F.lit("")).alias("head"))


def stale_documents(documents: DataFrame) -> DataFrame:
    """Main documents that are open and available and whose stored text is blank: the copy is out of date."""
    blank = F.trim(F.coalesce("plain_text", F.lit(""))) == ""
    return documents.where((F.coalesce("attachment", F.lit(0)) == 0) & F.col("is_available") & ~F.col("is_sealed") & blank)


def repaired_documents(documents: DataFrame, fresh: DataFrame) -> DataFrame:
    """``documents`` with the text of ``fresh(doc_id, plain_text)`` in the stale ones; nothing else changes."""
    wanted = stale_documents(documents).select("doc_id").join(fresh.select("doc_id", F.col("plain_text").alias("now")), "doc_id")
    return documents.join(wanted, "doc_id", "left").withColumn("plain_text", F.coalesce("now", "plain_text")).drop("now")


def with_content(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries and ``has_content``: a text of their own, a document's text, or an open document at some place."""
    text = blank_to_null(F.col("plain_text")).isNotNull()
    seen = documents.groupBy("entry_id").agg(F.bool_or(text | (~F.col("is_sealed") & F.col("is_available"))).alias("readable"))
    own = blank_to_null(F.col("description")).isNotNull() | blank_to_null(F.col("short_description")).isNotNull()
    return entries.join(seen, "entry_id", "left").withColumn("has_content", own | F.coalesce("readable", F.lit(False))).drop("readable")


def fullest_copies(entries: DataFrame, documents: DataFrame, dockets: DataFrame) -> DataFrame:
    """The entries of each logical docket, the copy with most text of those that are one.

    Copies share a number, or without one the day and the first 200 characters;
    blank ones are never merged, and a docket of one record is left as it is.
    """
    size = documents.groupBy("entry_id").agg(F.sum(F.length(F.coalesce("plain_text", F.lit("")))).alias("more"))
    home = dockets.select("docket_id", "docket_number", "court_id")
    several = home.groupBy("docket_number", "court_id").agg(F.count("*").alias("records"))
    rows = entries.join(home.join(several, ["docket_number", "court_id"]), "docket_id").join(size, "entry_id", "left")
    text = blank_to_null(F.col("description"))
    key = F.when(F.col("records") == 1, F.concat(F.lit("uid "), F.col("entry_id").cast("string")))
    key = key.when(F.col("entry_number").isNotNull(), F.concat(F.lit("num "), F.col("entry_number").cast("string")))
    key = key.when(text.isNotNull(), F.concat_ws(" ", F.lit("desc"), F.col("date_filed").cast("string"), F.left(text, F.lit(200))))
    key = key.otherwise(F.concat(F.lit("uid "), F.col("entry_id").cast("string")))
    length = F.length(F.coalesce("description", F.lit(""))) + F.coalesce("more", F.lit(0))
    best = Window.partitionBy("docket_number", "court_id", "key").orderBy(F.desc("text_length"), "docket_id", "entry_id")
    rows = rows.withColumn("key", key).withColumn("text_length", length)
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "key", "more", "records")


def case_listing(entries: DataFrame, documents: DataFrame, dockets: DataFrame) -> DataFrame:
    """Per logical docket its shown entries in order and how many are hidden for want of content."""
    rows = with_content(fullest_copies(entries, documents, dockets), documents)
    shown = F.array_sort(F.collect_list(F.when(F.col("has_content"), _place())))
    return rows.groupBy("docket_number", "court_id").agg(F.transform(shown, lambda x: x["entry_id"]).alias("entry_ids"), F.count_if(~F.col("has_content")).alias("hidden"))


def primary_documents(entries: DataFrame, dockets: DataFrame, primary: Column) -> DataFrame:
    """Per logical docket the entries that ``primary`` marks, in order (null dates first), and the first of them."""
    home = dockets.select("docket_id", "docket_number", "court_id")
    rows = ordered_entries(entries.where(primary).join(home, "docket_id"), ["docket_number", "court_id"])
    return rows.withColumn("first_entry", F.get("entry_ids", F.lit(0)))


def document_set(entries: DataFrame, documents: DataFrame, disposition: Column) -> DataFrame:
    """(entry_id, text): the first document text of each entry; dispositions fall back to the docket text, others without text go."""
    first = first_documents(documents, blank_to_null(F.col("plain_text")))
    own = F.when(disposition, F.coalesce(blank_to_null(F.col("short_description")), blank_to_null(F.col("description"))))
    return entries.join(first, "entry_id", "left").select("entry_id", F.coalesce("first", own).alias("text")).where("text IS NOT NULL")


def references(documents: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``documents(description, url, ...)`` with tokens D1 .. Dn in list order; a verdict form keeps its token and loses its link."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    link = F.when(~F.coalesce(F.col("description").rlike(VERDICT_FORM), F.lit(False)), F.nullif("url", F.lit("")))
    return documents.withColumn("ref", F.concat(F.lit("D"), place.cast("string"))).withColumn("url", link)


def lineage_documents(rows: DataFrame, documents: DataFrame, key: list[str]) -> DataFrame:
    """(key, doc_ids): the documents of a row's source entries, flattened in source order."""
    sources = rows.select(*key, F.posexplode("source_entry_ids").alias("pos", "entry_id"))
    found = sources.join(documents.select("entry_id", "attachment", "doc_id").hint("merge"), "entry_id")
    return found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "attachment", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))


def directory(dockets: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per case its logical dockets in configured order, each with its records; and whether a summary is there."""
    groups = dockets.groupBy("case_id", "docket_number", "court_id").agg(F.min(F.struct("pos", "docket_id")).alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "docket_id"))), lambda x: x["docket_id"]).alias("docket_ids"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("at", "docket_number", "court_id"))
    there = summaries.select("docket_number", "court_id", F.lit(True).alias("has_summary"))
    rows = groups.withColumn("place", place).drop("at").join(there, ["docket_number", "court_id"], "left")
    return rows.withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))


def by_start(rows: DataFrame) -> DataFrame:
    """(case_id, keys): a case's rows by start, those without one first."""
    place = F.struct(F.coalesce(F.col("start_date"), F.lit("0001-01-01").cast("date")).alias("d"), F.col("hearing_key").alias("k"))
    return rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["k"]).alias("keys"))
