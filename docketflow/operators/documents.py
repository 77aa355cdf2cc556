"""Documents of an entry: where they are, how they are labelled, which text speaks for the entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions import text as T

from docketflow.functions.text import blank_to_null, is_deadline, is_disposition, is_hearing, is_primary, is_ruling, usable


def document_url(base: str, stored: Column, mirror: Column) -> Column:
    """The stored copy under ``base``, else the mirror's url, else null."""
    return F.coalesce(F.concat(F.lit(base), F.nullif(stored, F.lit(""))), F.nullif(mirror, F.lit("")))


def label(number: Column, attachment: Column) -> Column:
    """'65', or '65-1' for an attachment."""
    main = F.coalesce(attachment, F.lit(0)) == 0
    return F.when(main, number.cast("string")).otherwise(F.concat_ws("-", number.cast("string"), attachment.cast("string")))


def text_choice(sealed: Column, upstream: Column, local: Column, ocr: Column) -> Column:
    """The upstream text if usable; of an unsealed document else the local, else the OCR text if usable."""
    own = F.coalesce(F.when(usable(local), local), F.when(usable(ocr), ocr))
    return F.coalesce(F.when(usable(upstream), upstream), F.when(~F.coalesce(sealed, F.lit(False)), own))


def nested(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """``entries`` with ``docs``, their ``documents(entry_id, attachment, doc_id, description, is_available, is_sealed, text)`` in order (none: null)."""
    rows = documents.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("attachment", "doc_id", "description", "is_available", "is_sealed", "text"))).alias("docs"))
    return entries.join(rows, "entry_id", "left")


def full_text(description: Column, short: Column, docs: Column) -> Column:
    """An entry's own texts and its documents' descriptions, those with content."""
    said = F.concat(F.array(description, short), F.transform(F.coalesce(docs, F.array()), lambda d: d["description"]))
    return F.array_join(F.filter(said, lambda c: c != ""), " | ")


def any_primary(head: Column, docs: Column) -> Column:
    """Whether an entry's head text or the description of one of its documents names a primary document."""
    return is_primary(head) | F.coalesce(F.exists(docs, lambda d: is_primary(d["description"])), F.lit(False))


def retained(entries: DataFrame) -> DataFrame:
    """(entry_id, kept): the whole text of ``nested`` entries that set dates or that a summary needs, null for the others."""
    head = F.coalesce(blank_to_null(F.col("short_description")), blank_to_null(F.col("description")), F.lit(""))
    rows = entries.select("entry_id", "docs", head.alias("head"), full_text(F.col("description"), F.col("short_description"), F.col("docs")).alias("full"))
    keep = is_hearing(F.col("full")) | is_deadline(F.col("full")) | any_primary(F.col("head"), F.col("docs")) | is_disposition(F.col("head"))
    return rows.select("entry_id", F.when(keep, F.col("full")).alias("kept"))


def link_rows(documents: DataFrame) -> DataFrame:
    """(entry_id, doc_id, label, url, status) of ``documents(entry_id, doc_id, number, attachment, url, is_sealed)``."""
    status = F.when(F.col("is_sealed"), "sealed").when(F.coalesce("url", F.lit("")) == "", "not yet available").otherwise("")
    return documents.select("entry_id", "doc_id", label(F.col("number"), F.col("attachment")).alias("label"), F.coalesce("url", F.lit("")).alias("url"), status.alias("status"))


def chosen(documents: DataFrame) -> DataFrame:
    """(entry_id, text, url, all_text): the text that speaks for an entry, the url a citation opens, and all texts with heads.

    Documents whose own description marks the substance come first (charges
    before rulings), then main documents, then attachments; the first of these
    groups with any text gives the text, the first unsealed document with a url
    gives the url.  The documents of one entry meet as one row, no more.
    """
    c = F.col("description")
    rank = F.when(is_primary(c), 0).when(is_ruling(c), 1).when(F.coalesce("attachment", F.lit(0)) == 0, 2).otherwise(3)
    body = blank_to_null(F.col("text"))
    head = F.concat(F.lit("[doc "), label(F.col("number"), F.col("attachment")), F.lit("]\n"), body)
    one = F.struct(rank.alias("rank"), F.coalesce("attachment", F.lit(0)).alias("at"), "doc_id", body.alias("text"), F.when(~F.col("is_sealed"), F.nullif("url", F.lit(""))).alias("url"), head.alias("head"))
    docs = documents.groupBy("entry_id").agg(F.array_sort(F.collect_list(one)).alias("d"))

    def joined(keep) -> Column:
        texts = F.transform(F.filter("d", lambda x: keep(x["rank"]) & x["text"].isNotNull()), lambda x: x["text"])
        return F.nullif(F.array_join(texts, "\n\n"), F.lit(""))

    text = F.coalesce(joined(lambda r: r < 2), joined(lambda r: r == 2), joined(lambda r: r == 3), F.lit(""))
    url = F.filter("d", lambda x: x["url"].isNotNull())
    order = F.array_sort(F.transform("d", lambda x: F.struct(x["at"], x["doc_id"], x["head"])))
    heads = F.array_join(F.transform(order, lambda x: x["head"]), "\n\n")
    return docs.select("entry_id", text.alias("text"), F.get(url, F.lit(0))["url"].alias("url"), heads.alias("all_text"))


#: What an entry keeps of each of its documents.
KEPT = ["id", "document_number", "attachment_number", "description", "is_available", "is_sealed", "filepath_ia", "filepath_local", "plain_text"]


def compact_documents(documents: DataFrame) -> DataFrame:
    """(entry_id, documents): the nine kept fields of each document, blank texts and paths as nulls, unknown flags as false.

    In order of document and attachment number; one that is no number counts as 0, equal ones stand by id.
    """
    blank = lambda c: T.blank_to_null(F.coalesce(F.col(c), F.lit(""))).alias(c)
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    path = lambda c: F.nullif(c, F.lit("")).alias(c)
    kept = F.struct("id", "document_number", "attachment_number", blank("description"), flag("is_available"), flag("is_sealed"), path("filepath_ia"), path("filepath_local"), blank("plain_text"))
    rows = documents.select("entry_id", F.struct(number("document_number").alias("d"), number("attachment_number").alias("a"), F.col("id").alias("i"), kept.alias("kept")).alias("row"))
    return rows.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["kept"]).alias("documents"))


def worklist(entries: DataFrame, wanted: Column, fetchable: DataFrame) -> DataFrame:
    """(entry_id, doc_id) of the ``fetchable`` documents of entries that are ``wanted``; asked only of entries that have such documents."""
    listed = fetchable.groupBy("entry_id").agg(F.collect_list(F.struct("doc_id")).alias("docs"))
    some = F.size("docs") > 0
    # A condition on both sides stays above the join, so that no text is searched for nothing.
    return entries.join(listed.hint("merge"), "entry_id").where(F.when(some, wanted).otherwise(some)).select("entry_id", F.inline("docs"))
