"""Text audits over summaries and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions.text import amounts
from docketflow.operators import guards


def money_overlap(texts: DataFrame) -> DataFrame:
    """Rows whose restitution clause and forfeiture clause name one amount."""
    clause = lambda word: amounts(F.regexp_extract("description", rf"(?i){word}[^;]*?(\$[0-9,.]+[0-9])", 1))
    return texts.withColumn("same", F.array_intersect(clause("restitution"), clause("forfeiture"))).where(F.size("same") > 0).select("entry_id", F.array_join("same", ",").alias("amounts"))


def ungrounded(mentions: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """Mentions (key, value) that no known row of the key has."""
    return mentions.select(key, value).distinct().join(known.select(key, value).distinct(), [key, value], "left_anti")


# What reads as a granted order to seal, and to unseal.
SEALS = r"(?iU)\border\b[^.]*\bgrant(?:s|ed|ing)\b[^.]*\bto\s+seal\b"
UNSEALS = r"(?iU)\border\b[^.]*\bgrant(?:s|ed|ing)\b[^.]*\bto\s+unseal\b"


def sealing(entries: DataFrame, disposed: DataFrame, most_later: int = 3) -> DataFrame:
    """The latest order to seal of each docket that is sealed in effect, its text cut at 240, and the public entries after it.

    None where ``disposed(docket_id)`` has the docket, where a later order
    unseals it, or where more than ``most_later`` later entries are public.
    Orders of one day: the smallest entry_id.
    """
    text = F.coalesce("description", F.lit(""))
    rows = entries.withColumn("seals", text.rlike(SEALS)).withColumn("unseals", text.rlike(UNSEALS))
    order = F.max_by(F.struct("entry_id", "entry_number", F.trim(text).alias("said")), F.struct("date_filed", (-F.col("entry_id")).alias("e")))
    last = rows.where("seals").groupBy("docket_id").agg(order.alias("o"), F.max("date_filed").alias("seal_date"))
    last = last.join(disposed.select("docket_id").distinct(), "docket_id", "left_anti")
    after = F.col("date_filed") > F.col("seal_date")
    found = rows.join(last, "docket_id").groupBy("docket_id", "o", "seal_date").agg(F.count_if(after & F.col("is_available")).alias("later"), F.bool_or(after & F.col("unseals")).alias("lifted"))
    said = F.when(F.length("o.said") > 240, F.concat(F.rtrim(F.substring("o.said", 1, 237)), F.lit("..."))).otherwise(F.col("o.said"))
    kept = found.where(f"NOT lifted AND later <= {most_later}")
    return kept.select("docket_id", F.col("o.entry_id").alias("seal_entry"), F.col("o.entry_number").alias("seal_number"), "seal_date", said.alias("seal_text"), "later")


def best_copies(entries: DataFrame, dockets: DataFrame) -> DataFrame:
    """One copy of each logical entry (docket group, description): with a body first, then the freshest docket, the earliest entry."""
    rows = entries.where("description <> ''").join(dockets.select("docket_id", "docket_number", "court_id", "date_modified"), "docket_id")
    order = Window.partitionBy("docket_number", "court_id", "description").orderBy(F.desc("is_available"), F.desc("date_modified"), "date_filed", "entry_id")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("docket_number", "court_id", "description", "entry_id")


def sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sentence) of each text."""
    return texts.select(key, F.posexplode(guards.sentences(F.col(text))).alias("pos", "sentence"))
