"""Logs, count files and figures of runs and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line of a decision, its actions, their kinds, and the counts of a scored entry.
DECISION = r'decisions extract docket=(\d+) entry=(\d+) ".*?" -> (.*)$'
ACTION = r"([A-Z_]+)\(([^)]*)\)"
DAY = r"^\d{4}-\d{2}-\d{2}"
ACTIONS = ["ADD_HEARING", "RESCHEDULE_HEARING", "MARK_HELD", "CANCEL_HEARING", "ADD_DEADLINE", "RESCHEDULE_DEADLINE", "MARK_FILED", "CANCEL_DEADLINE"]
COUNTS = ["h_scheduled", "h_rescheduled", "h_held", "h_cancelled", "d_set", "d_rescheduled", "d_met_filed", "d_cancelled"]


def decisions(lines: DataFrame) -> DataFrame:
    """(docket_id, entry_id, pos, type, key, dates) of log lines in ``value``; lines and actions of other kinds are skipped.

    The first argument of an action is its key unless it is a significance or a date.
    """
    part = lambda g: F.regexp_extract("value", DECISION, g)
    found = lines.where(F.col("value").rlike(DECISION)).select(
        part(1).cast("long").alias("docket_id"), part(2).cast("long").alias("entry_id"), F.posexplode(F.regexp_extract_all(part(3), F.lit(ACTION), F.lit(0))).alias("pos", "raw")
    )
    args = F.transform(F.split(F.regexp_extract("raw", ACTION, 2), ","), lambda x: F.trim(x))
    rows = found.select("docket_id", "entry_id", "pos", F.regexp_extract("raw", ACTION, 1).alias("type"), args.alias("args")).where(F.col("type").isin(ACTIONS))
    first = F.element_at("args", 1)
    key = F.when(first.isin("major", "minor") | first.rlike(DAY), "").otherwise(first)
    return rows.select("docket_id", "entry_id", "pos", "type", key.alias("key"), F.array_sort(F.filter("args", lambda a: a.rlike(DAY))).alias("dates"))


def _count(c: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(trim({c}) AS int)"), F.lit(0))


def scored(rows: DataFrame, unreviewed: bool = False) -> DataFrame:
    """Truth rows of a count file, all its columns text: blank or broken counts are 0; bad scans and unreviewed rows are left out."""
    keep = (F.trim(F.coalesce("entry_id", F.lit(""))) != "") & (_count("bad_ocr") == 0)
    if not unreviewed:
        keep = keep & (_count("reviewed") != 0)
    have = [c for c in COUNTS if c in rows.columns]
    return rows.where(keep).select(F.trim("entry_id").alias("entry_id"), *[_count(c).alias(c) for c in have])


def read_scored(spark, path: str, unreviewed: bool = False) -> DataFrame:
    """``scored`` of CSV files with a head line."""
    return scored(spark.read.option("header", True).csv(path), unreviewed)


def entry_actions(counts: DataFrame, entries: DataFrame, dockets: DataFrame) -> DataFrame:
    """Counts of actions with what is known of their entry and docket; entries of no known docket keep nulls."""
    about = entries.select("entry_id", "docket_id", "entry_number", "date_filed").join(dockets.select("docket_id", "case_id", "docket_number", "court_id"), "docket_id", "left")
    return counts.join(about, "entry_id", "left")


def write_entry_actions(rows: DataFrame, path: str) -> None:
    """CSV in order of provider, case, docket and entry number (none last); the order runs over the files, by ranges."""
    order = ["provider", "case_id", "docket_number", F.col("entry_number").asc_nulls_last(), "entry_id"]
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def delivery_stats(entries: DataFrame, routes: DataFrame, relevant: Column, by: str) -> DataFrame:
    """received, processed, relevant and unknown entries of each ``by``; a docket without a route is unknown."""
    rows = entries.withColumn("relevant", relevant).join(routes.select("docket_id", "case_id"), "docket_id", "left")
    known = F.col("case_id").isNotNull()
    return rows.groupBy(by).agg(F.count("*").alias("received"), F.count_if(known).alias("processed"), F.count_if(known & F.col("relevant")).alias("relevant"), F.count_if(~known).alias("unknown"))


def case_stats(routes: DataFrame, changed: DataFrame, entries: DataFrame) -> DataFrame:
    """dockets, changed dockets, new entries and their newest date of each case; entries are counted a docket first."""
    counts = entries.groupBy("docket_id").agg(F.count("*").alias("entries"), F.max("date_filed").alias("newest"))
    rows = routes.select("case_id", "docket_id").join(changed.select("docket_id", F.lit(True).alias("changed")), "docket_id", "left").join(counts, "docket_id", "left")
    return rows.groupBy("case_id").agg(
        F.count("*").alias("dockets"), F.count_if("changed").alias("changed"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.max("newest").cast("string").alias("newest")
    )


def call_times(rows: DataFrame) -> DataFrame:
    """(label, calls, mean_seconds, wall) of ``rows(label, seconds, at)``: wall is the time from the first to the last call."""
    return rows.groupBy("label").agg(F.count("*").alias("calls"), F.avg("seconds").alias("mean_seconds"), (F.max("at") - F.min("at")).alias("wall"))
