"""Context joins: logical dockets, as-of top-k, intervals, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def docket_groups(dockets: DataFrame) -> DataFrame:
    """Docket ids of each logical docket (docket_number, court_id), freshest first."""
    order = F.struct((-F.datediff("date_modified", F.lit("1970-01-01").cast("date"))).alias("d"), (-F.col("docket_id")).alias("i"))
    return dockets.groupBy("docket_number", "court_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: -s["i"]).alias("docket_ids"))


def with_court(rows: DataFrame, courts: DataFrame, default: str = "America/New_York") -> DataFrame:
    """Rows with their court's citation and zone; courts are a fixed dimension of some hundred rows, so they are broadcast."""
    return rows.join(F.broadcast(courts), "court_id", "left").withColumn("timezone", F.coalesce("timezone", F.lit(default)))


def cross_references(entries: DataFrame, numbers: Column) -> DataFrame:
    """(docket_id, entry_id, ref_number, ref_entry_id): entries a text names by number on its own docket, with a body."""
    named = entries.select("docket_id", "entry_id", F.explode(numbers).alias("ref_number"))
    bodies = entries.where("description <> ''").select("docket_id", F.col("entry_number").cast("long").alias("ref_number"), F.col("entry_id").alias("ref_entry_id"))
    return named.hint("merge").join(bodies.hint("merge"), ["docket_id", "ref_number"])


def prior_context(entries: DataFrame, k: int = 5) -> DataFrame:
    """The last k body-bearing entries of the docket filed strictly before each entry, newest first.

    Every body carries itself and the k - 1 bodies before it; an entry takes the list of the
    newest body of an earlier day.  Both windows run over one exchange and in linear time.
    """
    rows = entries.withColumn("day", F.datediff("date_filed", F.lit("1970-01-01").cast("date")).cast("long"))
    rows = rows.withColumn("body", F.coalesce("description", F.lit("")) != "").repartition("docket_id")
    recent = Window.partitionBy("docket_id", "body").orderBy("day", "entry_id").rowsBetween(1 - k, Window.currentRow)
    before = Window.partitionBy("docket_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ids", F.collect_list("entry_id").over(recent))
    last = F.max(F.when(F.col("body"), F.struct("day", "entry_id", "ids"))).over(before)
    return rows.withColumn("last", last).select("docket_id", "entry_id", F.coalesce(F.reverse("last.ids"), F.array().cast("array<bigint>")).alias("prior"))


def newest_bodies(entries: DataFrame, k: int = 15) -> DataFrame:
    """(docket_id, entry_id) of the newest k body-bearing entries of each docket."""
    newest = Window.partitionBy("docket_id").orderBy(F.desc("date_filed"), F.desc("entry_id"))
    return entries.where("description <> ''").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= k).select("docket_id", "entry_id")


def verification_context(targets: DataFrame, entries: DataFrame, k: int = 15) -> DataFrame:
    """(case_id, hearing_key, entry_id) that a verification of ``targets`` shows: the docket's newest bodies, entries around the date, the row's own sources; each once."""
    key = ["case_id", "hearing_key"]
    recent = targets.select(*key, "docket_id").join(newest_bodies(entries, k), "docket_id").select(*key, "entry_id")
    near = around_date(targets.select(*key, "docket_id", "start_date"), entries.where("description <> ''"))
    own = targets.select(*key, "docket_id", F.explode("source_entry_ids").alias("entry_id")).hint("merge").join(entries.select("docket_id", "entry_id").hint("merge"), ["docket_id", "entry_id"]).select(*key, "entry_id")
    return recent.unionByName(near).unionByName(own).distinct()


def removal_allowed(rows: DataFrame, shown: DataFrame, key: list[str]) -> DataFrame:
    """(key, allowed): a row may be removed if all its sources were shown; without sources it may."""
    sources = rows.select(*key, F.explode_outer("source_entry_ids").alias("entry_id"))
    seen = sources.hint("merge").join(shown.select(*key, "entry_id", F.lit(True).alias("shown")).distinct().hint("merge"), [*key, "entry_id"], "left")
    return seen.groupBy(*key).agg(F.bool_and(F.col("entry_id").isNull() | F.coalesce("shown", F.lit(False))).alias("allowed"))


def subscriptions(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(docket_id, status): 'exists' or, to be created, 'created', for each docket wanted; other kinds of alert do not count."""
    have = existing.where("alert_type = 1").select("docket_id", F.lit(True).alias("have")).distinct()
    return wanted.select("docket_id").distinct().join(have, "docket_id", "left").select("docket_id", F.when(F.col("have"), "exists").otherwise("created").alias("status"))


def missing_metadata(configured: DataFrame, dockets: DataFrame, courts: DataFrame) -> DataFrame:
    """(kind, id): dockets whose court is unknown and courts without a citation, to be fetched."""
    known = dockets.where("court_id IS NOT NULL").select("docket_id")
    a = configured.select("docket_id").distinct().join(known, "docket_id", "left_anti").select(F.lit("docket").alias("kind"), F.col("docket_id").cast("string").alias("id"))
    cited = F.broadcast(courts.where("citation IS NOT NULL").select("court_id"))  # courts are a fixed dimension
    b = dockets.where("court_id IS NOT NULL").select("court_id").distinct().join(cited, "court_id", "left_anti").select(F.lit("court").alias("kind"), F.col("court_id").alias("id"))
    return a.unionByName(b)


def pinned_documents(extra: DataFrame, dockets: DataFrame, fit: Column) -> DataFrame:
    """(docket_number, court_id, doc_id): documents pinned to any docket of a logical docket, if their text is fit for use."""
    groups = dockets.select("docket_id", "docket_number", "court_id")
    return extra.where(fit).join(groups, "docket_id").select("docket_number", "court_id", "doc_id").distinct()


def around_date(targets: DataFrame, entries: DataFrame, back: int = 2, ahead: int = 45, most: int = 20) -> DataFrame:
    """(target key, entry_id): entries of the docket filed in [day - back, day + ahead], the newest ``most`` of each target."""
    near = F.col("date_filed").between(F.date_sub("start_date", back), F.date_add("start_date", ahead))
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / (back + ahead + 1))
    low, high = bucket(F.date_sub("start_date", back)), bucket(F.date_add("start_date", ahead))
    spans = targets.withColumn("bucket", F.explode(F.array_distinct(F.array(low, high))))  # two at most
    days = entries.select("docket_id", "entry_id", "date_filed", bucket(F.col("date_filed")).alias("bucket"))
    joined = spans.hint("merge").join(days.hint("merge"), ["docket_id", "bucket"]).where(near)
    newest = Window.partitionBy("case_id", "hearing_key").orderBy(F.desc("date_filed"), F.desc("entry_id"))
    return joined.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= most).select("case_id", "hearing_key", "entry_id")


def lineage_numbers(rows: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """Entry numbers of ``source_entry_ids`` in source order; unknown ones are dropped."""
    exploded = rows.select(*key, F.posexplode_outer("source_entry_ids").alias("pos", "entry_id"))
    known = exploded.hint("merge").join(entries.select("entry_id", "entry_number").hint("merge"), "entry_id", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("entry_number").isNotNull(), F.struct("pos", "entry_number"))))
    return known.groupBy(*key).agg(F.transform(listed, lambda s: s["entry_number"]).alias("entry_numbers"))


def siblings_with_text(dockets: DataFrame, has_text: DataFrame) -> DataFrame:
    """For each docket without primary text the first sibling of its case, in case order, that has some."""
    flagged = dockets.join(has_text.select("docket_id", F.lit(True).alias("has_text")).distinct(), "docket_id", "left").withColumn("has_text", F.col("has_text").isNotNull())
    give = flagged.where("has_text").groupBy("case_id").agg(F.min_by("docket_id", F.struct("pos", "docket_id")).alias("from_docket"))
    return flagged.where("NOT has_text").join(give, "case_id").select("case_id", "docket_id", "from_docket")


def first_usable(candidates: DataFrame, checks: DataFrame) -> DataFrame:
    """For each row of ``candidates(id, pos, url)`` the first url whose check is ok; without any, the original unless all known checks are 4xx."""
    seen = candidates.hint("merge").join(checks.select("url", "outcome").hint("merge"), "url", "left")
    return seen.groupBy("id").agg(
        F.coalesce(
            F.min_by("url", F.when(F.col("outcome") == "ok", F.col("pos"))),
            F.when(~F.coalesce(F.bool_or(F.col("outcome") == "4xx"), F.lit(False)), F.min_by("url", "pos")),
        ).alias("url")
    )


def visible_in_court(events: DataFrame, dockets: DataFrame, court: str) -> DataFrame:
    """Events of a docket that is missing, of unknown court, or of this court."""
    courts = dockets.select("docket_id", "court_id")
    return events.join(courts, "docket_id", "left").where(F.col("court_id").isNull() | (F.col("court_id") == "unk") | (F.col("court_id") == court))
