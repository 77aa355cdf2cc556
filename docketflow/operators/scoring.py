"""Ledgers, model-against-truth scores, funnels and rolling peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ["h_scheduled", "h_rescheduled", "h_cancelled", "h_held", "d_set", "d_rescheduled", "d_cancelled", "d_met"]


#: Columns of a price list.
RATES = ("rate_in", "rate_cached", "rate_write", "rate_out")
#: The end of a model's name that pins a snapshot of it.
SNAPSHOT = r"(-\d{4}-\d{2}-\d{2}|-\d{3,8})$"
#: Rows of a price list that are broadcast at most.
MOST_RATES = 100_000


def priced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls with a cost in micro-dollars: rates by exact model, else without the end that pins a snapshot; local models cost 0, unknown ones null.

    ``tokens_in`` counts what is read from the cache and written to it too; each part has a rate of its own.
    """
    few = rates.limit(MOST_RATES + 1).count() <= MOST_RATES
    listed = lambda name, end: (lambda r: F.broadcast(r) if few else r.hint("merge"))(rates.select(F.col("model").alias(name), *[F.col(c).alias(c + end) for c in RATES]))
    both = calls.withColumn("stem", F.regexp_replace("model", SNAPSHOT, "")).join(listed("model", "_a"), "model", "left").join(listed("stem", "_b"), "stem", "left")
    rate = {c: F.coalesce(f"{c}_a", f"{c}_b") for c in RATES}
    fresh = F.greatest(F.lit(0), F.col("tokens_in") - F.col("cached") - F.col("cache_write"))
    cost = fresh * rate["rate_in"] + F.col("cached") * rate["rate_cached"] + F.col("cache_write") * rate["rate_write"] + F.col("tokens_out") * rate["rate_out"]
    return both.withColumn("cost", F.when(F.col("model").startswith("local:"), F.lit(0)).otherwise(cost)).drop("stem", *[f"{c}_{s}" for c in rate for s in "ab"])


def ledger(calls: DataFrame) -> DataFrame:
    """Per docket (null as '?'), per model and in total: calls, tokens, cost, unpriced calls."""
    rows = calls.withColumn("docket", F.coalesce("docket", F.lit("?")))
    sums = [F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cached").alias("cached"), F.sum("cache_write").alias("cache_write"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced")]
    return rows.groupingSets([["docket"], ["model"], []], "docket", "model").agg(*sums)


def call_tracks(calls: DataFrame) -> DataFrame:
    track = F.when(F.col("purpose") == "summary", "summary").otherwise("extraction")
    return calls.groupBy("model", track.alias("track")).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.round(F.avg("tokens_out"), 6).alias("mean_out"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


def compared(truth: DataFrame, model: DataFrame) -> DataFrame:
    """(provider, entry_id, docket, category, human, found): every truth row against every provider; missing model rows are 0."""
    providers = model.select("provider").distinct()
    rows = truth.crossJoin(F.broadcast(providers))  # a row a provider
    found = model.select("provider", "entry_id", *[F.col(c).alias(f"m_{c}") for c in CATEGORIES])
    rows = rows.join(found, ["provider", "entry_id"], "left")
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("long").alias("human"), F.coalesce(f"m_{c}", F.lit(0)).cast("long").alias("found")) for c in CATEGORIES])
    return rows.select("provider", "entry_id", "docket", F.inline(pairs))


def deviation(rows: DataFrame, by: list[str]) -> DataFrame:
    over, under = F.sum(F.greatest(F.col("found") - F.col("human"), F.lit(0))), F.sum(F.greatest(F.col("human") - F.col("found"), F.lit(0)))
    return rows.groupBy(*by).agg(over.alias("over"), under.alias("under"))


def docket_deviation(rows: DataFrame) -> DataFrame:
    """Counts are summed for each docket before they are compared."""
    sums = rows.groupBy("provider", "docket", "category").agg(F.sum("human").alias("human"), F.sum("found").alias("found"))
    return deviation(sums, ["provider", "category"])


def universal_misses(rows: DataFrame) -> DataFrame:
    """Entries with human actions that no provider found anything for, and their share of all human actions."""
    sums = rows.groupBy("provider", "entry_id").agg(F.sum("human").alias("human"), F.sum("found").alias("found"))
    entries = sums.groupBy("entry_id").agg(F.max("human").alias("human"), F.max("found").alias("found"))
    total = entries.agg(F.sum("human").alias("total"))  # one row
    missed = entries.where("human > 0 AND found = 0").crossJoin(F.broadcast(total))
    return missed.select("entry_id", "human", (F.col("human") / F.col("total")).alias("share"))


def buckets(rows: DataFrame) -> DataFrame:
    bucket = F.when(F.col("category").isin("h_scheduled", "d_set"), "add").when(F.col("category").isin("h_cancelled", "d_cancelled"), "cancel").otherwise("lifecycle")
    return rows.groupBy("provider", bucket.alias("bucket")).agg(F.sum("human").alias("human"), F.sum("found").alias("found"))


#: The category an action counts for; other types count for none.
CATEGORY_OF = {
    "ADD_HEARING": "h_scheduled", "RESCHEDULE_HEARING": "h_rescheduled", "CANCEL_HEARING": "h_cancelled", "MARK_HELD": "h_held",
    "ADD_DEADLINE": "d_set", "RESCHEDULE_DEADLINE": "d_rescheduled", "CANCEL_DEADLINE": "d_cancelled", "MARK_FILED": "d_met",
}


def action_counts(actions: DataFrame) -> DataFrame:
    """(label, entry_id, a column a category) of ``actions(label, entry_id, type)``; one pass, and entries without counted actions are 0."""
    counts = [F.count_if(F.upper("type") == kind).alias(c) for kind, c in CATEGORY_OF.items()]
    return actions.groupBy("label", "entry_id").agg(*counts)


# What a minor key is about, by the first word that is found.
MINOR = {"redaction": "transcript redaction-request", "amicus": "amicus response / reply", "transcript": "other transcript"}


def minor_bucket(key: Column) -> Column:
    bucket = F.when(F.lit(False), F.lit(""))
    for word, name in MINOR.items():
        bucket = bucket.when(F.contains(key, F.lit(word)), name)
    return bucket.otherwise("other procedural")


def first_firings(actions: DataFrame) -> DataFrame:
    """Keeps a (type, key, date) signature only on the first entry that fired it; repeats on that entry stay."""
    sig = Window.partitionBy("case_id", "type", "hearing_key", "local_date").orderBy("entry_date", "event_id")
    return actions.withColumn("first_entry", F.first("entry_date").over(sig)).where("entry_date = first_entry").select("event_id")


def peak(rows: DataFrame, by: str, stamp: str, seconds: int) -> DataFrame:
    """Most rows of each ``by`` in a half-open window of so many seconds; ``stamp`` is in microseconds."""
    window = Window.partitionBy(by).orderBy(stamp).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumn("n", F.count("*").over(window)).groupBy(by).agg(F.max("n").alias("peak"))


def funnel(rows: DataFrame) -> DataFrame:
    """(rows, visible) of folded rows, in one pass."""
    visible = F.col("local_date").isNotNull() & ~F.col("significance").eqNullSafe("minor")
    return rows.agg(F.sum("n").alias("applied"), F.count("*").alias("rows"), F.count_if(visible).alias("visible"))
