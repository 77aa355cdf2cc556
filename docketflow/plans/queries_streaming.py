"""Queries that run a stream over the events that are there."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketflow.functions import text as T
from docketflow.operators import folds
from docketflow.operators.tables import new_folder
from docketflow.plans import queries_events as events_sql
from docketflow.plans.queries_ingest import _hit
from docketflow.sources.adapter import VIEWS, view, with_views
from docketflow.streaming import alerts
from docketflow.streaming.keyed import Due, KeyedStream

_LAST = "SELECT case_id, hearing_key, arg_max(CASE type WHEN 'CANCEL_HEARING' THEN 'cancelled' ELSE 'scheduled' END, (entry_date, event_id)) AS status FROM actions_v WHERE type <> 'MARK_HELD' GROUP BY case_id, hearing_key"


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def stream_status(spark: SparkSession, sf_dir: str):
    """The events table as a stream of actions, folded to the newest status of each key."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").createOrReplaceTempView("events")
    actions = spark.sql(VIEWS["actions_v"][1])
    return alerts.run_once(alerts.newest_status(actions), _folder(spark), ["case_id", "hearing_key"])


def delivered_entries(spark: SparkSession, sf_dir: str):
    """The events table written as deliveries, two of them under one key each, and run through as a stream of files; some entries are broken."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda c: F.col(c).cast("string")
    entry = F.struct(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", F.lit("no number")).otherwise(text("user_id")).alias("docket"), F.lit(None).cast("long").alias("entry_number"),
        F.when(F.col("event_type") == "signup", F.lit("soon")).otherwise(F.col("ts").cast("date").cast("string")).alias("date_filed"), text("ts").alias("date_modified"), F.col("props").alias("description"), F.lit(None).cast("string").alias("short_description"),
    )
    rows = events.select(
        F.concat(F.lit("k"), text("user_id"), F.lit("-"), F.col("ts").cast("date").cast("string")).alias("idempotency_key"), F.col("ts").alias("received_at"),
        F.struct(F.when(F.col("event_type") == "view", 2).otherwise(1).alias("event_type")).alias("webhook"), entry.alias("entry"), "user_id",
    )
    one = rows.groupBy("idempotency_key").agg(F.min("received_at").alias("received_at"), F.struct(F.lit(1).alias("event_type")).alias("webhook"), F.struct(F.collect_list("entry").alias("results")).alias("payload"))
    one.unionByName(one).write.json(f"{folder}/in")  # every delivery comes twice
    routes = events.select(F.col("user_id").alias("docket_id")).distinct().select("docket_id", F.concat(F.lit("case-"), (F.col("docket_id") % 5).cast("string")).alias("case_id"), F.concat(F.lit("cal-"), (F.col("docket_id") % 3).cast("string")).alias("calendar"))
    alerts.processed(alerts.deliveries(spark, f"{folder}/in"), folder, routes)
    found = alerts.stored_entries(spark, folder).groupBy("calendar").agg(F.count("*").alias("entries"), F.countDistinct("case_id").alias("cases"), F.max("date_filed").cast("string").alias("last_filed"))
    bad = spark.read.schema("entry string, batch long").parquet(f"{folder}/bad").groupBy().agg(F.lit("quarantine").alias("calendar"), F.count("*").alias("entries"), F.lit(0).cast("long").alias("cases"), F.lit(None).cast("string").alias("last_filed"))
    return found.unionByName(bad)


def debounced_users(spark: SparkSession, sf_dir: str):
    """Bursts of each user's events with under an hour between them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return alerts.debounced(events, "user_id", "ts", "3600 seconds").select("user_id", F.unix_micros("quiet_at").alias("quiet_us"), "n")


def _in_batches(rows, folder: str, batch, parts: int, run) -> None:
    """``rows`` written as ``parts`` deliveries, by the number ``batch`` gives each row, and ``run`` on the stream of them after each: all files there are one delivery."""
    for i in range(parts):
        rows.where(batch == i).write.mode("append").parquet(f"{folder}/in")
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in"))


_SEQ = "struct<entry_date:date,event_id:bigint>"
_DUE = Due("unix_micros(to_utc_timestamp(to_timestamp(concat(cast(due_date AS string), ' ', lpad(cast(coalesce(due_hour, 16) AS string), 2, '0'), ':00:00')), timezone))")


def stream_hearings(spark: SparkSession, sf_dir: str):
    """Actions dealt over deliveries at random, folded delivery by delivery: the rows of the batch fold."""
    folder = _folder(spark)
    actions = folds.HEARINGS.actions(events_sql.as_steps(view(spark, sf_dir, "actions_v"))).withColumn("clock_us", F.lit(0).cast("long"))
    state = KeyedStream(spark, f"{folder}/fold", folds.HEARINGS, _SEQ, buckets=8)
    _in_batches(actions, folder, F.pmod(F.xxhash64("entry_id"), F.lit(3)), 3, lambda s: state.run(s, "clock_us", f"{folder}/state"))
    sources = F.array_join(F.col("source_entry_ids").cast("array<string>"), ",").alias("sources")
    return state.rows().select("case_id", "hearing_key", "status", F.col("local_date").cast("string").alias("local_date"), "local_hour", "title", "notes", "docket_id", sources)


def stream_past_due(spark: SparkSession, sf_dir: str):
    """Deadlines folded delivery by delivery in order of time; each delivery's clock also ends what fell due elsewhere."""
    folder = _folder(spark)
    actions = events_sql.as_deadline_steps(view(spark, sf_dir, "actions_v"))
    clock = F.unix_micros(F.col("seq.entry_date").cast("timestamp"))
    rows = folds.DEADLINES.actions(actions).withColumn("clock_us", clock)
    state = KeyedStream(spark, f"{folder}/fold", folds.DEADLINES, _SEQ, buckets=8, due=_DUE)
    months = F.least((F.dayofyear("seq.entry_date") / 10).cast("int"), F.lit(2))
    _in_batches(rows, folder, months, 3, lambda s: state.run(s, "clock_us", f"{folder}/state"))
    return state.rows().select("case_id", "deadline_key", "status", F.col("due_date").cast("string").alias("due_date"), F.size("source_entry_ids").cast("long").alias("sources"))


def stream_debounced(spark: SparkSession, sf_dir: str):
    """``debounced_users`` on a stream of four deliveries in order of time, each burst given out once; a last row moves the clock past all of them."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    end = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.timestamp_micros(F.lit(high + 10 * 3_600_000_000)).alias("ts"))
    quarter = F.least(F.floor((F.unix_micros("ts") - low) * 4 / F.lit(max(high - low, 1))), F.lit(4)).cast("int")
    quiet = lambda stream: alerts.run_appended(alerts.debounced(stream.withWatermark("ts", "0 seconds"), "user_id", "ts", "3600 seconds"), folder)
    _in_batches(events.unionByName(end), folder, quarter, 5, quiet)
    return spark.read.schema("user_id long, quiet_at timestamp, n long").parquet(f"{folder}/out").select("user_id", F.unix_micros("quiet_at").alias("quiet_us"), "n")


def stream_delivery_stats(spark: SparkSession, sf_dir: str):
    """Counts of each delivery, a quarter of a year of filings, taken while the stream runs."""
    folder = _folder(spark)
    entries = view(spark, sf_dir, "entries_v").select("docket_id", "entry_id", "description", F.quarter("date_filed").alias("quarter"))
    routes = view(spark, sf_dir, "dockets_v").select("docket_id", "case_id").where("case_id <> 'case-1'")
    count = lambda stream: alerts.run_counted(alerts.counted(stream, routes, T.is_hearing(F.col("description")), "deliveries"), "deliveries", folder)
    _in_batches(entries, folder, F.col("quarter") - 1, 4, count)
    counts = spark.read.schema("received long, processed long, relevant long, unknown long, batch long").parquet(f"{folder}/metrics")
    return counts.select((F.col("batch") + 1).alias("quarter"), "received", "processed", "relevant", "unknown")


QUERIES = {
    "stream_status": stream_status, "delivered_entries": delivered_entries, "debounced_users": debounced_users, "stream_hearings": stream_hearings,
    "stream_past_due": stream_past_due, "stream_debounced": stream_debounced, "stream_delivery_stats": stream_delivery_stats,
}
_DUE_US = events_sql._INSTANT.format("due_date", "due_hour", 16)
ORACLE = {
    "stream_status": with_views("actions_v", _LAST),
    "delivered_entries": "WITH e AS (SELECT *, event_type IN ('error', 'signup') AS bad FROM events) SELECT 'cal-' || cast(user_id % 3 AS string) AS calendar, count(*) AS entries, count(DISTINCT user_id % 5) AS cases, cast(max(cast(ts AS date)) AS string) AS last_filed FROM e WHERE NOT bad GROUP BY user_id % 3 "
    "UNION ALL SELECT 'quarantine', count(*), 0, NULL FROM e WHERE bad",
    "debounced_users": "WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g) SELECT user_id, max(us) + 3600000000 AS quiet_us, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_hearings": with_views("actions_v", f"SELECT case_id, key AS hearing_key, status, cast(local_date AS string) AS local_date, local_hour, title, notes, docket_id, array_to_string(sources, ',') AS sources FROM {events_sql.HEARING_ROWS} s"),
    "stream_past_due": with_views(
        "actions_v",
        f"SELECT case_id, key AS deadline_key, CASE WHEN status = 'pending' AND {_DUE_US} < (SELECT max(epoch_us(cast(entry_date AS timestamp))) FROM actions_v) THEN 'passed' ELSE status END AS status, "
        f"cast(due_date AS string) AS due_date, cast(len(sources) AS bigint) AS sources FROM {events_sql.DEADLINE_ROWS} s",
    ),
    "stream_delivery_stats": with_views(
        "entries_v dockets_v",
        f"SELECT quarter(date_filed) AS quarter, count(*) AS received, count(case_id) AS processed, count_if(case_id IS NOT NULL AND {_hit('description', 'HEARING')}) AS relevant, count(*) - count(case_id) AS unknown "
        "FROM entries_v e LEFT JOIN (SELECT * FROM dockets_v WHERE case_id <> 'case-1') d ON d.docket_id = e.docket_id GROUP BY quarter(date_filed)",
    ),
}
ORACLE["stream_debounced"] = ORACLE["debounced_users"]
