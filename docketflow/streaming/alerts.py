"""Alert deliveries as a stream: once each, routed, counted, debounced; the newest status of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ENTRY = "struct<id:bigint,docket:string,entry_number:bigint,date_filed:string,date_modified:string,description:string,short_description:string>"
DELIVERY = f"idempotency_key string, received_at timestamp, webhook struct<event_type:int>, payload struct<results:array<{ENTRY}>>"


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of delivery files under ``folder``."""
    return spark.readStream.schema(DELIVERY).json(folder)


def undelivered(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Deliveries whose key the ledger lacks, the first of each key by (received_at, content); blank keys always pass."""
    blank = F.coalesce(F.trim("idempotency_key"), F.lit("")) == ""
    first = F.min_by(F.struct(*rows.columns), F.struct("received_at", F.to_json(F.struct("webhook", "payload")))).alias("r")
    fresh = rows.where(~blank).groupBy("idempotency_key").agg(first).select("r.*").join(ledger.select("idempotency_key"), "idempotency_key", "left_anti")
    return rows.where(blank).unionByName(fresh)


def newest_status(actions: DataFrame) -> DataFrame:
    """The status after the newest action of each key, by time and not by arrival; batch and stream alike."""
    status = F.when(F.col("type") == "CANCEL_HEARING", "cancelled").otherwise("scheduled")
    return actions.where("type <> 'MARK_HELD'").groupBy("case_id", "hearing_key").agg(F.max_by(status, F.struct("entry_date", "event_id")).alias("status"))


def debounced(rows: DataFrame, key: str, stamp: str, gap: str = "300 seconds") -> DataFrame:
    """Runs of rows of a key with less than ``gap`` between neighbours: when each falls quiet, and how many rows it has.

    On a stream with a watermark every row of a key puts off the end of its run,
    and the run is given out once, when the watermark has passed that end.
    """
    return rows.groupBy(key, F.session_window(stamp, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.end").alias("quiet_at"), "n")


def run_once(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Runs a streaming aggregation over what is there now and returns the last row of each key.

    Every micro-batch writes the keys it changed under its own number, so a repeated batch overwrites itself.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = stream.sparkSession.read.option("basePath", f"{folder}/out").schema(schema.add("batch", "long")).parquet(f"{folder}/out")
    rest = [c for c in schema.names if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


class BatchMetrics(StreamingQueryListener):
    """Carries what ``observe(name, ...)`` counted in each batch of a stream to a table, a row a batch; no second pass."""

    def __init__(self, spark: SparkSession, name: str, folder: str, schema: str):
        self.spark, self.name, self.folder, self.schema = spark, name, folder, schema

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and event.progress.numInputRows:
            row = self.spark.createDataFrame([tuple(found)], self.schema)
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={event.progress.batchId}")

    def onQueryTerminated(self, event) -> None:
        pass


def counted(entries: DataFrame, routes: DataFrame, relevant: Column, name: str) -> DataFrame:
    """A stream of entries with their route (none: null) that counts, as it runs, what is received, processed, relevant and unknown."""
    rows = entries.join(routes.select("docket_id", "case_id").hint("merge"), "docket_id", "left").withColumn("relevant", relevant)
    known = F.col("case_id").isNotNull()
    return rows.observe(name, F.count("*").alias("received"), F.count_if(known).alias("processed"), F.count_if(known & F.col("relevant")).alias("relevant"), F.count_if(~known).alias("unknown"))


def run_counted(rows: DataFrame, name: str, folder: str) -> DataFrame:
    """Runs a counted stream into ``folder/rows`` and returns (received, processed, relevant, unknown, batch)."""
    spark, schema = rows.sparkSession, "received long, processed long, relevant long, unknown long"
    listener = BatchMetrics(spark, name, f"{folder}/metrics", schema)
    spark.streams.addListener(listener)
    try:
        query = rows.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/rows").start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(schema + ", batch long").parquet(f"{folder}/metrics")


def run_appended(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream whose rows are final once they are out, and returns them; a restart goes on where it stood."""
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def processed(stream: DataFrame, folder: str, routes: DataFrame) -> None:
    """Runs deliveries through: what is delivered before is left out, broken entries are kept aside, the others routed and stored.

    Under ``folder``: ``fresh`` (what a batch takes in, written once and read by all that follows), ``entries`` (a folder a batch),
    ``bad``, ``calendars`` (those a batch touches) and ``ledger``, which is written last, so that a batch that fails is read
    again in full and overwrites itself.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        ledger = spark.read.schema("idempotency_key string, batch long").parquet(f"{folder}/ledger").where(F.col("batch") != number)
        undelivered(batch, ledger).write.mode("overwrite").parquet(f"{folder}/fresh/batch={number}")
        fresh = spark.read.schema(batch.schema).parquet(f"{folder}/fresh/batch={number}")
        rows = fresh.where("webhook.event_type = 1").select("idempotency_key", "received_at", F.explode("payload.results").alias("e"))
        known = F.expr("try_cast(e.docket AS bigint)")
        good = F.col("e.id").isNotNull() & known.isNotNull() & F.expr("try_cast(e.date_filed AS date)").isNotNull()
        ok = F.coalesce(good, F.lit(False))
        routed = rows.where(ok).select("received_at", known.alias("docket_id"), F.col("e.id").alias("entry_id"), F.col("e.date_filed").cast("date").alias("date_filed"), "e.description")
        routed.join(routes.hint("merge"), "docket_id").write.mode("overwrite").parquet(f"{folder}/entries/batch={number}")
        rows.where(~ok).select(F.to_json("e").alias("entry")).write.mode("overwrite").parquet(f"{folder}/bad/batch={number}")
        stored = spark.read.schema("calendar string").parquet(f"{folder}/entries/batch={number}")
        stored.distinct().write.mode("overwrite").parquet(f"{folder}/calendars/batch={number}")
        fresh.select("idempotency_key").where("idempotency_key IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")

    spark.createDataFrame([], "idempotency_key string").write.mode("ignore").parquet(f"{folder}/ledger/batch=-1")
    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def stored_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of each routed entry."""
    schema = "docket_id long, received_at timestamp, entry_id long, date_filed date, description string, case_id string, calendar string, batch long"
    rows = spark.read.schema(schema).parquet(f"{folder}/entries")
    newest = rows.groupBy("docket_id", "entry_id").agg(F.max_by(F.struct("case_id", "calendar", "date_filed", "description"), F.struct("received_at", "description")).alias("r"))
    return newest.select("docket_id", "entry_id", "r.*")
