"""Jobs over several tables of state: published together, replayed in ordered steps, or refolded key by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.functions.text import audit_line, key_title
from docketflow.operators import sweeps
from docketflow.operators.folds import Fold
from docketflow.operators.tables import written

GROUP = ["docket_number", "court_id"]


def publish(folder: str, tables: dict[str, DataFrame]) -> int:
    """Writes all tables as one new version and returns its number.

    A version counts once its list of tables is there, which is written last:
    readers see all of its tables or none, and a job that fails leaves the version before.
    """
    spark = next(iter(tables.values())).sparkSession
    number = newest(spark, folder) + 1
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/tables/version={number}/{name}")
    listed = spark.createDataFrame([(name,) for name in tables], "name string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/version={number}")
    return number


def newest(spark: SparkSession, folder: str) -> int:
    """The number of the newest version; 0 if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.schema("name string, version int").parquet(f"{folder}/versions").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/tables/version={newest(spark, folder)}/{name}")


def cascaded(tables: dict[str, DataFrame], dockets: DataFrame, summaries: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the dockets of ``gone``: rows by docket go with it, a summary only with the last docket of its group.

    A docket without a number or court has no group, and takes no summary along; nor do groups that never had a docket lose theirs.
    """
    ids = gone.select("docket_id").distinct()
    grouped = dockets.where("coalesce(docket_number, '') <> '' AND coalesce(court_id, '') <> ''")
    left = dockets.join(ids, "docket_id", "left_anti")
    live = grouped.join(ids, "docket_id", "left_anti").select(*GROUP).distinct()
    lost = grouped.join(ids, "docket_id", "left_semi").select(*GROUP).distinct().join(live, GROUP, "left_anti")
    kept = {name: rows.join(ids, "docket_id", "left_anti") for name, rows in tables.items()}
    return {**kept, "dockets": left, "summaries": summaries.join(lost, GROUP, "left_anti")}


def refolded(fold: Fold, rows: DataFrame, history: DataFrame, retracted: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """``rows`` (all columns of the fold) after the actions of some entries are taken back and others come in.

    ``history`` has the actions that made ``rows``, ``retracted(entry_id)`` the entries that are
    read again, ``added`` the actions that come of it.  Only the keys that either touches are folded, from their whole history.
    """
    key = ["case_id", fold.key]
    back = retracted.select("entry_id").distinct()
    old = fold.actions(history)
    touched = old.join(back, "entry_id", "left_semi").select(*key)
    kept = old.join(back, "entry_id", "left_anti")
    if added is not None:
        new = fold.actions(added)
        touched, kept = touched.union(new.select(*key)), kept.unionByName(new)
    touched = written(touched.distinct(), "touched")
    anew = fold.steps(kept.join(touched.hint("merge"), key, "left_semi")).select(*key, fold.advanced(fold.start()).alias("s")).where("s.n > 0").select(*key, "s.*")
    return rows.join(touched.hint("merge"), key, "left_anti").unionByName(anew.select(*rows.columns))


def verified(rows: DataFrame, verdicts: DataFrame, zone: str = "UTC") -> DataFrame:
    """Whole hearing rows after their verdicts (case_id, hearing_key, verdict, reason, new_date, new_hour, shown_ids).

    A deletion needs all the row's sources among what was shown, and only cancels; a new
    date stands in the row's own zone (``zone`` where it has none); what changes
    a row but MARK_HELD leaves an audit line with its reason or a standing one.
    """
    said = verdicts.select("case_id", "hearing_key", "verdict", "reason", "new_date", "new_hour", "shown_ids")
    both = rows.join(said.hint("merge"), ["case_id", "hearing_key"], "left")
    v = F.upper(F.coalesce("verdict", F.lit("UNCLEAR")))
    seen = F.size(F.array_except(F.coalesce("source_entry_ids", F.array().cast("array<bigint>")), F.coalesce("shown_ids", F.array().cast("array<bigint>")))) == 0
    # What is noted where a verdict gives no reason.
    standing = {
        "CANCEL_HEARING": "Cancelled per recent docket entries", "DELETE_HALLUCINATION": "No docket entry supports this hearing",
        "REINSTATE": "Cancellation not supported by docket; reinstated to scheduled", "RESCHEDULE_HEARING": "Rescheduled per recent docket entries",
    }
    applies = v.isin("CANCEL_HEARING", "MARK_HELD", "REINSTATE") | ((v == "DELETE_HALLUCINATION") & seen) | ((v == "RESCHEDULE_HEARING") & F.col("new_date").isNotNull())
    verdict = F.when(applies, v)
    status = F.when(verdict.isin("CANCEL_HEARING", "DELETE_HALLUCINATION"), "cancelled").when(verdict == "MARK_HELD", "held").when(verdict == "REINSTATE", "scheduled").otherwise(F.col("status"))
    moved = F.coalesce(verdict == "RESCHEDULE_HEARING", F.lit(False))
    note = F.coalesce(F.nullif("reason", F.lit("")), F.element_at(F.create_map(*[F.lit(x) for kv in standing.items() for x in kv]), verdict))
    new = {
        "status": status, "local_date": F.when(moved, F.col("new_date")).otherwise(F.col("local_date")), "local_hour": F.when(moved, F.col("new_hour")).otherwise(F.col("local_hour")),
        "timezone": F.when(moved, F.coalesce("timezone", F.lit(zone))).otherwise(F.col("timezone")),
        "audit_notes": F.when(verdict.isin(*standing), audit_line(F.col("audit_notes"), "verify-pass", note)).otherwise(F.col("audit_notes")),
    }
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def held_once(rows: DataFrame, dockets: DataFrame) -> DataFrame:
    """Whole hearing rows with held ones of one case, logical docket and start merged into one."""
    slot = ["case_id", *GROUP, "local_date", "local_hour"]
    held = sweeps.logical(rows.where("status = 'held' AND local_date IS NOT NULL"), dockets.select("docket_id", *GROUP))
    held = held.withColumn("derived", F.coalesce(F.col("title"), F.lit("")) == key_title(F.col("hearing_key"))).withColumn("last_updated", F.lit(""))
    why = F.concat(F.lit(" at same UTC slot "), F.concat_ws(" ", F.col("local_date").cast("string"), F.col("local_hour").cast("string")))
    merged = sweeps.merged_clusters(held, slot, "hearing_key", "dedupe-held", why).where(F.size("absorbed") > 0)
    merged = written(merged.select("case_id", "survivor", "absorbed", *[F.col(c).alias(f"new_{c}") for c in ("source_entry_ids", "notes", "title", "audit_notes")]), "merged")
    gone = merged.select("case_id", F.explode("absorbed").alias("hearing_key"))
    both = rows.join(gone.hint("merge"), ["case_id", "hearing_key"], "left_anti").join(merged.drop("absorbed").withColumnRenamed("survivor", "hearing_key").withColumn("merged", F.lit(True)).hint("merge"), ["case_id", "hearing_key"], "left")
    return both.select(*[F.when(F.col("merged"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if f"new_{c}" in both.columns else F.col(c) for c in rows.columns])


def merged_by_verdicts(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Whole hearing rows after merges (case_id, key, target)."""
    marked = rows.withColumn("derived", F.coalesce(F.col("title"), F.lit("")) == key_title(F.col("hearing_key"))).withColumn("last_updated", F.lit(""))
    return sweeps.merged_rows(marked, plan, "hearing_key", source).select(*rows.columns)


def replayed_store(
    hearings: DataFrame, deadlines: DataFrame, dockets: DataFrame, verdicts: DataFrame, merges: DataFrame, near_merges: DataFrame, filed: DataFrame, due_us: Column, now_us: int, folds: tuple[Fold, Fold]
) -> dict[str, DataFrame]:
    """All derived rows of the cases of ``dockets``, rebuilt from their whole histories of actions; each step is a written table.

    Actions of dockets without a court are left out.  The order is fixed: fold,
    verdicts on hearings, merges at one slot (``merges``), held rows of one slot, near slots
    (``near_merges``), filed deadlines (case_id, deadline_key, verdict), and last what is past due at ``now_us``.
    """
    known = dockets.where("coalesce(court_id, '') <> ''").select("docket_id").distinct()
    live = [fold.rows(actions.join(known, "docket_id", "left_semi")).withColumn("audit_notes", F.lit(None).cast("string")) for fold, actions in zip(folds, (hearings, deadlines), strict=True)]
    rows, due = written(live[0], "folded"), written(live[1], "folded")
    rows = written(verified(rows, verdicts), "verified")
    rows = written(merged_by_verdicts(rows, merges, "dedupe"), "deduped")
    rows = written(held_once(rows, dockets), "held")
    rows = written(merged_by_verdicts(rows, near_merges, "dedupe-nearslot"), "near")
    open_ = (F.col("status") == "pending") & (due_us > now_us)
    said = filed.select("case_id", "deadline_key", "verdict")
    due = due.join(said.hint("merge"), ["case_id", "deadline_key"], "left")
    status = F.when(open_ & (F.col("verdict") == "MARK_FILED"), "met").when(open_ & F.col("verdict").isin("CANCEL_DEADLINE", "DELETE_HALLUCINATION"), "cancelled").otherwise(F.col("status"))
    due = written(due.withColumn("status", status).drop("verdict"), "filed")
    past = (F.col("status") == "pending") & (due_us < now_us)
    due = written(due.withColumn("status", F.when(past, "passed").otherwise(F.col("status"))), "passed")
    return {"hearings": rows, "deadlines": due}
