"""Sweeps over keyed state: clusters, merges, verdicts, staleness, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions.text import audit_line, base_key, best_title, once_only, record_rank, records_proceeding
from docketflow.operators.tables import written


def logical(rows: DataFrame, dockets: DataFrame) -> DataFrame:
    """``rows`` that have a docket, with (docket_number, court_id) of the logical docket; one without metadata is its own."""
    known = dockets.select("docket_id", F.col("docket_number").alias("_number"), F.col("court_id").alias("_court"))
    both = rows.where("docket_id IS NOT NULL").drop("docket_number", "court_id").join(known, "docket_id", "left")
    named = F.coalesce((F.col("_number") != "") & (F.col("_court") != ""), F.lit(False))
    own = F.concat(F.lit("#docket-id="), F.col("docket_id").cast("string"))
    return both.select("*", F.when(named, F.col("_number")).otherwise(own).alias("docket_number"), F.when(named, F.col("_court")).otherwise(F.lit("")).alias("court_id")).drop("_number", "_court")


def same_slot(hearings: DataFrame, dockets: DataFrame, status: str, earliest: str | None = None) -> DataFrame:
    """Rows that share case, logical docket and exact start with another one of the status; of scheduled ones those from ``earliest`` on."""
    rows = logical(hearings.where(F.col("status") == status), dockets)
    rows = rows if earliest is None else rows.where(F.col("start_date") >= F.lit(earliest).cast("date"))
    slot = Window.partitionBy("case_id", "docket_number", "court_id", "start_date", "start_hour")
    return rows.withColumn("size", F.count("*").over(slot)).where("size > 1").select("case_id", "hearing_key", "docket_number", "start_date", "start_hour", "size")


def near_slot(hearings: DataFrame, dockets: DataFrame, status: str) -> DataFrame:
    """Clusters of one case and logical docket on one day with more than one start."""
    rows = logical(hearings.where(F.col("status") == status), dockets)
    keys = F.array_sort(F.collect_list("hearing_key")).alias("keys")
    return rows.groupBy("case_id", "docket_number", "court_id", "start_date").agg(F.countDistinct("start_hour").alias("starts"), keys).where("starts > 1")


def once_only_clusters(hearings: DataFrame, dockets: DataFrame, near: DataFrame) -> DataFrame:
    """Held rows of one case, logical docket, kind of once-only proceeding and person, on any days, but those whose keys ``near`` (case_id, keys) holds."""
    taken = near.select("case_id", F.explode("keys").alias("hearing_key")).distinct()
    rows = logical(hearings.where("status = 'held'"), dockets).join(taken.hint("merge"), ["case_id", "hearing_key"], "left_anti").withColumn("base", once_only(F.col("hearing_key")))
    clusters = rows.where("base IS NOT NULL").groupBy("case_id", "docket_number", "court_id", "base").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("hearing_key")).alias("keys"))
    return clusters.where("size > 1")


def merged_clusters(rows: DataFrame, by: list[str], key: str, source: str, why: Column, target: str | None = None, order: Column | None = None) -> DataFrame:
    """One survivor a cluster, as (by, survivor, source_entry_ids, notes, title, audit_notes, absorbed).

    ``rows`` has the cluster's columns ``by``, ``key``, source_entry_ids, notes,
    title, ``derived`` (whether the title only spells the key), audit_notes and last_updated.
    The survivor is ``target``, else the shortest key that another one only
    adds a number to, else the key of most sources, oldest, smallest.  The
    others follow by ``order`` (else in that same order) and add their sources
    to its own.  Notes that record no proceeding give way to the best record
    among the others, a title that spells its key to their longest explicit one.
    The audit line names the keys that were absorbed and ``why`` (an expression over ``by``).
    """
    here = F.struct(F.col(key).alias("key"), "source_entry_ids", "notes", "title", "derived", "audit_notes")
    rank = F.struct((-F.size("source_entry_ids")).alias("few"), F.coalesce(F.col("last_updated").cast("string"), F.lit("")).alias("since"), F.col(key).alias("key"))
    chosen = F.first(target) if target else F.lit(None).cast("string")
    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), (order if order is not None else rank).alias("place"), here.alias("row")))).alias("all"), chosen.alias("chosen"))
    keys = F.transform("all", lambda x: x["row"]["key"])
    groups = groups.withColumn("keys", keys)
    groups = canonical_keys(groups).withColumn("survivor", F.coalesce("chosen", "canonical", F.col("all")[0]["row"]["key"]))
    own = F.filter("all", lambda x: x["row"]["key"] == F.col("survivor"))[0]["row"]
    placed = F.array_sort(F.transform("all", lambda x: F.struct(x["place"].alias("place"), x["row"].alias("row"))))
    others = F.transform(F.filter(placed, lambda x: x["row"]["key"] != F.col("survivor")), lambda x: x["row"])
    groups = groups.select("*", own.alias("own"), others.alias("others"))
    records = F.transform(F.filter("others", lambda x: records_proceeding(x["notes"])), lambda x: F.struct(record_rank(x["notes"]).alias("r"), (-F.length(x["notes"])).alias("l"), x["key"].alias("k"), x["notes"].alias("n")))
    notes = F.when(records_proceeding(F.col("own.notes")), F.col("own.notes")).otherwise(F.coalesce(F.array_min(records)["n"], F.col("own.notes")))
    titles = F.transform("others", lambda x: F.struct(x["key"].alias("key"), x["title"].alias("title"), x["derived"].alias("derived")))
    absorbed = F.transform("others", lambda x: x["key"])
    said = F.concat(F.lit("Absorbed sibling key(s) "), F.array_join("absorbed", ", "), why)
    out = groups.select(
        *by, "survivor", F.array_distinct(F.concat(F.col("own.source_entry_ids"), F.flatten(F.transform("others", lambda x: x["source_entry_ids"])))).alias("source_entry_ids"),
        notes.alias("notes"), best_title(titles, F.col("own.title"), F.col("own.derived")).alias("title"), F.col("own.audit_notes").alias("audit_notes"), absorbed.alias("absorbed"),
    )
    return out.withColumn("audit_notes", F.when(F.size("absorbed") > 0, audit_line(F.col("audit_notes"), source, said)).otherwise(F.col("audit_notes")))


def resolved_targets(plan: DataFrame) -> DataFrame:
    """(case_id, key, target) with every target a key that stays: chains are followed by pointer jumping.

    A key that is told to go to several takes the smallest.  Each round doubles
    the steps; keys that lead each other in a circle go to the smallest of it.
    """
    links = plan.where("key <> target").groupBy("case_id", "key").agg(F.min("target").alias("target"))
    links = written(links.withColumn("least", F.least("key", "target")), "targets")
    rounds = max(1, links.groupBy("case_id").count().agg(F.max("count")).first()[0] or 1).bit_length()
    for _ in range(rounds + 1):
        ahead = links.select("case_id", F.col("key").alias("target"), F.col("target").alias("next"), F.col("least").alias("least_ahead"))
        both = links.join(ahead.hint("merge"), ["case_id", "target"], "left")
        if both.where("next IS NOT NULL").isEmpty():
            return links.select("case_id", "key", "target")
        links = written(both.select("case_id", "key", F.coalesce("next", "target").alias("target"), F.least("least", F.coalesce("least_ahead", "least")).alias("least")), "targets")
    # What still leads on leads in a circle, all of which its target has seen.
    circle = links.select("case_id", F.col("key").alias("target"), F.col("least").alias("smallest"))
    both = links.join(circle.hint("merge"), ["case_id", "target"], "left").select("case_id", "key", F.coalesce("smallest", "target").alias("target"))
    return both.where("key <> target")


def merged_rows(rows: DataFrame, plan: DataFrame, key: str, source: str, reasons: DataFrame | None = None) -> DataFrame:
    """``rows`` after a plan (case_id, key, target) of merges: survivors with what they absorbed, and the rows it does not touch.

    A target without a row of its own leaves its keys alone.  ``rows`` has the
    columns ``merged_clusters`` takes, and others, which are the survivors'
    own; serves hearings and deadlines.  ``reasons(case_id, target, reason)``: what the audit line says.
    """
    plan = resolved_targets(plan).withColumnRenamed("key", key)
    there = rows.select("case_id", F.col(key).alias("target"))
    plan = written(plan.join(there.hint("merge"), ["case_id", "target"], "left_semi"), "merges")
    members = plan.unionByName(plan.select("case_id", F.col("target").alias(key), "target").distinct())
    found = rows.join(members.hint("merge"), ["case_id", key])
    if reasons is not None:
        found = found.join(reasons.hint("merge"), ["case_id", "target"], "left")
    found = found.withColumn("reason", F.coalesce("reason" if reasons is not None else F.lit(None), F.concat(F.lit("Duplicate of "), F.col("target"))))
    new = merged_clusters(found, ["case_id", "target", "reason"], key, source, F.concat(F.lit(": "), F.col("reason")), target="target", order=F.struct("docket_id", key))
    changed = ["source_entry_ids", "notes", "title", "audit_notes"]
    new = new.select("case_id", F.col("survivor").alias(key), *[F.col(c).alias(f"new_{c}") for c in changed], F.lit(True).alias("merged"))
    left = rows.join(plan.select("case_id", key).hint("merge"), ["case_id", key], "left_anti").join(new.hint("merge"), ["case_id", key], "left")
    values = [F.when(F.col("merged"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in changed]
    return left.select(*[c for c in rows.columns if c not in changed], *values)


def canonical_keys(clusters: DataFrame) -> DataFrame:
    """The shortest base b of ``keys`` such that b and b-<digits> are both there."""
    bases = F.filter("keys", lambda k: F.exists("keys", lambda o: (o != k) & (base_key(o) == k)))
    return clusters.withColumn("canonical", F.array_min(F.transform(bases, lambda b: F.struct(F.length(b).alias("l"), b.alias("b"))))["b"])


def past_due(deadlines: DataFrame, today: str) -> DataFrame:
    return deadlines.withColumn("status", F.when((F.col("status") == "pending") & (F.col("due_date") < F.lit(today).cast("date")), "passed").otherwise(F.col("status")))


def posture_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are new or whose status or start moved."""
    before = old.select(*keys, F.col("status").alias("old_status"), F.col("start_date").alias("old_start"), F.lit(True).alias("was"))
    rows = new.join(before, keys, "left")
    moved = F.col("was").isNull() | ~F.col("status").eqNullSafe(F.col("old_status")) | ~F.col("start_date").eqNullSafe(F.col("old_start"))
    return rows.where(moved).select(*keys, "docket_id", F.when(F.col("was").isNull(), "new").when(~F.col("status").eqNullSafe(F.col("old_status")), "status").otherwise("start").alias("change"))


def stale_after(changes: DataFrame, dockets: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries of logical dockets that a change touches."""
    touched = changes.join(dockets.select("docket_id", "docket_number", "court_id"), "docket_id").select("docket_number", "court_id").distinct()
    return summaries.join(touched, ["docket_number", "court_id"], "left_semi")


def needs_summary(dockets: DataFrame, summaries: DataFrame, force: bool = False) -> DataFrame:
    groups = dockets.select("docket_number", "court_id").distinct()
    return groups.join(summaries.select("docket_number", "court_id", "stale"), ["docket_number", "court_id"], "left").where(F.coalesce("stale", F.lit(True)) | F.lit(force)).select("docket_number", "court_id")


def applied_verdicts(hearings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Hearing rows after their verdicts; a deletion needs all its sources to have been shown, and only cancels."""
    rows = hearings.join(verdicts, ["case_id", "hearing_key"], "left")
    allowed = F.size(F.array_except("source_entry_ids", F.coalesce("shown_ids", F.array().cast("array<bigint>")))) == 0
    v = F.col("verdict")
    status = F.when(v == "CANCEL_HEARING", "cancelled").when((v == "DELETE_HALLUCINATION") & allowed, "cancelled").when(v == "MARK_HELD", "held").when(v == "REINSTATE", "scheduled").otherwise(F.col("status"))
    start = F.when((v == "RESCHEDULE_HEARING") & F.col("new_date").isNotNull(), F.col("new_date")).otherwise(F.col("start_date"))
    return rows.select("case_id", "hearing_key", status.alias("status"), start.alias("start_date"))


def split_audit(rows: DataFrame, notes: str, audit: str) -> DataFrame:
    """Paragraphs that begin with an audit mark move from notes to the audit column."""
    parts = F.split(F.coalesce(notes, F.lit("")), "\n\n")
    marked = lambda p: p.rlike(r"^\[(verify-pass|dedupe)\]")
    kept = F.array_join(F.filter(parts, lambda p: ~marked(p)), "\n\n")
    moved = F.filter(parts, marked)
    both = F.filter(F.concat(F.array(F.coalesce(audit, F.lit(""))), moved), lambda p: p != "")
    return rows.withColumn(audit, F.nullif(F.array_join(both, "\n\n"), F.lit(""))).withColumn(notes, F.nullif(kept, F.lit("")))


def rekeyed(summaries: DataFrame, dockets: DataFrame) -> DataFrame:
    """Summaries by docket to summaries by logical docket, the newest wins; rows without metadata are left out."""
    rows = summaries.join(dockets.select("docket_id", "docket_number", "court_id"), "docket_id")
    return rows.groupBy("docket_number", "court_id").agg(F.max_by("docket_id", F.struct("generated_at", "docket_id")).alias("docket_id"))


def prune_preview(dockets: DataFrame, gone: DataFrame, summaries: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows each table would lose; a summary goes only with the last docket of its group."""
    ids = gone.select("docket_id")
    live = dockets.join(ids, "docket_id", "left_anti").select("docket_number", "court_id").distinct()
    parts = [t.join(ids, "docket_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    lost = summaries.join(live, ["docket_number", "court_id"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("summaries").alias("table_name"), "n")
    for p in parts:
        lost = lost.unionByName(p)
    return lost


def deadline_verdicts(deadlines: DataFrame, verdicts: DataFrame, today: str) -> DataFrame:
    """Future pending deadlines after their verdicts (one a key): cancelled, met, or moved to a date; other rows and verdicts change nothing."""
    open_ = (F.col("status") == "pending") & (F.col("due_date") > F.lit(today).cast("date"))
    both = deadlines.join(verdicts.select("case_id", "deadline_key", "verdict", F.col("local_date").alias("to_date")), ["case_id", "deadline_key"], "left")
    said = F.when(open_, F.col("verdict"))
    moved = (said == "RESCHEDULE_DEADLINE") & F.col("to_date").isNotNull()
    status = F.when(said.isin("CANCEL_DEADLINE", "DELETE_HALLUCINATION"), "cancelled").when(said == "MARK_FILED", "met").otherwise(F.col("status"))
    return both.select("case_id", "deadline_key", status.alias("status"), F.when(moved, F.col("to_date")).otherwise(F.col("due_date")).alias("due_date"))


def merge_verdicts(clusters: DataFrame, verdicts: DataFrame, exact_slot: bool = True) -> DataFrame:
    """(cluster, key, target): rows that a MERGE_INTO verdict folds into another of their cluster.

    The target must be a key of the cluster.  At one exact slot the cluster's
    canonical key takes its place; across dates the verdict's choice stands.
    """
    said = verdicts.where("verdict = 'MERGE_INTO'").select("cluster", F.col("target_key").alias("key")).join(clusters.select("cluster", "key"), ["cluster", "key"]).withColumnRenamed("key", "target")
    if exact_slot:
        best = canonical_keys(clusters.groupBy("cluster").agg(F.collect_set("key").alias("keys"))).select("cluster", "canonical")
        said = said.join(best, "cluster").select("cluster", F.coalesce("canonical", "target").alias("target"))
    return clusters.join(said, "cluster").where("key <> target").select("cluster", "key", "target")


def active_cases(dockets: DataFrame, advanced: DataFrame, forced: DataFrame) -> DataFrame:
    """Cases whose sweeps run: a docket advanced, or the case is forced."""
    moved = dockets.join(advanced.select("docket_id"), "docket_id", "left_semi").select("case_id")
    return moved.unionByName(forced.select("case_id")).distinct()


def refilled(placeholders: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the feed for placeholders (with the fingerprint they had) whose fingerprint is another now."""
    old = placeholders.select(*keys, F.col("fingerprint").alias("old"))
    return feed.join(old, keys).where("NOT (fingerprint <=> old)").drop("old")
