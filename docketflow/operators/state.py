"""Stored state: what makes it stale, what clears it, replays, and repairs of keys and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions import render
from docketflow.functions import text as T
from docketflow.operators import folds
from docketflow.operators.tables import written

GROUP = ["docket_number", "court_id"]


def landed(entries: DataFrame, dockets: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries that a charge or ruling made stale after they were written, and since when."""
    c = F.col("description")
    marks = entries.where(T.is_primary(c) | T.is_disposition(c)).join(dockets.select("docket_id", *GROUP), "docket_id")
    since = marks.groupBy(*GROUP).agg(F.max("date_filed").alias("stale_since"))
    return summaries.join(since, GROUP).where("stale_since > generated_at").select(*GROUP, "stale_since")


def summaries_after(old: DataFrame, written: DataFrame) -> DataFrame:
    """Summaries with those just written in place of the old ones; a new one is not stale."""
    kept = old.join(written.select(*GROUP), GROUP, "left_anti").select(*GROUP, "stale", "generated_at")
    return kept.unionByName(written.select(*GROUP, F.lit(False).alias("stale"), "generated_at"))


def missing_summaries(dockets: DataFrame, summaries: DataFrame, force: bool = False) -> DataFrame:
    """Logical dockets without a summary, stale ones not counted; all of them when forced."""
    groups = dockets.select(*GROUP).distinct()
    return groups if force else groups.join(summaries.select(*GROUP), GROUP, "left_anti")


def latest(rows: DataFrame, key: str, seq: Column, columns: list[str]) -> DataFrame:
    """The last row of each key in order ``seq``: a dimension replaced row by row."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("r")).select(key, "r.*")


def cleared(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Derived rows without those of the chosen cases, before a replay."""
    return rows.join(cases.select("case_id"), "case_id", "left_anti")


def replayed(rows: DataFrame, actions: DataFrame, cases: DataFrame) -> DataFrame:
    """Hearing rows with those of the chosen cases folded anew from their whole history."""
    wanted = [c for c in rows.columns if c in folds.HEARING]
    fresh = folds.fold_hearings(actions.join(cases.select("case_id"), "case_id", "left_semi"), wanted)
    return cleared(rows, cases).unionByName(fresh.select(*rows.columns))


def pruned(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a table without those of removed dockets."""
    return rows.join(gone.select("docket_id"), "docket_id", "left_anti")


def forced(seen: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored fingerprints without those of entries that must be read again."""
    return seen.join(ids.select("entry_id"), "entry_id", "left_anti")


def push_ids(stored: DataFrame, done: DataFrame) -> DataFrame:
    """(case_id, event_key, push_id) after a push: inserts set an id, cancellations clear it, others keep theirs."""
    rows = stored.join(done.select("case_id", "event_key", "op", F.col("push_id").alias("new_id")), ["case_id", "event_key"], "full")
    kept = F.when(F.col("op") == "cancel", None).otherwise(F.coalesce("new_id", "push_id"))
    return rows.select("case_id", "event_key", kept.alias("push_id"))


def affected_calendars(changed: DataFrame, cases: DataFrame) -> DataFrame:
    """Calendars with changed rows: only these are written again."""
    return cases.join(changed.select("case_id").distinct(), "case_id", "left_semi").select("calendar").distinct()


def quarantined(rows: DataFrame, value: Column, schema: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that parse and have what is needed (with ``e``), and the others as they came: one bad entry fails no delivery."""
    parsed = rows.withColumn("e", F.from_json(value, schema))
    good = F.lit(True)
    for c in needed:
        good = good & F.col("e")[c].isNotNull()
    ok = F.coalesce(good, F.lit(False))
    return parsed.where(ok), parsed.where(~ok).drop("e")


def better_notes(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(case_id, hearing_key, new_notes) of rows whose notes are blank or a mere notice.

    The record must be one of the row's own sources, on any docket, restate its
    date and name a proceeding of its kind; accounts come before transcripts,
    longer ones before shorter, then the smallest entry id.
    """
    key = ["case_id", "hearing_key"]
    notes = F.col("notes")
    idle = T.blank_to_null(F.coalesce(notes, F.lit(""))).isNull() | T.is_admin_notice(notes)
    wanted = rows.where(idle & ~T.records_proceeding(notes)).select(
        *key, render.date_tokens(F.col("start_date")).alias("tokens"), T.proceeding_types(F.concat_ws(" ", "hearing_key", "title")).alias("kinds"), F.explode("source_entry_ids").alias("entry_id")
    )
    text = render.record_text(F.col("description"), F.col("short_description"))
    records = entries.where(T.records_proceeding(F.concat_ws(" | ", "description", "short_description"))).select("entry_id", text.alias("text")).where("text IS NOT NULL")
    records = records.withColumn("named", T.proceeding_types(T.record_name(F.col("text"))))
    found = wanted.hint("merge").join(records.hint("merge"), "entry_id")
    dated = (F.size("tokens") == 0) | F.col("tokens").isNull() | F.exists("tokens", lambda t: F.contains(F.col("text"), t))
    typed = (F.size("kinds") == 0) | F.arrays_overlap("kinds", "named")
    best = F.min_by("text", F.struct(T.record_rank(F.col("text")), -F.length("text"), F.col("entry_id")))
    return found.where(dated & typed).groupBy(*key).agg(best.alias("new_notes"))


def drifted_keys(rows: DataFrame, dockets: DataFrame, key: str, start: str) -> DataFrame:
    """(case_id, key, action, new_key) of rows whose key has a -<digits> suffix that is provably drift.

    Renamed where the row's audit notes say that its base was absorbed and no
    base row is left; folded into a base row at the same start in the same
    logical docket; anything else is left alone.  Serves hearings and deadlines.
    """
    home = dockets.select("docket_id", *GROUP)
    rows = rows.join(home, "docket_id", "left")
    base = T.base_key(F.col(key))
    drifted = rows.where(F.col(key) != base).withColumn("base", base)
    there = rows.select("case_id", F.col(key).alias("base"), F.col(start).alias("b_start"), F.col("docket_id").alias("b_docket"), F.col("docket_number").alias("b_number"), F.col("court_id").alias("b_court"), F.lit(True).alias("there"))
    both = drifted.join(there, ["case_id", "base"], "left")
    same = (F.col(start) == F.col("b_start")) & (F.col("docket_id").eqNullSafe(F.col("b_docket")) | ((F.col("docket_number") == F.col("b_number")) & F.col("court_id").eqNullSafe(F.col("b_court"))))
    absorbed = F.array_contains(T.absorbed_keys(F.col("audit_notes")), F.col("base"))
    action = F.when(F.col("there").isNull() & absorbed, "rename").when(F.col("there") & F.coalesce(same, F.lit(False)), "delete")
    return both.withColumn("action", action).where("action IS NOT NULL").select("case_id", key, "action", F.col("base").alias("new_key"))


def healed_keys(rows: DataFrame, dockets: DataFrame, key: str, start: str, new_title) -> DataFrame:
    """``rows`` with drifted keys repaired, as ``drifted_keys`` says.

    A renamed row takes its base as key and, if its title only spelt the old one,
    the title ``new_title(key, case_id)`` gives; its push id is dropped, as the event's id follows the key.  Of
    several rows that claim one base the first key is renamed, the others stay.  A row that is folded goes: its base row adds
    its sources, takes its record or explicit title where it has none itself, and notes its key; several are folded in order of their keys.

    ``rows``: case_id, key, docket_id, start, source_entry_ids, notes, title, ``derived``, audit_notes, push_id and any others.  Serves hearings and deadlines.
    """
    plan = written(drifted_keys(rows, dockets, key, start), "drift")
    renames = plan.where("action = 'rename'").groupBy("case_id", "new_key").agg(F.min(key).alias(key))
    folds_in = plan.where("action = 'delete'").select("case_id", key, "new_key")
    taken = F.struct(F.col(key).alias("key"), "source_entry_ids", "notes", "title", "derived")
    joined = rows.join(folds_in.hint("merge"), ["case_id", key]).groupBy("case_id", F.col("new_key").alias(key)).agg(F.array_sort(F.collect_list(taken)).alias("others"))
    left = rows.join(folds_in.select("case_id", key).hint("merge"), ["case_id", key], "left_anti").join(joined.hint("merge"), ["case_id", key], "left").join(renames.hint("merge"), ["case_id", key], "left")
    others = F.coalesce("others", F.array().cast(joined.schema["others"].dataType))
    record = F.get(F.filter(others, lambda x: T.records_proceeding(x["notes"])), F.lit(0))["notes"]
    titled = F.get(F.filter(others, lambda x: ~x["derived"]), F.lit(0))["title"]
    slot = F.concat(F.lit(" at same UTC slot "), F.coalesce(F.col(start).cast("string"), F.lit("None")))
    line = lambda old, x: T.audit_line(old, "heal-drift", F.concat(F.lit("Absorbed drift sibling key "), x["key"], slot))
    renamed = F.col("new_key").isNotNull()
    new = {
        key: F.coalesce("new_key", key), "source_entry_ids": F.array_distinct(F.concat("source_entry_ids", F.flatten(F.transform(others, lambda x: x["source_entry_ids"])))),
        "notes": F.when(T.records_proceeding(F.col("notes")), F.col("notes")).otherwise(F.coalesce(record, F.col("notes"))),
        "title": F.when(renamed & F.col("derived"), new_title(F.col("new_key"), F.col("case_id"))).when(F.col("derived"), F.coalesce(titled, F.col("title"))).otherwise(F.col("title")),
        "audit_notes": F.aggregate(others, F.col("audit_notes"), line), "push_id": F.when(~renamed, F.col("push_id")),
    }
    return left.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def usage(payload: Column, shape: Column) -> Column:
    """(input, output, cached, cache_write) of a provider's answer, by the shape of its usage object; what is no number is 0."""
    number = lambda path: F.coalesce(F.get_json_object(payload, path).try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    row = lambda i, o, c, w: F.struct(i.alias("input"), o.alias("output"), c.alias("cached"), w.alias("cache_write"))
    read, wrote = number("$.usage.cache_read_input_tokens"), number("$.usage.cache_creation_input_tokens")
    return (
        F.when(shape == "messages", row(number("$.usage.input_tokens") + read + wrote, number("$.usage.output_tokens"), read, wrote))
        .when(shape == "completions", row(number("$.usage.prompt_tokens"), number("$.usage.completion_tokens"), number("$.usage.prompt_tokens_details.cached_tokens"), zero))
        .when(shape == "candidates", row(number("$.usage_metadata.prompt_token_count"), number("$.usage_metadata.candidates_token_count"), number("$.usage_metadata.cached_content_token_count"), zero))
        .otherwise(row(number("$.prompt_eval_count"), number("$.eval_count"), zero, zero))
    )
