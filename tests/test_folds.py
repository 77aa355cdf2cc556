"""Hand-written action sequences and the rows they fold to."""

import datetime as dt
import time

from pyspark.sql import functions as F

from docketflow.operators.folds import HEARINGS, fold_deadlines, fold_hearings, repaired_type

D = dt.date
SCHEMA = "case_id string, hearing_key string, seq int, entry_id long, type string, local_date date, local_hour int, significance string, docket_id long"


def folded(spark, *steps):
    rows = [("c", s[0], i, s[1], s[2], s[3], s[4] if len(s) > 4 else None, s[5] if len(s) > 5 else None, 7) for i, s in enumerate(steps)]
    out = fold_hearings(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r["hearing_key"]: r for r in out}


def test_reschedule_then_held(spark):
    r = folded(spark, ("h", 1, "ADD_HEARING", D(2024, 1, 5), 10), ("h", 2, "RESCHEDULE_HEARING", D(2024, 2, 1), 11), ("h", 2, "MARK_HELD", D(2024, 2, 2)))["h"]
    assert (r.status, r.local_date, r.local_hour, r.source_entry_ids) == ("held", D(2024, 2, 1), 11, [1, 2])


def test_held_three_days_off_is_rejected(spark):
    r = folded(spark, ("h", 1, "ADD_HEARING", D(2024, 1, 5)), ("h", 2, "MARK_HELD", D(2024, 1, 8)))["h"]
    assert (r.status, r.source_entry_ids) == ("scheduled", [1])


def test_cancel_of_unknown_key(spark):
    assert folded(spark, ("h", 1, "CANCEL_HEARING", None)) == {}
    r = folded(spark, ("h", 1, "CANCEL_HEARING", D(2024, 1, 5)))["h"]
    assert (r.status, r.significance) == ("cancelled", "major")


def test_add_without_date_and_ignore_are_dropped(spark):
    assert folded(spark, ("h", 1, "ADD_HEARING", None), ("h", 1, "IGNORE", D(2024, 1, 1))) == {}


def test_update_revives_and_keeps(spark):
    r = folded(spark, ("h", 1, "ADD_HEARING", D(2024, 1, 5), 9, "minor"), ("h", 2, "CANCEL_HEARING", None), ("h", 3, "UPDATE_DETAILS", None))["h"]
    assert (r.status, r.local_date, r.local_hour, r.significance, r.docket_id) == ("scheduled", D(2024, 1, 5), 9, "minor", 7)


def test_partitioning_does_not_matter(spark):
    rows = [("c", f"h{i % 3}", i, i, ["ADD_HEARING", "CANCEL_HEARING", "UPDATE_DETAILS"][i % 3], D(2024, 1, 1 + i % 5), None, None, i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, fold_hearings(df.repartition(7)).collect())) == sorted(map(str, fold_hearings(df.coalesce(1)).collect()))


def test_deadlines(spark):
    rows = [
        ("c", "d1", 0, 1, "ADD_DEADLINE", D(2024, 1, 1), False), ("c", "d1", 1, 2, "MARK_FILED", None, False),
        ("c", "d2", 0, 1, "MARK_FILED", D(2024, 1, 1), False), ("c", "d3", 0, 1, "ADD_DEADLINE", None, True),
        ("c", "d4", 0, 1, "ADD_DEADLINE", None, False), ("c", "d5", 0, 1, "CANCEL_DEADLINE", D(2024, 3, 1), False),
    ]
    out = fold_deadlines(spark.createDataFrame(rows, "case_id string, deadline_key string, seq int, entry_id long, type string, local_date date, conditional boolean"))
    assert {r.deadline_key: (r.status, r.due_date) for r in out.collect()} == {"d1": ("met", D(2024, 1, 1)), "d3": ("pending", None), "d5": ("cancelled", D(2024, 3, 1))}


def test_type_follows_the_key(spark):
    df = spark.createDataFrame([("d-1", "ADD_HEARING"), ("h-1", "MARK_FILED"), ("x", "IGNORE")], "k string, t string")
    assert [r[0] for r in df.select(repaired_type(df.t, df.k)).collect()] == ["ADD_DEADLINE", "MARK_HELD", "IGNORE"]


def test_blank_delivery_keys_always_pass(spark):
    """Of deliveries with one key the first counts, by time and then by content; those of the ledger are out, blank keys in."""
    from docketflow.streaming.alerts import undelivered

    entry = lambda i: [(i, "7", None, None, None, None, None)]
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at + dt.timedelta(1), (1,), (entry(1),)), ("a", at, (1,), (entry(3),)), ("a", at, (1,), (entry(2),)), ("b", at, (1,), (entry(4),)), (" ", at, (1,), (entry(5),)), (None, at, (1,), (entry(6),)), (" ", at, (1,), (entry(5),))]
    from docketflow.streaming.alerts import DELIVERY

    out = undelivered(spark.createDataFrame(rows, DELIVERY).repartition(5), spark.createDataFrame([("b",), ("z",)], "idempotency_key string"))
    assert sorted(r.payload.results[0].id for r in out.collect()) == [2, 5, 5, 6]



def test_no_action_of_another_court_touches_a_row(spark):
    rows = [("c", "h", 0, 1, "ADD_HEARING", D(2024, 1, 5), 9, "mad", 1), ("c", "h", 1, 2, "CANCEL_HEARING", None, None, "cand", 2), ("c", "h", 2, 3, "UPDATE_DETAILS", None, None, None, 3)]
    schema = "case_id string, hearing_key string, seq int, entry_id long, type string, local_date date, local_hour int, court_id string, docket_id long"
    r = fold_hearings(spark.createDataFrame(rows, schema)).first()
    assert (r.status, r.source_entry_ids, r.docket_id, r.court_id) == ("scheduled", [1, 3], 1, "mad")


def test_a_record_supersedes_a_notice(spark):
    rows = [("c", "h", 0, 1, "ADD_HEARING", D(2024, 1, 5), "notice of zoom access", None, False), ("c", "h", 1, 2, "MARK_HELD", D(2024, 1, 6), None, "minute entry: held", True), ("c", "h", 2, 3, "MARK_HELD", D(2024, 1, 6), "later words", "minute entry: again", True)]
    schema = "case_id string, hearing_key string, seq int, entry_id long, type string, local_date date, notes string, record_text string, is_record boolean"
    r = fold_hearings(spark.createDataFrame(rows, schema)).first()
    assert (r.status, r.notes, r.duration_minutes) == ("held", "minute entry: held", 0)


def test_pretrial_alone_is_no_trial(spark):
    from docketflow.functions.text import proceeding_types, record_name

    df = spark.createDataFrame([("pre-trial-conf",), ("pretrial and jury trial",), ("Minutes of Status Conference held before X: Sentencing set",)], "t string")
    kinds = [r[0] for r in df.select(proceeding_types(df.t)).collect()]
    assert kinds[:2] == [["pretrial"], ["pretrial", "trial"]]
    assert df.select(record_name(df.t)).collect()[2][0] == "Status Conference"


def test_proceedings_held_once(spark):
    from docketflow.functions.text import once_only
    from docketflow.operators import sweeps

    keys = ["sentencing-wang", " Sentencing-Wang-2", "plea", "plea--x-3", "plea-2", "change-of-plea-y", "sentencings-a", "status-conference-2", "", None]
    out = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(once_only(F.col("k"))).collect()]
    assert out == ["sentencing|wang", "sentencing|wang", "plea|(unnamed)", "plea|x", "plea|2", "change-of-plea|y", None, None, None, None]
    rows = [("c", k, d, hour, status, docket) for k, d, hour, status, docket in (
        ("plea-a", D(2024, 1, 5), 9, "held", 1), ("plea-a-2", D(2024, 1, 6), 9, "held", 1), ("plea-a-3", D(2024, 1, 6), 10, "held", 2), ("plea-a-4", D(2024, 1, 7), 9, "scheduled", 1),
        ("plea-a-5", D(2024, 1, 8), 9, "held", 2), ("plea-a-6", D(2024, 1, 9), 9, "held", 3), ("plea-a-7", D(2024, 1, 9), 10, "held", 4), ("plea-a-8", D(2024, 1, 9), 10, "held", None),
    )] + [("d", "plea-a", D(2024, 1, 5), 9, "held", 1)]
    h = spark.createDataFrame(rows, "case_id string, hearing_key string, start_date date, start_hour int, status string, docket_id long")
    d = spark.createDataFrame([(1, "n", "mad"), (2, "n", "mad"), (3, "n", "cand"), (4, "n", None)], "docket_id long, docket_number string, court_id string")
    near = sweeps.near_slot(h, d, "held")
    assert [r["keys"] for r in near.collect()] == [["plea-a-2", "plea-a-3"]]  # one day, two courts: no cluster
    assert [(r.case_id, r["keys"]) for r in sweeps.once_only_clusters(h, d, near).collect()] == [("c", ["plea-a", "plea-a-5"])]


def test_lineage_of_a_key_with_many_actions(spark):
    """Each entry once, where it came first, over many parts of the list; a list that all steps copied and searched took minutes."""
    n, kind = 60_000, F.expr("CASE id % 4 WHEN 0 THEN 'ADD_HEARING' WHEN 1 THEN 'UPDATE_DETAILS' WHEN 2 THEN 'CANCEL_HEARING' ELSE 'IGNORE' END")
    rows = spark.range(n).select(F.lit("c").alias("case_id"), F.lit("h").alias("hearing_key"), F.col("id").alias("seq"), (F.col("id") * 7 % 40_009).alias("entry_id"), kind.alias("type"), F.lit(D(2024, 1, 5)).alias("local_date"))
    began = time.monotonic()
    r = fold_hearings(rows, ["source_entry_ids", "status"]).first()
    took = time.monotonic() - began
    assert list(r.source_entry_ids) == list(dict.fromkeys(i * 7 % 40_009 for i in range(n) if i % 4 < 3))
    assert r.status == "cancelled" and took < 20
    # A state that is there is taken up.
    few = HEARINGS.steps(HEARINGS.actions(rows.where("seq < 900")))
    start = F.struct(*[F.expr("array(999999L, 7L)").alias(c) if c == "source_entry_ids" else F.lit(1 if c == "n" else None).cast(k).alias(c) for c, k in HEARINGS.state.items()])
    ids = list(few.select(HEARINGS.advanced(start)["source_entry_ids"]).first()[0])
    assert ids == list(dict.fromkeys([999999, 7, *(i * 7 for i in range(900) if i % 4 < 3)]))
