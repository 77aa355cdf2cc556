"""Merges of rows: who survives, what it takes over, and that the audit line can be read back."""

import pytest

from docketflow.functions import text as T
from docketflow.operators import state, sweeps
from pyspark.sql import functions as F

SCHEMA = "case_id string, docket_id long, key string, source_entry_ids array<long>, notes string, title string, derived boolean, audit_notes string, last_updated string, extra int"


def row(key, sources, notes=None, title="T", derived=False, audit=None, since="2024-01-01", case="c", docket=1):
    return (case, docket, key, sources, notes, title, derived, audit, since, 7)


def held(spark, *rows):
    return sweeps.merged_clusters(spark.createDataFrame(list(rows), SCHEMA), ["case_id"], "key", "dedupe-held", F.lit(" at same UTC slot s")).first()


def test_survivor(spark):
    r = held(spark, row("status-conf-2", [1, 2, 3]), row("motion-hearing", [4]))
    assert (r.survivor, r.source_entry_ids, list(r.absorbed)) == ("status-conf-2", [1, 2, 3, 4], ["motion-hearing"])  # a number alone is no drift
    r = held(spark, row("a-2", [1, 2, 3]), row("a", [4]), row("b", [2, 5, 6], since="2023"))
    assert (r.survivor, r.source_entry_ids, list(r.absorbed)) == ("a", [4, 2, 5, 6, 1, 3], ["b", "a-2"])
    assert held(spark, row("a-2-3", [1]), row("a-2", [1]), row("a", [1])).survivor == "a"
    r = held(spark, row("only", [1], notes="n", audit="x"))
    assert (r.survivor, r.notes, r.audit_notes, list(r.absorbed)) == ("only", "n", "x", [])


def test_notes_and_titles(spark):
    r = held(spark, row("a", [1, 2], "a long notice about Zoom access for all of the public"), row("b", [1], "minute entry: held"), row("c", [1], "Transcript of proceedings held on that very day, at length"))
    assert (r.survivor, r.notes) == ("a", "minute entry: held")
    assert held(spark, row("a", [1, 2], "short minute entry"), row("b", [1], "a much longer minute entry")).notes == "short minute entry"
    assert held(spark, row("a", [1, 2], "own"), row("b", [1], "a longer notice of nothing")).notes == "own"
    assert held(spark, row("a", [1, 2], None), row("b", [1], None)).notes is None
    assert held(spark, row("a", [1, 2], title="A", derived=True), row("b", [1], title="Bee"), row("c", [1], title="Motion for all"), row("d", [1], title="A derived one, longest", derived=True)).title == "Motion for all"
    assert held(spark, row("a", [1, 2], title="A"), row("b", [1], title="Longer")).title == "A"


def test_audit_line_is_read_back(spark):
    """What a merge writes tells ``drifted_keys`` that the base was absorbed."""
    r = held(spark, row("status", [1]), row("status-2", [1, 2], audit="[verify-pass] seen"), row("z", [1]))
    assert r.audit_notes == "[dedupe-held] Absorbed sibling key(s) status-2, z at same UTC slot s"
    r = sweeps.merged_rows(spark.createDataFrame([row("status", [1]), row("status-2", [1, 2], audit="old")], SCHEMA), spark.createDataFrame([("c", "status", "status-2")], "case_id string, key string, target string"), "key", "dedupe-nearslot")
    kept = r.withColumnRenamed("key", "hearing_key").withColumn("start", F.lit(1))
    assert [tuple(x) for x in r.select("key", "audit_notes", "extra").collect()] == [("status-2", "old\n\n[dedupe-nearslot] Absorbed sibling key(s) status: Duplicate of status-2", 7)]
    assert r.select(T.absorbed_keys(F.col("audit_notes"))).first()[0] == ["status"]
    dockets = spark.createDataFrame([(1, "n", "mad")], "docket_id long, docket_number string, court_id string")
    assert [tuple(x) for x in state.drifted_keys(kept, dockets, "hearing_key", "start").collect()] == [("c", "status-2", "rename", "status")]


@pytest.mark.parametrize(
    "links, want",
    [
        ([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")], {x: "f" for x in "abcde"}),
        ([("a", "b"), ("b", "a")], {"b": "a"}),
        ([("b", "c"), ("c", "d"), ("d", "b"), ("a", "b"), ("e", "a")], {"c": "b", "d": "b", "a": "b", "e": "b"}),
        ([("a", "b"), ("a", "c"), ("x", "x")], {"a": "b"}),
        ([], {}),
    ],
)
def test_targets(spark, links, want):
    plan = spark.createDataFrame([("c", *x) for x in links], "case_id string, key string, target string")
    assert {r.key: r.target for r in sweeps.resolved_targets(plan).collect()} == want


def test_targets_without_a_row_leave_their_keys_alone(spark):
    rows = spark.createDataFrame([row("a", [1]), row("b", [2]), row("a", [3], case="d")], SCHEMA)
    plan = spark.createDataFrame([("c", "a", "gone"), ("d", "a", "b")], "case_id string, key string, target string")
    assert sorted(map(str, sweeps.merged_rows(rows, plan, "key", "dedupe").select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    reasons = spark.createDataFrame([("c", "a", "same call")], "case_id string, target string, reason string")
    out = sweeps.merged_rows(rows, spark.createDataFrame([("c", "b", "a")], "case_id string, key string, target string"), "key", "dedupe", reasons)
    assert out.where("case_id = 'c'").first().audit_notes == "[dedupe] Absorbed sibling key(s) b: same call" and out.count() == 2


def test_sealing(spark):
    from docketflow.operators.audit import sealing

    texts = {
        1: ["ORDER granting 5 Motion to Seal", "nothing"], 2: ["ORDER granting 5 Motion to Seal", "ORDER granting Motion to Unseal"], 3: ["ORDER denying Motion to Seal"], 4: ["order (sealed) is granted leave to seal " + "x " * 200],
        5: ["ORDER granting Motion. Clerk to seal"], 6: ["ORDER granting 5 Motion to Seal"] + ["public"] * 4, 7: ["ORDER granting 5 Motion to Seal"], 8: [None],
    }
    rows = [(d, 100 * d + i, i, f"2024-01-{i + 1:02d}", t, True) for d, ts in texts.items() for i, t in enumerate(ts)]
    e = spark.createDataFrame(rows, "docket_id long, entry_id long, entry_number long, date_filed string, description string, is_available boolean")
    out = {r.docket_id: r for r in sealing(e, spark.createDataFrame([(7,)], "docket_id long")).collect()}
    assert sorted(out) == [1, 4] and out[1].later == 1 and (len(out[4].seal_text), out[4].seal_text[-3:]) == (240, "...")
