"""Jobs over several tables, searches and plans on small tables with odd rows."""

import datetime as dt
import time
import uuid

import pytest
from pyspark.sql import functions as F

from docketflow.operators import feed, folds, infer, jobs, searching


@pytest.fixture(scope="module")
def folder(spark):
    return spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_a_version_counts_once_all_tables_are_there(spark, folder):
    store = f"{folder}/{uuid.uuid4().hex}"
    assert jobs.newest(spark, store) == 0
    assert jobs.publish(store, {"a": spark.range(3), "b": spark.range(1)}) == 1
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        jobs.publish(store, {"a": spark.range(9), "b": bad})
    assert jobs.newest(spark, store) == 1 and jobs.published(spark, store, "a").count() == 3
    assert jobs.publish(store, {"a": spark.range(5), "b": spark.range(1)}) == 2 and jobs.published(spark, store, "a").count() == 5


def test_summaries_go_with_the_last_docket(spark):
    dockets = spark.createDataFrame([(1, "n", "c"), (2, "n", "c"), (3, "m", "c"), (4, None, "c"), (5, "o", "c")], "docket_id long, docket_number string, court_id string")
    summaries = spark.createDataFrame([("n", "c"), ("m", "c"), ("never", "c"), ("o", "c")], "docket_number string, court_id string")
    rows = spark.createDataFrame([(1, "a"), (3, "b"), (9, "orphan"), (None, "none")], "docket_id long, k string")
    gone = spark.createDataFrame([(1,), (3,), (4,), (4,), (77,)], "docket_id long")
    out = jobs.cascaded({"rows": rows}, dockets, summaries, gone)
    assert sorted(r.docket_number for r in out["summaries"].collect()) == ["n", "never", "o"]
    assert sorted(r.docket_id for r in out["dockets"].collect()) == [2, 5] and sorted(r.k for r in out["rows"].collect()) == ["none", "orphan"]
    again = jobs.cascaded({"rows": out["rows"]}, out["dockets"], out["summaries"], spark.createDataFrame([(2,)], "docket_id long"))
    assert sorted(r.docket_number for r in again["summaries"].collect()) == ["never", "o"]


def test_a_refold_touches_its_keys_alone(spark):
    rows = [("c", f"h-{i % 5}", i, i, ("ADD_HEARING", "MARK_HELD", "CANCEL_HEARING")[i % 3], dt.date(2024, 1, 1 + i % 3)) for i in range(40)]
    history = spark.createDataFrame(rows, "case_id string, hearing_key string, seq int, entry_id long, type string, local_date date")
    stored = folds.fold_hearings(history).withColumn("notes", F.lit("stored"))  # tells what is folded anew
    back = spark.createDataFrame([(3,), (8,), (999,)], "entry_id long")
    added = history.where("entry_id = 3").withColumn("type", F.lit("ADD_HEARING"))
    out = {r.hearing_key: r for r in jobs.refolded(folds.HEARINGS, stored, history, back, added).collect()}
    full = {r.hearing_key: r for r in folds.fold_hearings(history.where("entry_id NOT IN (3, 8)").unionByName(added)).collect()}
    assert {k for k, r in out.items() if r.notes is None} == {"h-3"}  # entries 3 and 8 are of one key
    assert {k: (r.status, r.local_date, list(r.source_entry_ids)) for k, r in out.items()} == {k: (r.status, r.local_date, list(r.source_entry_ids)) for k, r in full.items()}
    only = history.where("hearing_key = 'h-1'")
    assert jobs.refolded(folds.HEARINGS, folds.fold_hearings(only), only, only.select("entry_id")).count() == 0
    assert jobs.refolded(folds.HEARINGS, stored, history, back.limit(0)).count() == stored.count()


def test_verdicts(spark):
    schema = "case_id string, hearing_key string, status string, local_date date, local_hour int, timezone string, source_entry_ids array<long>, audit_notes string"
    rows = spark.createDataFrame([("c", k, "scheduled", dt.date(2024, 1, 1), 9, None, [1, 2], None) for k in "abcdef"], schema)
    said = [("a", "DELETE_HALLUCINATION", None, [1]), ("b", "DELETE_HALLUCINATION", "none", [2, 1, 3]), ("c", "MARK_HELD", "seen", None), ("d", "reinstate", None, None), ("e", "WHATEVER", "x", None)]
    verdicts = spark.createDataFrame([("c", k, v, r, None, None, s) for k, v, r, s in said], "case_id string, hearing_key string, verdict string, reason string, new_date date, new_hour int, shown_ids array<long>")
    out = {r.hearing_key: (r.status, r.audit_notes) for r in jobs.verified(rows, verdicts).collect()}
    assert out == {"a": ("scheduled", None), "b": ("cancelled", "[verify-pass] none"), "c": ("held", None), "d": ("scheduled", "[verify-pass] Cancellation not supported by docket; reinstated to scheduled"), "e": ("scheduled", None), "f": ("scheduled", None)}


def test_push_recovery(spark):
    w = spark.createDataFrame(
        [("c", "a", "T", "d", "scheduled", "p1"), ("c", "b", "T", "d", "scheduled", "p1"), ("c", "x", "T", "d", "cancelled", None), ("c", "y", "T", "d", "cancelled", "gone"), ("c", "z", "T", "d", "scheduled", None)],
        "case_id string, event_key string, title string, start_date string, status string, push_id string",
    )
    ids = {r.event_key: r.id for r in w.select("event_key", F.expr("concat('cc', sha1(concat(case_id, '::', event_key)))").alias("id")).collect()}
    p = spark.createDataFrame([("p1", None, "T", "d"), ("p3", ids["x"], "T", "d"), ("p2", ids["x"], "T", "d"), ("p9", "other", "T", "d")], "push_id string, correlation string, title string, start_date string")
    out = {(r.id, r.push_id): r.op for r in feed.recovered_plan(w, p).collect()}
    first, second = sorted((ids["a"], ids["b"]))
    assert out == {(first, "p1"): "keep", (second, None): "insert", (ids["x"], "p2"): "cancel", (ids["x"], "p3"): "duplicate", ("other", "p9"): "orphan", (ids["z"], None): "insert"}
    assert feed.recovered_plan(w.limit(0), p.limit(0)).count() == 0


def test_budgets(spark):
    docs = spark.createDataFrame([(1, "primary", i, f"n{i}", "x" * n) for i, n in enumerate([50, 0, 200, 30, 9])] + [(1, "primary", 9, "null", None), (1, "other", 0, "o", "y")], "docket_id long, section string, place int, name string, text string")
    rows = infer.budgeted(docs.where("section = 'primary'"), ["docket_id"], ["place"], F.lit(100), F.lit(160)).orderBy("place").collect()
    assert [(len(r.shown), r.left_out) for r in rows] == [(50, 0), (0, 0), (100, 100), (10, 20), (0, 9), (0, 0)]
    dockets = spark.createDataFrame([(1, "n", "c"), (2, None, None)], "docket_id long, docket_number string, court string")
    none = spark.createDataFrame([], "docket_id long, line string")
    out = {r.docket_id: r.prompt for r in infer.summary_prompts(dockets, docs, none, none, "2024-01-01", {"primary": (100, 160)}).collect()}
    assert out[2].split("\n") == ["TODAY 2024-01-01", "DOCKET (none) in (none)", "EVENTS", "(none)", "DOCUMENTS", "(none)", "Write two to four sentences."]
    assert out[1].count("x") == 160 and "[D3] primary: n2" in out[1] and " [.. 20 characters left out]" in out[1] and "[D7]" not in out[1]


def test_search_equals_a_scan(spark, folder):
    texts = ["", None, "ab", "Hello World", "hello  world", "say hello to the world", "ÄÖÜ straße", "aaaaaa", "the_world%", "x" * 5000 + "needle"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", searching.haystack(F.array("t")).alias("hay"), F.lit(1).alias("gram"))
    path = f"{folder}/{uuid.uuid4().hex}"
    searching.write_index(rows, "k", "hay", path)
    index = spark.read.parquet(path)
    for terms in (["hello"], ["hello", "world"], ["o w"], ["lo", "wo"], ["aaaa"], ["äöü"], ["needle"], ["%"], ["nothing here"], ["HELLO", ""], []):
        want = sorted(i for i, t in enumerate(texts) if all(x.lower() in (t or "").lower() for x in terms))
        assert sorted(r.k for r in searching.found(rows, index, "k", "hay", terms).collect()) == want, terms
    said = spark.createDataFrame([("they were [charged](https://a.b/c) today [sic] (2024)",), (None,)], "s string").select(searching.plain_text(F.col("s"))).collect()
    assert [r[0] for r in said] == ["they were charged today [sic] (2024)", ""]


def test_the_index_is_made_in_one_pass_without_a_shuffle(spark, folder):
    """A text of half a million characters, two bytes each, and one trigram in all rows: looked up by number each, they took minutes."""
    rows = spark.createDataFrame([(0, "é" * 300_000 + "äöü" + "é" * 200_000), (1, "ab\n😀c"), (2, "aaa")] + [(i, "the") for i in range(3, 300)], "k long, t string").repartition(3)
    path = f"{folder}/{uuid.uuid4().hex}"
    began = time.monotonic()
    searching.write_index(rows, "k", "t", path)
    assert time.monotonic() - began < 60
    index = spark.read.parquet(path)
    assert sorted(r.gram for r in index.where("k = 0").collect()) == ["äöü", "éäö", "ééä", "ééé", "öüé", "üéé"]
    assert sorted(r.gram for r in index.where("k = 1").collect()) == ["\n😀c", "ab\n", "b\n😀"] and index.count() == 307
    assert len(index.inputFiles()) == 3 and max(r["count"] for r in index.where("gram = 'the'").groupBy(F.input_file_name()).count().collect()) < 200
    assert [r.k for r in searching.found(rows, index, "k", "t", ["éÄÖ"]).collect()] == [0]


def test_push_recovery_deals_out_rows_without_a_match(spark):
    """Inserts, and published rows without a correlation key, are many: no task gets all of them."""
    w = spark.range(4000).select(F.lit("c").alias("case_id"), F.col("id").cast("string").alias("event_key"), F.lit("T").alias("title"), F.lit("d").alias("start_date"), F.lit("scheduled").alias("status"), F.lit(None).cast("string").alias("push_id"))
    p = spark.range(4000).select(F.concat(F.lit("p"), "id").alias("push_id"), F.lit(None).cast("string").alias("correlation"), F.lit("T").alias("title"), F.lit("d").alias("start_date"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = feed.recovered_plan(w, p).select("op", F.spark_partition_id().alias("part")).groupBy("op", "part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for op in ("insert", "orphan"):
        sizes = [r["count"] for r in out if r.op == op]
        assert sum(sizes) == 4000 and max(sizes) < 2000


def test_prompts_take_known_rows_last(spark):
    """The known rows of a docket's group come to an entry last, by its docket, so they are shuffled for dockets alone."""
    from docketflow.operators import infer

    entries = spark.createDataFrame([(1, 7, 1, "d", "a"), (2, 8, 2, "d", "b"), (3, 9, 3, "d", None)], "entry_id int, docket_id int, entry_number int, date_filed string, text string")
    dockets = spark.createDataFrame([(7, "n", "c"), (8, "n", "c")], "docket_id int, docket_number string, court_id string")
    known = spark.createDataFrame([(8, "hearing", "k", "held", "t", "x")], "docket_id int, kind string, key string, status string, title string, at string")
    texts = spark.createDataFrame([(1, 1, "long text")], "entry_id int, place int, text string")
    related = spark.createDataFrame([(2, 1, "a")], "entry_id int, ref_number int, ref_text string")
    out = infer.extraction_prompts(entries, dockets, known, texts, related, 4, 9)
    row = "KNOWN ROWS\n- hearing k held t at x docket 7\nENTRY "
    assert {r.entry_id: r.prompt for r in out.collect()} == {
        1: row + "1 of docket 7 filed d\na\nATTACHED TEXTS\nlong", 2: row + "2 of docket 7 filed d\nb\nRELATED ENTRIES\n- [1] a", 3: "KNOWN ROWS\n(none)\nENTRY 3 of docket 9 filed d\n",
    }
    top = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert "docket_id" in top and "entry_id" not in top
