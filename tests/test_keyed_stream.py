"""The folds on a stream: shuffled, repeated and restarted deliveries leave what the batch folds leave."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from docketflow.operators import folds
from docketflow.plans.queries_events import as_deadline_steps, as_steps
from docketflow.sources.adapter import view
from docketflow.streaming.keyed import Due, KeyedStream

SF = "/root/testdata/sf0.001"
SEQ = "struct<entry_date:date,event_id:bigint>"
DUE = Due("unix_micros(to_timestamp(concat(cast(due_date AS string), ' 16:00:00')))")


@pytest.fixture(scope="module")
def folder(spark):
    return spark.sparkContext.getConf().get("spark.checkpoint.dir")


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


def cut(rows, parts, seed):
    """The rows dealt over deliveries at random."""
    return [rows.where(F.pmod(F.xxhash64("entry_id", F.lit(seed)), F.lit(parts)) == i) for i in range(parts)]


def test_shuffled_deliveries_equal_the_fold(spark, folder):
    actions = as_steps(view(spark, SF, "actions_v").where("event_id % 2 = 0")).withColumn("clock_us", F.lit(1))
    state = KeyedStream(spark, f"{folder}/{uuid.uuid4().hex}", folds.HEARINGS, SEQ, buckets=5)
    parts = cut(actions, 3, 1)
    for i, part in enumerate([*parts, parts[0]]):  # the first comes again under another number
        state.deliver(part, i, "clock_us")
    assert same(state.rows(), folds.fold_hearings(actions))


def test_a_failed_delivery_leaves_the_version_before(spark, folder):
    actions = as_steps(view(spark, SF, "actions_v").where("event_id % 5 = 0")).withColumn("clock_us", F.lit(1))
    state = KeyedStream(spark, f"{folder}/{uuid.uuid4().hex}", folds.HEARINGS, SEQ, buckets=3)
    first, second = cut(actions, 2, 2)
    state.deliver(first, 0, "clock_us")
    before = state.version()
    broken = KeyedStream(spark, state.folder, folds.HEARINGS, SEQ, buckets=3)
    object.__setattr__(broken, "_list", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.deliver(second, 1, "clock_us")
    assert state.version() == before and same(state.rows(), folds.fold_hearings(first))
    state.deliver(second, 1, "clock_us")
    state.deliver(second, 1, "clock_us")  # the stream may repeat a delivery whose version is there
    assert same(state.rows(), folds.fold_hearings(actions))


def test_only_touched_buckets_are_written(spark, folder):
    rows = [(f"c{i}", "d-1", i, i, "ADD_DEADLINE", "2024-03-01", 1) for i in range(40)]
    schema = "case_id string, deadline_key string, seq int, entry_id long, type string, day string, clock_us long"
    state = KeyedStream(spark, f"{folder}/{uuid.uuid4().hex}", folds.DEADLINES, "int", buckets=16)
    make = lambda r: spark.createDataFrame(r, schema).withColumn("local_date", F.col("day").cast("date"))
    state.deliver(make(rows), 0, "clock_us")
    state.deliver(make([("c1", "d-1", 99, 99, "MARK_FILED", None, 1)]), 1, "clock_us")
    known, _ = state.version()
    assert sorted(known.values()).count(1) == 1 and len(known) > 8
    assert {r.case_id: r.status for r in state.rows().collect()} == {f"c{i}": "met" if i == 1 else "pending" for i in range(40)}
    state.deliver(make([]), 2, "clock_us")
    assert state.version() == (known, 1)


def test_the_clock_flips_rows_of_other_cases(spark, folder):
    """A delivery for one case makes due deadlines of quiet cases pass; late filings and new dates are taken from the history."""
    day = 86_400_000_000
    at = lambda d: 19_783 * day + d * day  # noqa: E731  2024-03-01 and days after
    schema = "case_id string, deadline_key string, seq int, entry_id long, type string, day string, clock_us long"
    make = lambda *r: spark.createDataFrame(list(r), schema).withColumn("local_date", F.col("day").cast("date"))
    state = KeyedStream(spark, f"{folder}/{uuid.uuid4().hex}", folds.DEADLINES, "int", buckets=8, due=DUE)
    state.deliver(make(("quiet", "d-a", 1, 1, "ADD_DEADLINE", "2024-03-05", at(0)), ("busy", "d-b", 1, 2, "ADD_DEADLINE", "2024-04-01", at(0)), ("moved", "d-c", 1, 3, "ADD_DEADLINE", "2024-03-05", at(0))), 0, "clock_us")
    state.deliver(make(("moved", "d-c", 2, 4, "RESCHEDULE_DEADLINE", "2024-03-20", at(3))), 1, "clock_us")
    state.deliver(make(("busy", "d-b", 2, 5, "UPDATE_DETAILS", None, at(9))), 2, "clock_us")
    status = lambda: {r.case_id: r.status for r in state.rows().collect()}
    assert status() == {"quiet": "passed", "busy": "pending", "moved": "pending"}
    assert [tuple(r) for r in state.changes().where("batch = 2").collect()] == [("quiet", "d-a", "passed", "pending", "clock", 2)]
    state.deliver(make(("late", "d-d", 1, 6, "ADD_DEADLINE", "2024-03-02", at(9))), 3, "clock_us")
    assert status()["late"] == "passed"
    state.deliver(make(("quiet", "d-a", 2, 7, "MARK_FILED", None, at(10)), ("moved", "d-c", 0, 8, "ADD_DEADLINE", "2024-03-03", at(5))), 4, "clock_us")
    assert status() == {"quiet": "met", "busy": "pending", "moved": "pending", "late": "passed"}
    state.deliver(make(("x", "d-x", 1, 9, "MARK_FILED", None, at(60))), 5, "clock_us")
    assert status() == {"quiet": "met", "busy": "passed", "moved": "passed", "late": "passed"}


def test_deadlines_with_a_clock_equal_the_batch(spark, folder):
    actions = as_deadline_steps(view(spark, SF, "actions_v")).withColumn("clock_us", F.unix_micros(F.col("entry_date").cast("timestamp")))
    state = KeyedStream(spark, f"{folder}/{uuid.uuid4().hex}", folds.DEADLINES, SEQ, buckets=4, due=DUE)
    parts = cut(actions, 3, 3)
    random.Random(1).shuffle(parts)
    for i, part in enumerate(parts):
        state.deliver(part, i, "clock_us")
    now = actions.agg(F.max("clock_us")).first()[0]
    rows = folds.fold_deadlines(actions)
    want = rows.withColumn("status", F.when((F.col("status") == "pending") & (F.expr(DUE.at_us) < now), "passed").otherwise(F.col("status")))
    assert same(state.rows(), want.select("case_id", "deadline_key", *folds.DEADLINE))
    assert state.rows().where("status = 'passed'").count() > 0


def test_a_delivery_of_many_files(spark, folder):
    """What one delivery brings is written by many tasks and read by many, and stays one delivery."""
    from docketflow.plans.queries_streaming import _in_batches

    path, seen = f"{folder}/{uuid.uuid4().hex}", {}

    def run(stream):
        keep = lambda batch, n: seen.setdefault(n, (len(batch.inputFiles()), [r.id for r in batch.orderBy("id").collect()]))
        stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    _in_batches(spark.range(0, 400, 1, 4), path, F.col("id") % 3, 3, run)
    assert {n: ids for n, (_, ids) in seen.items()} == {i: list(range(i, 400, 3)) for i in range(3)}
    assert len(spark.read.parquet(f"{path}/in").inputFiles()) == 12
