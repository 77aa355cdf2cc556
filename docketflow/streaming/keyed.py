"""Folds as a stream: rows of keys in buckets, a version a delivery, and what falls due by the clock.

Under a folder:

- ``history/batch=n/bucket=b``: the live actions of a delivery, each once;
- ``rows/batch=n/bucket=b``: all rows of a bucket, as the delivery left them;
- ``due/batch=n/day=d``: the buckets and instants of rows it left waiting, by the day they fall due;
- ``changed/batch=n``: rows whose status it changed, and whether an action or the clock did;
- ``versions/version=n``: for each bucket the delivery whose rows are valid, and the clock.

A version is written last and in one piece, so a delivery that fails leaves the one
before it; run again, it overwrites its own folders and starts from the same
version.  Buckets without a new action or due row are not read.  An action after
the newest of its key takes the key's state one step on; an older one,
or one that came before, makes the key's whole history be folded again.  Both
use the steps of ``operators.folds``.

Defined cases: actions that come twice count once; a delivery without live
actions still moves the clock; the clock never goes back; a key whose actions
all changed nothing is kept, without a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.operators.folds import Fold

_VERSION = "bucket int, batch long, clock_us long, version long"
_DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Due:
    """When rows fall due: an SQL expression of microseconds, the status that waits and the one it turns to."""

    at_us: str
    waiting: str = "pending"
    over: str = "passed"


@dataclass(frozen=True)
class KeyedStream:
    """A fold over deliveries.

    ``seq`` is the SQL type of the actions' order.  ``buckets`` bounds what a
    version lists and what the driver holds; more buckets make smaller ones.
    """

    spark: SparkSession
    folder: str
    fold: Fold
    seq: str
    buckets: int = 64
    due: Due | None = None

    def run(self, actions: DataFrame, clock_us: str, checkpoint: str) -> None:
        """Folds the stream of ``actions`` as far as it goes; the column ``clock_us`` says when each was delivered."""
        stream = actions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        stream.foreachBatch(lambda batch, number: self.deliver(batch, number, clock_us)).start().awaitTermination()

    def version(self, before: int | None = None) -> tuple[dict[int, int], int | None]:
        """{bucket: delivery} and the clock of the newest version, or of the newest below ``before``."""
        if not self._there("versions"):
            return {}, None
        rows = self.spark.read.schema(_VERSION).parquet(f"{self.folder}/versions")
        rows = rows if before is None else rows.where(F.col("version") < before)
        newest = rows.agg(F.max("version")).first()[0]
        if newest is None:
            return {}, None
        found = rows.where(F.col("version") == newest).collect()  # a row a bucket, and one for the clock
        return {r.bucket: r.batch for r in found if r.bucket >= 0}, next(r.clock_us for r in found if r.bucket < 0)

    def rows(self) -> DataFrame:
        """The rows of the newest version."""
        return self._stored(self.version()[0]).where("s.n > 0").select("case_id", self.fold.key, "s.*")

    def changes(self) -> DataFrame:
        """(case_id, key, status, before, cause, batch) of every delivery: the cause is an action or the clock."""
        return self.spark.read.schema(f"case_id string, {self.fold.key} string, status string, before string, cause string, batch long").parquet(f"{self.folder}/changed")

    def deliver(self, batch: DataFrame, number: int, clock_us: str) -> None:
        """One delivery: its actions, then what the clock makes due, then the version."""
        fold, key = self.fold, ["case_id", self.fold.key]
        known, was = self.version(before=number)
        bucket = F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int").alias("bucket")
        typed = [F.col(c).cast(kind).alias(c) for c, kind in self._action().items()]
        self._write(fold.actions(batch).select(*typed, bucket).distinct(), f"history/batch={number}", "bucket")
        stamps = [x for x in (was, batch.agg(F.max(clock_us)).first()[0]) if x is not None]
        now = max(stamps, default=None)
        new = self._history(f"/batch={number}")
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
        touched |= self._falling_due(was, now, number)
        if touched:
            stored = self._stored({b: n for b, n in known.items() if b in touched})
            folded = self._folded(stored, fold.steps(new, "bucket"), touched, number)
            self._write(self._flipped(folded, now), f"rows/batch={number}", "bucket")
            self._list(stored, self._stored(dict.fromkeys(touched, number)), new, number)
        listed = [(b, n, None) for b, n in {**known, **dict.fromkeys(touched, number)}.items()]
        table = self.spark.createDataFrame([*listed, (-1, number, now)], "bucket int, batch long, clock_us long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/version={number}")

    def _folded(self, stored: DataFrame, fresh: DataFrame, touched: set[int], number: int) -> DataFrame:
        """(bucket, case_id, key, s, last) of the touched buckets: one step on where the actions are newer than ``last``, else anew."""
        fold, key = self.fold, ["bucket", "case_id", self.fold.key]
        order = lambda step: F.struct(step["seq"].alias("seq"), step["entry_id"].alias("entry_id"))
        both = stored.hint("merge").join(fresh, key, "full")
        first, newest = order(F.element_at("steps", 1)), order(F.element_at("steps", -1))
        idle, late = F.col("steps").isNull(), F.coalesce(F.col("last") >= first, F.lit(False))
        state = F.when(idle, F.col("s")).when(~late, fold.advanced(F.coalesce("s", fold.start())))
        both = self._work(both.select(*key, state.alias("s"), F.when(idle, F.col("last")).otherwise(newest).alias("last"), late.alias("late")), f"work/batch={number}")
        again = both.where("late").select(*key)
        if again.isEmpty():
            return both.drop("late")
        history = self._history("").where(F.col("bucket").isin(sorted(touched)) & (F.col("batch") <= number)).drop("batch")
        anew = fold.steps(history.join(again.hint("merge"), key, "left_semi").distinct(), "bucket")
        anew = anew.select(*key, fold.advanced(fold.start()).alias("s"), order(F.element_at("steps", -1)).alias("last"))
        return both.where("NOT late").drop("late").unionByName(anew)

    def _flipped(self, rows: DataFrame, now: int | None) -> DataFrame:
        """Rows whose time has come get the status that says so."""
        if self.due is None or now is None:
            return rows
        named = rows.select("*", *[F.col(f"s.{c}").alias(c) for c in self.fold.state])
        over = (F.col("status") == self.due.waiting) & (F.expr(self.due.at_us) < now)
        return named.withColumn("s", F.when(over, F.col("s").withField("status", F.lit(self.due.over))).otherwise(F.col("s"))).select(*rows.columns)

    def _falling_due(self, was: int | None, now: int | None, number: int) -> set[int]:
        """Buckets with a row that earlier deliveries listed and that fell due since the last clock; reads these days alone."""
        if self.due is None or was is None or not self._there("due"):
            return set()
        rows = self.spark.read.schema("bucket int, due_us long, batch long, day long").parquet(f"{self.folder}/due")
        rows = rows.where((F.col("batch") < number) & F.col("due_us").between(was, now - 1) & F.col("day").between(was // _DAY_US, now // _DAY_US))
        return {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``

    def _list(self, old: DataFrame, rows: DataFrame, new: DataFrame, number: int) -> None:
        """Writes which rows changed their status, and when those that wait fall due."""
        key = ["bucket", "case_id", self.fold.key]
        acted = new.select(*key).distinct().withColumn("acted", F.lit(True))
        before = old.where("s.n > 0").select(*key, F.col("s.status").alias("before"))
        both = rows.where("s.n > 0").hint("merge").join(before, key, "left").join(acted.hint("merge"), key, "left")
        cause = F.when(F.col("acted"), F.lit("action")).otherwise(F.lit("clock")).alias("cause")
        moved = both.where(~F.col("s.status").eqNullSafe(F.col("before")))
        moved.select("case_id", self.fold.key, F.col("s.status").alias("status"), "before", cause).write.mode("overwrite").parquet(f"{self.folder}/changed/batch={number}")
        if self.due is not None:
            waits = both.where((F.col("s.status") == self.due.waiting) & F.col("acted")).select("bucket", *[F.col(f"s.{c}").alias(c) for c in self.fold.state])
            waits = waits.select("bucket", F.expr(self.due.at_us).alias("due_us")).where("due_us IS NOT NULL").distinct()
            self._write(waits.withColumn("day", F.floor(F.col("due_us") / _DAY_US).cast("long")), f"due/batch={number}", "day")

    def _action(self) -> dict[str, str]:
        return {"case_id": "string", self.fold.key: "string", "seq": self.seq, "entry_id": "bigint", "type": "string", "local_date": "date", **self.fold.read()}

    def _history(self, batch: str) -> DataFrame:
        kinds = {**self._action(), **({} if batch else {"batch": "bigint"}), "bucket": "int"}
        return self.spark.read.schema(", ".join(f"{c} {kind}" for c, kind in kinds.items())).parquet(f"{self.folder}/history{batch}")

    def _stored(self, known: dict[int, int]) -> DataFrame:
        """(case_id, key, s, last, bucket) of some buckets, each from the delivery that wrote it last."""
        kinds = ",".join(f"{c}:{kind}" for c, kind in self.fold.state.items())
        schema = f"case_id string, {self.fold.key} string, s struct<{kinds}>, last struct<seq:{self.seq},entry_id:bigint>, batch long, bucket int"
        if not known:
            return self.spark.createDataFrame([], schema).drop("batch")
        paths = [f"{self.folder}/rows/batch={n}/bucket={b}" for b, n in sorted(known.items())]
        return self.spark.read.option("basePath", f"{self.folder}/rows").schema(schema).parquet(*paths).drop("batch")

    def _work(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _write(self, rows: DataFrame, name: str, by: str) -> None:
        rows.repartition(by).write.mode("overwrite").partitionBy(by).parquet(f"{self.folder}/{name}")

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
