"""Ordered folds of actions into hearing and deadline state, one group a key."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions.text import RECORD

_SHARED = {"title": "string", "notes": "string", "timezone": "string", "docket_id": "bigint", "court_id": "string", "source_entry_ids": "array<bigint>", "n": "int"}
HEARING = {
    "status": "string", "local_date": "date", "local_hour": "int", "significance": "string", "duration_minutes": "int", "location": "string", "judge": "string", "dial_in": "string", **_SHARED,
}
DEADLINE = {"status": "string", "due_date": "date", "due_hour": "int", "significance": "string", "deadline_type": "string", **_SHARED}
#: The lineage; ``Fold.advanced`` makes its entries distinct.
_IDS = "source_entry_ids"
#: What every step reads of the state, whichever columns are asked for.
_ALWAYS = ("local_date", "docket_id", "court_id", "n")
#: Columns that actions may lack; they are null then.
_OPTIONAL = {
    "title": "string", "fallback_title": "string", "notes": "string", "location": "string", "judge": "string", "dial_in": "string", "duration_minutes": "int",
    "hearing_type": "string", "timezone": "string", "court_id": "string", "record_text": "string", "is_record": "boolean", "significance": "string",
    "deadline_type": "string", "local_hour": "int", "docket_id": "bigint", "conditional": "boolean",
}
# Minutes of a hearing with a clock time, by its type; 60 for others.
DURATIONS = {
    "sentencing": 90, "trial": 240, "oral_argument": 60, "evidentiary_hearing": 120, "motion_hearing": 60, "plea_hearing": 45, "change_of_plea": 45,
    "arraignment": 30, "initial_appearance": 30, "status_conference": 30, "telephonic_conference": 30,
}


def default_minutes(kind: Column, timed: Column) -> Column:
    """Minutes of a hearing that gives none: by its type, 0 (all day) without a clock time."""
    known = F.create_map(*[F.lit(x) for kv in DURATIONS.items() for x in kv])
    return F.when(timed, F.coalesce(F.try_element_at(known, kind), F.lit(60))).otherwise(F.lit(0))


def repaired_type(kind: Column, key: Column) -> Column:
    """The key tells a hearing from a deadline; the type is rewritten to match."""
    deadline = {"ADD_HEARING": "ADD_DEADLINE", "RESCHEDULE_HEARING": "RESCHEDULE_DEADLINE", "CANCEL_HEARING": "CANCEL_DEADLINE", "MARK_HELD": "MARK_FILED"}
    hearing = {v: k for k, v in deadline.items()}
    pick = lambda m: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), kind), kind)
    return F.when(key.startswith("d-"), pick(deadline)).when(key.startswith("h-"), pick(hearing)).otherwise(kind)


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _foreign(s: Column, a: Column) -> Column:
    """Whether the row belongs to a docket of another court than the action's; unknown courts are let through."""
    other = (s["docket_id"] != a["docket_id"]) & (s["court_id"] != a["court_id"])
    return (s["n"] > 0) & F.coalesce(other, F.lit(False))


def _home(s: Column, a: Column) -> dict[str, Callable[[], Column]]:
    """Zone, docket and court stay those of the first action."""
    return {c: lambda c=c: F.when(s["n"] == 0, a[c]).otherwise(s[c]) for c in ("timezone", "docket_id", "court_id")}


def _struct(columns: dict[str, Callable[[], Column]], wanted: dict[str, str]) -> Column:
    """The wanted columns of a state; the others are never worked out."""
    return F.struct(*[columns[c]().cast(kind).alias(c) for c, kind in wanted.items()])


def next_hearing(s: Column, a: Column, wanted: dict[str, str] = HEARING) -> Column:
    """State after an action.  ``s.n`` counts applied actions; 0 is "no row yet".

    A row of another known court is never touched.  CANCEL and MARK_HELD on a
    key without a row insert only with a date; MARK_HELD needs a date within two
    days of the row's, and puts the record of the proceeding in place of notes
    that tell of none; anything else sets the row scheduled again.  Lineage
    grows once for each entry.
    """
    there, kind, date = s["n"] > 0, a["type"], a["local_date"]
    same_day = F.coalesce(F.abs(F.datediff(date, s["local_date"])) <= 2, F.lit(True))
    terminal = kind.isin("CANCEL_HEARING", "MARK_HELD")
    drop = (
        kind.eqNullSafe("IGNORE")
        | ((kind == "ADD_HEARING") & date.isNull())
        | (terminal & ~there & date.isNull())
        | ((kind == "MARK_HELD") & there & ~same_day)
        | _foreign(s, a)
    )
    keeps = terminal & there

    def notes() -> Column:
        told = F.coalesce(_text(a["notes"]), a["record_text"])
        supersedes = F.coalesce(a["is_record"], F.lit(False)) & ~F.coalesce(s["notes"].rlike(RECORD), F.lit(False))
        return F.when(keeps & (kind == "MARK_HELD"), F.when(supersedes, F.coalesce(told, s["notes"])).otherwise(s["notes"])).otherwise(F.coalesce(_text(a["notes"]), s["notes"]))

    def minutes() -> Column:
        given, had = F.nullif(a["duration_minutes"], F.lit(0)), F.nullif(s["duration_minutes"], F.lit(0))
        return F.when(keeps, s["duration_minutes"]).otherwise(F.coalesce(given, F.when(kind != "RESCHEDULE_HEARING", had), default_minutes(a["hearing_type"], a["local_hour"].isNotNull())))

    def newest(c: str) -> Callable[[], Column]:
        return lambda: F.when(keeps, s[c]).otherwise(F.coalesce(_text(a[c]), s[c]))

    columns = {
        "status": lambda: F.when(kind == "CANCEL_HEARING", F.lit("cancelled")).when(kind == "MARK_HELD", F.lit("held")).otherwise(F.lit("scheduled")),
        "local_date": lambda: F.when(keeps, s["local_date"]).otherwise(F.coalesce(date, s["local_date"])),
        "local_hour": lambda: F.when(keeps | date.isNull(), s["local_hour"]).otherwise(a["local_hour"]),
        "significance": lambda: F.when(keeps, s["significance"]).when(terminal, F.coalesce(a["significance"], F.lit("major"))).otherwise(F.coalesce(a["significance"], s["significance"])),
        "duration_minutes": minutes,
        "location": newest("location"),
        "judge": newest("judge"),
        "dial_in": newest("dial_in"),
        "title": lambda: F.when(keeps, s["title"]).otherwise(F.coalesce(_text(a["title"]), F.when(there, s["title"]).otherwise(a["fallback_title"]))),
        "notes": notes,
        _IDS: lambda: F.array_append(s[_IDS], a["entry_id"]),
        "n": lambda: s["n"] + 1,
        **_home(s, a),
    }
    return F.when(drop, s).otherwise(_struct(columns, wanted))


def next_deadline(s: Column, a: Column, wanted: dict[str, str] = DEADLINE) -> Column:
    """State after a deadline action.

    A row of another known court is never touched.  MARK_FILED never inserts;
    CANCEL inserts only with a date; ADD needs a date unless it is conditional,
    and then clears the date that was there.
    """
    there, kind, date = s["n"] > 0, a["type"], a["local_date"]
    conditional = F.coalesce(a["conditional"], F.lit(False))
    ends = kind.isin("CANCEL_DEADLINE", "MARK_FILED")
    drop = ((kind == "ADD_DEADLINE") & date.isNull() & ~conditional) | ((kind == "MARK_FILED") & ~there) | ((kind == "CANCEL_DEADLINE") & ~there & date.isNull()) | _foreign(s, a)
    keeps = ends & there
    cleared = (kind == "ADD_DEADLINE") & conditional & date.isNull()
    dated = lambda old, new: F.when(keeps, s[old]).when(date.isNotNull(), a[new]).when(~cleared, s[old])
    columns = {
        "status": lambda: F.when(kind == "CANCEL_DEADLINE", F.lit("cancelled")).when(kind == "MARK_FILED", F.lit("met")).otherwise(F.lit("pending")),
        "due_date": lambda: dated("due_date", "local_date"),
        "due_hour": lambda: dated("due_hour", "local_hour"),
        "significance": lambda: F.when(keeps, s["significance"]).when(ends, F.coalesce(a["significance"], F.lit("major"))).otherwise(F.coalesce(a["significance"], s["significance"])),
        "deadline_type": lambda: F.when(keeps, s["deadline_type"]).otherwise(F.coalesce(_text(a["deadline_type"]), s["deadline_type"])),
        "title": lambda: F.when(keeps, s["title"]).otherwise(F.coalesce(_text(a["title"]), F.when(there, s["title"]).otherwise(a["fallback_title"]))),
        "notes": lambda: F.when(kind == "MARK_FILED", s["notes"]).otherwise(F.coalesce(_text(a["notes"]), s["notes"])),
        _IDS: lambda: F.array_append(s[_IDS], a["entry_id"]),
        "n": lambda: s["n"] + 1,
        **_home(s, a),
    }
    return F.when(drop, s).otherwise(_struct(columns, wanted))


@dataclass(frozen=True)
class Fold:
    """How the actions of one kind of key become its row, in batch and on a stream.

    ``reads`` names the columns of an action that a column of the state needs beside its own name.
    """

    key: str
    state: dict[str, str]
    step: Callable[..., Column]
    reads: dict[str, tuple[str, ...]]
    live: str

    def wanted(self, columns: list[str] | None = None) -> dict[str, str]:
        """The columns of the state to work out: those asked for (None: all) and those every step reads."""
        return {c: kind for c, kind in self.state.items() if columns is None or c in columns or c in _ALWAYS}

    def actions(self, actions: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The live actions with what the steps read; columns they lack are null."""
        live = actions.where(self.live)
        read = [F.col(c) if c in actions.columns else F.lit(None).cast(kind).alias(c) for c, kind in self.read(columns).items()]
        return live.select("case_id", self.key, "seq", "entry_id", "type", "local_date", *read)

    def read(self, columns: list[str] | None = None) -> dict[str, str]:
        """The optional columns of an action that the steps read."""
        names = {a for c in self.wanted(columns) for a in (c, *self.reads.get(c, ()))} | set(self.reads["n"])
        return {c: kind for c, kind in sorted(_OPTIONAL.items()) if c in names}

    def steps(self, actions: DataFrame, *by: str) -> DataFrame:
        """One row a key with its actions in order; one exchange."""
        rest = [c for c in actions.columns if c not in ("case_id", self.key, *by)]
        return actions.groupBy("case_id", self.key, *by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("steps"))

    def start(self, columns: list[str] | None = None) -> Column:
        wanted = self.wanted(columns)
        empty = {c: v for c, v in (("source_entry_ids", []), ("n", 0)) if c in wanted}
        return F.from_json(F.lit(json.dumps(empty)), "struct<" + ",".join(f"{c}:{kind}" for c, kind in wanted.items()) + ">")

    def advanced(self, start: Column, columns: list[str] | None = None) -> Column:
        """The state after ``steps``; lineage has each entry once, where it came first.

        Every step copies its state, so a lineage that grew with the steps would cost
        their square.  They are taken in parts of about the root of their number, each with a lineage of its own.
        """
        wanted = self.wanted(columns)
        step = lambda s, a: self.step(s, a, wanted)
        if _IDS not in wanted:
            return F.aggregate("steps", start, step)
        row = lambda s, ids, *more: F.struct(*[(ids if c == _IDS else s[c]).cast(kind).alias(c) for c, kind in wanted.items()], *more)
        size = F.ceil(F.sqrt(F.size("steps"))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("steps") / size).cast("int") - 1), lambda i: F.slice("steps", i * size + 1, size))

        def taken(s: Column, part: Column) -> Column:
            return F.aggregate(part, row(s, F.array()), step, lambda t: row(t, F.array(), F.array_append(s["parts"], t[_IDS]).alias("parts")))

        first = row(start, F.array(), F.array(start[_IDS]).cast("array<array<bigint>>").alias("parts"))
        return F.aggregate(parts, first, taken, lambda s: row(s, F.array_distinct(F.flatten(s["parts"]))))

    def rows(self, actions: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The rows that ``actions`` leave, with the columns asked for."""
        folded = self.steps(self.actions(actions, columns)).select("case_id", self.key, self.advanced(self.start(columns), columns).alias("s"))
        return folded.where("s.n > 0").select("case_id", self.key, *[f"s.{c}" for c in columns or self.state])


HEARINGS = Fold(
    "hearing_key", HEARING, next_hearing,
    {"title": ("fallback_title",), "notes": ("record_text", "is_record"), "duration_minutes": ("hearing_type", "local_hour"), "n": ()},
    "hearing_key IS NOT NULL AND type <> 'IGNORE'",
)
DEADLINES = Fold("deadline_key", DEADLINE, next_deadline, {"title": ("fallback_title",), "due_hour": ("local_hour",), "n": ("conditional",)}, "deadline_key IS NOT NULL")


def fold_hearings(actions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``actions(case_id, hearing_key, seq, entry_id, type, local_date, ...)`` to one row a key.

    Optional columns: see ``_OPTIONAL``.  The start is local to ``timezone``, which stays that of
    the first action; ``render.local_to_utc`` gives the instant.  ``columns``: those wanted (None: all).
    """
    return HEARINGS.rows(actions, columns)


def fold_deadlines(actions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``actions(case_id, deadline_key, seq, entry_id, type, local_date, conditional, ...)`` to one row a key; without an hour it falls due at 16:00."""
    return DEADLINES.rows(actions, columns)
