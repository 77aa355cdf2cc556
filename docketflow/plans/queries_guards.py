"""Queries over drafts of summaries: guards, choice of a draft, repair, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.operators import guards
from docketflow.plans.register import Register
from docketflow.sources.adapter import _day

query = Register()
QUERIES, ORACLE = query.queries, query.oracle


def _facts(d):
    known = F.array_compact(F.array("known_date"))
    scheduled = F.array(F.struct(F.lit("Sentencing Hearing").alias("title"), F.array("hearing_date").alias("dates")))
    return d.select(F.col("docket_id").alias("key"), "attempt", "text", "source", known.alias("known_dates"), scheduled.alias("scheduled"))


@query("drafts_v", "SELECT docket_id, attempt, CASE WHEN bad AND k9 AND k5 THEN 1 WHEN bad AND k9 THEN 2 ELSE 0 END AS ungrounded, CASE WHEN bad AND docket_id % 4 = 1 THEN 1 ELSE 0 END AS doubled, CASE WHEN bad AND k5 THEN 1 ELSE 0 END AS stale FROM (SELECT docket_id, attempt, attempt = 1 OR docket_id % 2 = 1 AS bad, docket_id % 9 = 0 AS k9, docket_id % 5 = 0 AS k5 FROM drafts_v) x")
def guard_findings(d):
    """How many findings each draft has, by guard."""
    return guards.found(_facts(d), ("ungrounded", "doubled", "stale")).selectExpr("key AS docket_id", "attempt", "size(found.ungrounded) AS ungrounded", "size(found.doubled) AS doubled", "size(found.stale) AS stale")


@query("drafts_v", f"""SELECT k AS docket_id, CASE WHEN dirty THEN 2 ELSE 1 END AS attempt, dirty AND k % 2 = 1 AS repaired, trim(
    CASE WHEN dirty AND k % 2 = 1 AND k % 9 = 0 THEN '' ELSE 'Mr. Doe was indicted on ' || {_day('d')} || '.' END ||
    CASE WHEN k % 4 = 1 THEN ' He owes $1,250.00 in restitution.' ELSE ' He owes $900 in restitution.' END ||
    CASE WHEN dirty AND k % 2 = 1 AND (k % 9 = 0 OR k % 5 = 0) THEN '' ELSE ' Sentencing is scheduled for ' || {_day('d')} || '.' END ||
    CASE WHEN k % 7 = 0 THEN ' He left.' ELSE '' END) AS text
    FROM (SELECT DISTINCT docket_id AS k, cast(hearing_date AS date) AS d, docket_id % 9 = 0 OR docket_id % 4 = 1 OR docket_id % 5 = 0 AS dirty FROM drafts_v) x""")
def guarded_summaries(d):
    return guards.guarded(_facts(d)).select(F.col("key").alias("docket_id"), "attempt", "repaired", "text")
