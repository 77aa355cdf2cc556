"""Queries over calls, scores and actions: ledgers, deviations, funnels, peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions.text import base_key
from docketflow.operators import folds, scoring
from docketflow.plans.queries_events import HEARING_ROWS, as_steps
from docketflow.plans.register import Register

query = Register()
QUERIES, ORACLE = query.queries, query.oracle

_PRICED = (
    "SELECT c.*, CASE WHEN c.model LIKE 'local:%' THEN 0 ELSE greatest(0, tokens_in - cached - cache_write) * coalesce(x.rate_in, r.rate_in) + cached * coalesce(x.rate_cached, r.rate_cached) + cache_write * coalesce(x.rate_write, r.rate_write) + tokens_out * coalesce(x.rate_out, r.rate_out) END AS cost "
    "FROM calls_v c LEFT JOIN rates_v x ON x.model = c.model LEFT JOIN rates_v r ON r.model = regexp_replace(c.model, '(-[0-9]{4}-[0-9]{2}-[0-9]{2}|-[0-9]{3,8})$', '')"
)
_ALL = " UNION ALL ".join(
    f"SELECT p.provider, t.entry_id, t.docket, '{c}' AS category, cast(t.{c} AS bigint) AS human, cast(coalesce(m.{c}, 0) AS bigint) AS found FROM truth_v t CROSS JOIN (SELECT DISTINCT provider FROM model_v) p LEFT JOIN model_v m ON m.provider = p.provider AND m.entry_id = t.entry_id"
    for c in scoring.CATEGORIES
)
_SPLIT = "cast(sum(greatest(found - human, 0)) AS bigint) AS over, cast(sum(greatest(human - found, 0)) AS bigint) AS under"


@query("calls_v rates_v", f"SELECT docket, model, count(*) AS calls, cast(sum(tokens_in) AS bigint) AS tokens_in, cast(sum(tokens_out) AS bigint) AS tokens_out, cast(sum(cached) AS bigint) AS cached, cast(sum(cache_write) AS bigint) AS cache_write, cast(coalesce(sum(cost), 0) AS bigint) AS cost, count_if(cost IS NULL) AS unpriced FROM (SELECT coalesce(docket, '?') AS docket, model, tokens_in, tokens_out, cached, cache_write, cost FROM ({_PRICED}) p) q GROUP BY GROUPING SETS ((docket), (model), ())")
def token_ledger(c, r):
    return scoring.ledger(scoring.priced(c, r))


@query("calls_v rates_v", f"SELECT model, CASE WHEN purpose = 'summary' THEN 'summary' ELSE 'extraction' END AS track, count(*) AS calls, cast(sum(tokens_in) AS bigint) AS tokens_in, round(avg(tokens_out), 6) AS mean_out, cast(coalesce(sum(cost), 0) AS bigint) AS cost, count_if(cost IS NULL) AS unpriced FROM ({_PRICED}) p GROUP BY ALL")
def call_tracks(c, r):
    return scoring.call_tracks(scoring.priced(c, r))


@query("truth_v model_v", f"SELECT provider, category, {_SPLIT} FROM ({_ALL}) a GROUP BY provider, category")
def deviation(t, m):
    return scoring.deviation(scoring.compared(t, m), ["provider", "category"])


@query("truth_v model_v", f"SELECT provider, category, {_SPLIT} FROM (SELECT provider, docket, category, sum(human) AS human, sum(found) AS found FROM ({_ALL}) a GROUP BY ALL) b GROUP BY provider, category")
def docket_deviation(t, m):
    return scoring.docket_deviation(scoring.compared(t, m))


@query("truth_v model_v", f"SELECT entry_id, human, human / total AS share FROM (SELECT entry_id, cast(max(human) AS bigint) AS human, max(found) AS found, sum(max(human)) OVER () AS total FROM (SELECT provider, entry_id, sum(human) AS human, sum(found) AS found FROM ({_ALL}) a GROUP BY ALL) b GROUP BY entry_id) c WHERE human > 0 AND found = 0")
def universal_misses(t, m):
    return scoring.universal_misses(scoring.compared(t, m))


@query("truth_v model_v", f"SELECT provider, CASE WHEN category IN ('h_scheduled', 'd_set') THEN 'add' WHEN category LIKE '%_cancelled' THEN 'cancel' ELSE 'lifecycle' END AS bucket, cast(sum(human) AS bigint) AS human, cast(sum(found) AS bigint) AS found FROM ({_ALL}) a GROUP BY ALL")
def over_buckets(t, m):
    return scoring.buckets(scoring.compared(t, m))


_DUE = {"ADD_HEARING": "ADD_DEADLINE", "RESCHEDULE_HEARING": "RESCHEDULE_DEADLINE", "CANCEL_HEARING": "CANCEL_DEADLINE", "MARK_HELD": "MARK_FILED"}
_COUNTED = ", ".join(
    [f"count_if(type = '{k}' AND deadline_type IS NULL) AS {scoring.CATEGORY_OF[k]}" for k in _DUE] + [f"count_if(type = '{k}' AND deadline_type IS NOT NULL) AS {scoring.CATEGORY_OF[d]}" for k, d in _DUE.items()]
)


@query("actions_v", f"SELECT 'p' || cast(docket_id % 3 AS string) AS label, docket_id AS entry_id, {_COUNTED} FROM actions_v GROUP BY docket_id")
def action_counts(a):
    """Counts of eight kinds; actions with a deadline's type are on deadline keys."""
    key = F.when(F.col("deadline_type").isNotNull(), F.lit("d-x")).otherwise("h-x")
    rows = a.select(F.concat(F.lit("p"), (F.col("docket_id") % 3).cast("string")).alias("label"), F.col("docket_id").alias("entry_id"), folds.repaired_type(F.col("type"), key).alias("type"))
    return scoring.action_counts(rows)


@query("actions_v", "SELECT event_id FROM (SELECT event_id, entry_date, first_value(entry_date) OVER (PARTITION BY case_id, type, hearing_key, local_date ORDER BY entry_date, event_id) AS f FROM actions_v) x WHERE entry_date = f")
def repeat_firing(a):
    return scoring.first_firings(a)


@query("actions_v", "SELECT case_id, base, count(*) AS n FROM (SELECT DISTINCT case_id, hearing_key, regexp_replace(hearing_key, '-[0-9]+$', '') AS base FROM actions_v) x GROUP BY case_id, base HAVING count(*) > 1")
def key_families(a):
    keys = a.select("case_id", "hearing_key").distinct()
    return keys.groupBy("case_id", base_key(F.col("hearing_key")).alias("base")).agg(F.count("*").alias("n")).where("n > 1")


_SLUG = "coalesce(hearing_type, 'x') || '-' || lower(split_part(entry_text, ' ', 1)) || CASE WHEN dial_in IS NOT NULL THEN '-redaction' WHEN judge IS NOT NULL THEN '-amicus' ELSE '' END"


@query("actions_v", f"SELECT CASE WHEN contains(k, 'redaction') THEN 'transcript redaction-request' WHEN contains(k, 'amicus') THEN 'amicus response / reply' WHEN contains(k, 'transcript') THEN 'other transcript' ELSE 'other procedural' END AS bucket, count(*) AS n FROM (SELECT {_SLUG} AS k FROM actions_v WHERE significance = 'minor') x GROUP BY ALL")
def minor_key_buckets(a):
    return a.where("significance = 'minor'").groupBy(scoring.minor_bucket(F.expr(_SLUG)).alias("bucket")).agg(F.count("*").alias("n"))


@query("actions_v", "SELECT docket_id, max(n) AS peak FROM (SELECT docket_id, count(*) OVER (PARTITION BY docket_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM (SELECT docket_id, event_id * 7000000 AS us FROM actions_v) raw) x GROUP BY docket_id")
def peak_requests(a):
    return scoring.peak(a.select("docket_id", (F.col("event_id") * 7_000_000).alias("us")), "docket_id", "us", 3600)


@query("actions_v", f"SELECT cast(sum(n) AS bigint) AS applied, count(*) AS rows, count_if(local_date IS NOT NULL AND significance IS DISTINCT FROM 'minor') AS visible FROM {HEARING_ROWS} s")
def action_funnel(a):
    """Applied actions, logical rows and visible rows."""
    return scoring.funnel(folds.fold_hearings(as_steps(a), ["local_date", "significance", "n"]))
