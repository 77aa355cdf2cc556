"""All registered queries of the docket engine with their SQL twins."""

from __future__ import annotations

from docketflow.plans import queries_documents, queries_events, queries_guards, queries_ingest, queries_jobs, queries_models, queries_render, queries_rows, queries_scoring, queries_streaming, queries_upkeep
from docketflow.plans.queries_events import flagship  # noqa: F401

_MODULES = (queries_ingest, queries_events, queries_guards, queries_scoring, queries_models, queries_documents, queries_upkeep, queries_render, queries_rows, queries_streaming, queries_jobs)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
