"""The operators' registered queries and, where SQL can express one, its twin."""

from __future__ import annotations

from docketflow.llm import alignment, bpe, collocations, curves, fingerprints, language_id, mixing, near_dup, pseudo_likelihood, substring_dedup, token_files, toxicity, wrappers

_MODULES = (mixing, bpe, token_files, toxicity, curves, substring_dedup, near_dup, pseudo_likelihood, language_id, fingerprints, alignment, wrappers, collocations)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
