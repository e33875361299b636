"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["queries_quality", "queries_spans", "queries_substring", "queries_ngram", "queries_packing", "queries_fingerprint", "queries_nearest", "queries_pieces", "queries_licenses", "queries_byte_bpe", "queries_repair", "queries_negatives"]

QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = import_module(f"tidemark.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
