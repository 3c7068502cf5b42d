"""Registered queries and their SQL."""

from __future__ import annotations

from weftline.plans import curation, extensions, measures, metrics, relations, rules, text

FLAGSHIP = "near_dup_knn_ties"
MODULES = (text, relations, metrics, curation, measures, rules, extensions)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
