"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import chat, classifier, exact, html, jaccard, mixing, packing, quality_rules, substrings, urls

MODULES = (chat, classifier, exact, html, jaccard, mixing, packing, quality_rules, substrings, urls)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
